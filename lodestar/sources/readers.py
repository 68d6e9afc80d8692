"""Sources and sinks: documents from folders and archives, JSON lines, CSV, and pluggable parsers and embedders."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import office

TEXT_EXTENSIONS = ("txt", "md", "markdown", "rst", "log", "json", "jsonl", "xml", "html", "htm", "yaml")
OFFICE_EXTENSIONS = ("doc", "docx", "xls", "xlsx", "ppt", "pptx")
OTHER_EXTENSIONS = ("pdf", "csv", "tsv", "rtf")
SUPPORTED = TEXT_EXTENSIONS + OFFICE_EXTENSIONS + OTHER_EXTENSIONS

Parser = Callable[[bytes, str], list[tuple[str, str, int | None]]]
"""Content and file name to objects: (object type, text, page)."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that parse as JSON objects; blank, broken and other lines are left out. A text may hold any character but a newline."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.where("ok AND r IS NOT NULL").select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keys in order, one object a line."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in each part, whose first name begins with the byte order mark that spreadsheets look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """With or without a byte order mark."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip(BOM).strip('"') for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def _listed(files: DataFrame, root: str, ignored: tuple[str, ...], extensions: tuple[str, ...]) -> DataFrame:
    prefix = re.escape(root.rstrip("/").removeprefix("file://").removeprefix("file:"))
    relative = F.regexp_replace("path", rf"^(?:[a-z0-9]+:/*(?=/))?.*?{prefix}/", "")
    key = lambda p: F.regexp_replace(F.translate(F.lower(p), "ё", "е"), "[^0-9a-zа-я]", "")
    rows = files.withColumn("relative_path", relative)
    rows = rows.where(F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1)).isin(*extensions))
    folders = F.slice(F.split("relative_path", "/"), 1, F.size(F.split("relative_path", "/")) - 1)
    names = [re.sub("[^0-9a-zа-я]", "", x.lower().replace("ё", "е")) for x in ignored]
    return rows.where(~F.exists(folders, lambda p: key(p).isin(*names))) if names else rows


def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), extensions: tuple[str, ...] = SUPPORTED, limit: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, relative_path, length, content) of supported files below ``root``, none below an ignored folder; a limit takes the first by path.

    ``known``: relative_path of files to leave out. They are left out by name, so
    their content is never read; the names of the others go to the driver, whose
    file index holds those of all files anyway.
    """
    read = lambda *paths: spark.read.format("binaryFile").option("recursiveFileLookup", len(paths) == 1 and paths[0] == root).load(list(paths))
    listed = _listed(read(root).select("path", "length"), root, ignored, extensions)
    if known is None and not limit:
        return _listed(read(root).select("path", "length", "content"), root, ignored, extensions).select("path", "relative_path", "length", "content")
    if known is not None:
        listed = listed.join(known.select("relative_path").distinct(), "relative_path", "left_anti")
    if limit:
        listed = listed.orderBy("relative_path").limit(limit)
    paths = [r.path for r in listed.select("path").collect()]
    files = read(*paths) if paths else read(root).limit(0)
    rows = _listed(files.select("path", "length", "content"), root, ignored, extensions).select("path", "relative_path", "length", "content")
    return rows.orderBy("relative_path") if limit else rows


def unzip(path: str, to: str) -> list[str]:
    """Files of an archive below ``to``, which must be a folder that all machines see; names that lead out of it are refused."""
    from pathlib import Path

    out, base = [], Path(to).resolve()
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            target = (base / info.filename).resolve()
            if not target.is_relative_to(base):
                raise ValueError(f"{info.filename} leads out of the folder")
            if not info.is_dir():
                z.extract(info, base)
                out.append(str(target))
    return out


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else windows-1251."""
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text:
            return text
    return ""


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(html: str) -> str:
    p = _Html()
    p.feed(html)
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.parts).split("\n")) if x)


def markdown_table(rows: list[list[str]]) -> str:
    """Rows padded to the widest, empty ones left out, the first as header."""
    cells = [[" ".join(str(c or "").split()) for c in r] for r in rows]
    cells = [r for r in cells if any(r)]
    if not cells:
        return ""
    width = max(map(len, cells))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(cells[0]), "|" + " --- |" * width, *map(line, cells[1:])])


def _text(content: bytes, name: str) -> list[tuple[str, str, int | None]]:
    text = decode(content)
    return [("text", html_text(text) if name.lower().endswith((".html", ".htm")) else text, None)]


def _table(content: bytes, name: str) -> list[tuple[str, str, int | None]]:
    text = decode(content)
    head = text[:4096]
    usual = "\t" if name.lower().endswith(".tsv") else ","
    delimiter = max((usual, ",", ";", "\t", "|"), key=head.count)  # of equally frequent ones the usual
    return [("table", markdown_table(list(csv.reader(io.StringIO(text), delimiter=delimiter))), None)]


PARSERS: dict[str, Parser] = {**dict.fromkeys(TEXT_EXTENSIONS, _text), "csv": _table, "tsv": _table, **office.PARSERS}
"""By extension. More parsers are plug-ins: add a function here, or give others to ``parse``."""


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(relative_path, source_hash, object_type, object_index, page, text, error) of files (relative_path, content).

    A file without a parser, with a failing one, or without any text has one row with an error.
    """
    ship_package(files.sparkSession)
    known = dict(PARSERS if parsers is None else parsers)
    schema = "relative_path string, source_hash string, object_type string, object_index int, page int, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["relative_path"], pdf["content"]):
                digest, parser = hashlib.sha256(content).hexdigest(), known.get(path.rsplit(".", 1)[-1].lower())
                try:
                    found = [x for x in parser(bytes(content), path) if x[1].strip()] if parser else None
                    error = "no parser" if found is None else None if found else "no text"
                except Exception as e:  # a plug-in's failure is the file's, not the job's
                    found, error = [], str(e) or type(e).__name__
                rows += [(path, digest, kind, i, page, text, None) for i, (kind, text, page) in enumerate(found or ())]
                if error:
                    rows.append((path, digest, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"object_index": "Int32", "page": "Int32"})

    return files.select("relative_path", "content").mapInPandas(run, schema)


def hashing_embedder(text: Column, dim: int = 64) -> Column:
    """A vector of hashed words, of length one: the default where no embedding service is plugged in."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def embed(rows: DataFrame, text: str, service: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32, concurrency: int | None = 8) -> DataFrame:
    """``rows`` with embedding, by a service for lists of texts or else by hashing. Texts are sent in batches from the executors, ``concurrency`` tasks at a time."""
    if service is None:
        return rows.withColumn("embedding", hashing_embedder(F.col(text)))
    ship_package(rows.sparkSession)
    rows = rows.coalesce(concurrency) if concurrency else rows

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            out += service(list(texts[i : i + batch].fillna("")))
        return pd.Series(out)

    return rows.withColumn("embedding", call(text))


def http_embedder(url: str, model: str, api_key: str = "", batch: int = 32, timeout: float = 180.0, field: str = "input", vector: str = "embedding") -> Callable[[list[str]], list[list[float]]]:
    """A service for ``embed`` that posts lists of texts to ``url``/embeddings, in batches, as OpenAI-compatible servers take them.

    A task has one request open at a time, so ``embed(concurrency=...)`` bounds how many there are at once.
    """

    def call(texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            some = texts[i : i + batch]
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
            request = urllib.request.Request(url.rstrip("/") + "/embeddings", json.dumps({"model": model, field: some}).encode(), headers)
            with urllib.request.urlopen(request, timeout=timeout) as response:
                rows = json.load(response).get("data")
            if not isinstance(rows, list) or len(rows) != len(some) or not all(isinstance(r, dict) and r.get(vector) for r in rows):
                raise ValueError("the embedding service did not give a vector for each text")
            out += [[float(x) for x in r[vector]] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        return out

    return call
