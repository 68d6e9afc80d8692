"""Chunks of documents and the identifiers of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import bind, clean_lines, lines, strip

MAX_CHARS, OVERLAP = 3200, 300


def windows(docs: DataFrame, text: str = "text", size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``docs`` with chunk_index and chunk: windows of ``size`` characters, each ``overlap`` into the one before.

    A text within one window is one chunk; null and empty texts have none.
    """
    stride = size - overlap
    n = F.ceil(F.greatest(F.length(text) - overlap, F.lit(1)) / stride).cast("int")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("chunk_index", F.explode(starts)).withColumn("chunk", F.substring(F.col(text), F.col("chunk_index") * stride + 1, F.lit(size)))


def packed(docs: DataFrame, text: str = "text", size: int = MAX_CHARS) -> DataFrame:
    """The rows of ``docs`` with chunk_index and chunk: paragraphs packed in order while they fit, two characters between them.

    A paragraph over ``size`` is cut into windows, each a chunk of its own.
    """
    stride = size - OVERLAP
    cut = lambda p: F.transform(
        F.sequence(F.lit(0), F.ceil(F.greatest(F.length(p) - OVERLAP, F.lit(1)) / stride).cast("int") - 1),
        lambda i: F.substring(p, i * stride + 1, F.lit(size)),
    )
    stripped = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    parts = F.filter(stripped, lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        close = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        fits = (F.length(acc["open"]) + 2 + F.length(p)) <= size
        return (
            F.when(F.length(p) > size, F.struct(F.concat(close, cut(p)).alias("done"), F.lit("").alias("open")))
            .when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open")))
            .otherwise(F.struct(close.alias("done"), p.alias("open")))
        )

    chunks = F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return docs.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))


def sha1_of(*parts: Column) -> Column:
    """Of the parts joined by pipes."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def with_ids(chunks: DataFrame, source_name: Column, source_hash: Column, kind: Column | str = "chunk", at: Column | None = None) -> DataFrame:
    """Chunks (chunk_index, chunk) with object_id, text_hash, chunk_id, fragment_id and source_id; ``at``: what numbers an object, else chunk_index."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = chunks.withColumn("source_hash", source_hash).withColumn(
        "object_id", F.substring(sha1_of(source_name, kind, F.col("chunk_index") if at is None else at, F.substring("chunk", 1, 120)), 1, 16)
    )
    return (
        rows.withColumn("text_hash", F.sha2("chunk", 256))
        .withColumn("source_id", F.concat(F.lit("sha256:"), "source_hash"))
        .withColumn("chunk_id", F.concat(F.lit("chunk:"), sha1_of(F.col("source_hash"), F.col("object_id"), F.col("text_hash"))))
        .withColumn("fragment_id", F.concat(F.lit("fragment:"), sha1_of(F.col("source_hash"), F.col("object_id"))))
    )


def citation_name(source: Column, kind: Column, page: Column, section: Column, object_id: Column) -> Column:
    return F.concat(source, F.lit("#"), kind, F.lit(":"), F.coalesce(page.cast("string"), section, object_id))


def repeated_lines(pages: DataFrame, group: str, page: str, text: str = "text", min_repeats: int = 3) -> DataFrame:
    """(group, line, pages): headers and footers, lines that stand on ``min_repeats`` pages of a group or more, on two at least.

    Normalised lines of 4 to 160 characters, longer ones only with a pipe; page
    numbers don't count, nor do data rows (three numbers or more and a pipe).
    """
    rows = pages.select(F.col(group).alias("group"), F.col(page).alias("page"), F.explode(lines(text)).alias("line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace(F.translate(F.lower("line"), "ё", "е"), r"(?U)\s+", " ")))
    fits = (F.length("line") >= 4) & ((F.length("line") <= 160) | F.col("line").contains("|"))
    data = F.col("line").contains("|") & (F.regexp_count("line", F.lit(r"\d+(?:[,.]\d+)?")) >= 3)
    counted = rows.where(fits & ~F.col("line").rlike(V.PAGE_NUMBER) & ~data).distinct().groupBy("group", "line").agg(F.count("*").alias("pages"))
    return counted.where(F.col("pages") >= max(2, min_repeats))


def without_noise(docs: DataFrame, text: str = "text", document_type: str | None = None, repeated: str | None = None, drop_references: bool = True) -> DataFrame:
    """``docs`` with ``text`` cleaned and without page numbers, repeated lines, footnotes, bare links and the list of references.

    ``repeated``: a column of normalised lines. The list runs from its heading to
    an appendix or the end, and goes from documents of the types in
    ``LOSE_REFERENCES``. Of blank lines in a row one stays.
    """
    # blanks that are one already are left as they are, which most are
    norm = lambda x: F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ё"), F.lit("е")), r"(?U)\s{2,}|[^\S ]", " "))
    seen = (lambda x: F.coalesce(F.array_contains(F.col(repeated), norm(x)), F.lit(False))) if repeated else (lambda x: F.lit(False))
    loses = F.lit(drop_references) & (F.coalesce(F.col(document_type), F.lit("generic")).isin(*V.LOSE_REFERENCES) if document_type else F.lit(True))

    def kind(line: Column) -> Column:
        """Blank, passed over before the list of references is looked at, heading of one, appendix, debris or text."""
        found = F.when(line == "", "b").when(line.rlike(V.PAGE_NUMBER) | seen(line), "p").when(loses & line.rlike(V.REFERENCE_HEADING), "h")
        return found.when(line.rlike(V.FOOTNOTE) | line.rlike(V.BARE_LINK), "d").when(line.rlike(V.APPENDIX_HEADING), "a").otherwise("t")

    def kept(own: Column) -> Column:
        # a list of references goes from its heading on, line by line, up to an appendix; blank lines in it stay
        kinds = F.regexp_replace(F.array_join(F.transform(own, kind), ""), r"h|(?!\A)\G(b*)[^ab]", "$1p")
        marked = F.zip_with(own, F.split(kinds, ""), lambda line, k: F.when(k.isin("a", "b", "t"), line))
        return F.regexp_replace(F.array_join(marked, "\n"), r"\n{3,}", "\n\n")

    return docs.withColumn(text, strip(bind(clean_lines(text), kept)))


def split_tables(text: Column) -> Column:
    """Struct of rest, the text without its tables, and tables, runs of two or more lines between pipes."""
    own = F.transform(lines(text), lambda x, i: F.struct(x.alias("x"), x.rlike(V.TABLE_LINE).alias("t"), i.alias("i")))

    def parted(rows: Column) -> Column:
        at = lambda i: F.coalesce(F.get(rows, i)["t"], F.lit(False))
        marked = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), (r["t"] & (at(r["i"] - 1) | at(r["i"] + 1))).alias("t")))
        # tables are joined by lines, parted by a character that no line holds
        joined = F.array_join(F.transform(marked, lambda r: F.when(r["t"], r["x"]).otherwise(F.lit("\x00"))), "\n")
        tables = F.filter(F.transform(F.split(joined, "\x00"), strip), lambda x: x != "")
        rest = F.array_join(F.transform(F.filter(marked, lambda r: ~r["t"]), lambda r: r["x"]), "\n")
        return F.struct(rest.alias("rest"), tables.alias("tables"))

    return bind(own, parted)


def parsed_table(table: Column) -> Column:
    """Cells of a table's lines, without separator and empty rows, padded to the widest."""
    cells = lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|"), strip)
    rows = F.transform(F.filter(F.split(table, "\n"), lambda x: x.rlike(V.TABLE_LINE)), cells)
    real = F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")) & F.exists(r, lambda c: c != ""))
    return bind(real, lambda kept: F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.array_max(F.transform(kept, F.size)) - F.size(r)))))


def markdown_tables(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_index, rows array<array<string>>) of each table in the texts that has a row with words."""
    found = docs.select(F.col(key).alias("key"), F.posexplode(split_tables(F.col(text))["tables"]).alias("table_index", "t"))
    return found.select("key", "table_index", parsed_table(F.col("t")).alias("rows")).where(F.size("rows") > 0)


def table_description(rows: Column, most: int = 24, tags: Column | None = None) -> Column:
    """Text of a parsed table, whose first row is the header: counts, tags, then ``most`` rows of column = value."""
    say = F.lit

    def told(head: Column, body: Column) -> Column:
        cells = F.size(F.filter(F.flatten(body), lambda c: c.rlike(r"\d")))
        title = F.concat(say("Таблица содержит "), F.size(body), say(" строк и "), F.size(head), say(" столбцов: "), F.array_join(F.slice(head, 1, 12), ", "), say("."))
        numbers = F.when(cells > 0, F.concat(say("В таблице обнаружены числовые значения: "), cells, say(" ячеек с числами.")))
        related = F.when(F.size(tags) > 0, F.concat(say("Связанные доменные теги: "), F.array_join(F.slice(tags, 1, 10), ", "), say("."))) if tags is not None else F.lit(None).cast("string")
        pair = lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(" = "), v))
        shown = F.transform(F.slice(body, 1, most), lambda r, i: F.struct(F.array_join(F.zip_with(head, r, pair), "; ").alias("x"), i.alias("i")))
        listed = F.transform(F.filter(shown, lambda r: r["x"] != ""), lambda r: F.concat(say("Строка "), r["i"] + 1, say(": "), r["x"], say(".")))
        rest = F.when(F.size(body) > most, F.concat(say("Остальные строки сохранены в оригинальном табличном представлении: "), F.size(body) - most, say(".")))
        return F.concat_ws("\n", title, numbers, related, listed, rest)

    head = F.transform(F.get(rows, F.lit(0)), lambda h, i: F.when(h == "", F.concat(say("Колонка "), i + 1)).otherwise(h))
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.when(F.size(rows) == 0, "").otherwise(bind(F.struct(head.alias("h"), body.alias("b")), lambda s: told(s["h"], s["b"])))


def table_text(table: Column, tags: Column | None = None) -> Column:
    """What is stored of a table: its description and its lines."""
    description = table_description(parsed_table(table), tags=tags)
    whole = F.concat(F.lit("[Описание таблицы]\n"), description, F.lit("\n\n[Оригинальная таблица]\n"), table)
    return F.when(description == "", table).otherwise(whole)


def worth_storing(text: Column, n_tags: Column) -> Column:
    """Whether a chunk is more than a fragment: 60 characters, a term or a digit."""
    return (F.length(strip(F.regexp_replace(text, r"(?U)\s+", " "))) >= 60) | (n_tags > 0) | text.rlike(r"\d")


def with_header(metadata: list[tuple[str, Column]], text: Column) -> Column:
    """A text below its metadata, a line for each in the order given, without null and empty values."""
    head = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), v.cast("string"))) for name, v in metadata]
    return strip(F.concat(F.lit("[METADATA]\n"), F.concat_ws("\n", *head), F.lit("\n[/METADATA]\n\n"), strip(text)))
