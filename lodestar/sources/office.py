"""Readers of office files and PDFs with the standard library: the XML inside the archives, and the text operators of PDF pages.

Each takes content and file name and gives objects (type, text, page). The old
binary formats (doc, xls, ppt) and encrypted or scanned PDFs need a plug-in.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

Object = tuple[str, str, int | None]
MOST_TABLE_CHARS = 6000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data[:2000]:
        raise ValueError(f"{name} declares a document type")  # entities could grow without bound
    return ElementTree.fromstring(data)


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _runs(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if _local(x.tag) == "t":
            out.append(x.text or "")
        elif _local(x.tag) in ("tab", "br", "cr"):
            out.append(" ")
    return "".join(out).strip()


def _grid(table: ElementTree.Element) -> list[list[str]]:
    return [[" ".join(_runs(c).split()) for c in row if _local(c.tag) == "tc"] for row in table.iter() if _local(row.tag) == "tr"]


def docx(content: bytes, name: str) -> list[Object]:
    """Paragraphs, parted by blank lines, as one text, and each table as markdown."""
    from .readers import markdown_table

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(x for x in _xml(z, "word/document.xml") if _local(x.tag) == "body")
    paragraphs = [t for x in body if _local(x.tag) == "p" and (t := _runs(x))]
    tables = [markdown_table(_grid(x))[:MOST_TABLE_CHARS] for x in body if _local(x.tag) == "tbl"]
    return [("text", "\n\n".join(paragraphs), None), *(("table", t, None) for t in tables)]


def pptx(content: bytes, name: str) -> list[Object]:
    """A text for each slide, its number as page."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i, slide in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            lines = [t for x in _xml(z, slide).iter() if _local(x.tag) == "p" and (t := _runs(x))]
            out.append(("text", "\n".join(lines), i))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes, name: str) -> list[Object]:
    """Each sheet as a markdown table."""
    from .readers import markdown_table

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_runs(x) for x in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        for sheet in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for row in (x for x in _xml(z, sheet).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for at, cell in enumerate(x for x in row if _local(x.tag) == "c"):
                    value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
                    kind = cell.get("t")
                    text = shared[int(value)] if kind == "s" and value else _runs(cell) if kind == "inlineStr" else value
                    cells[_column(cell.get("r")) if cell.get("r") else at] = text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append(("table", markdown_table(rows), None))
    return out


# PDF

_STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.S)
_ESCAPES = {"n": "\n", "r": "\n", "t": "\t", "b": "", "f": "", "\n": "", "\r": ""}


def _objects(data: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[2] for m in _STREAM.finditer(data)}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1] if b"/Filter" not in body[: m.start()] else b""


def _literal(raw: bytes) -> str:
    text = raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    text = re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m[1], 8) & 255), text)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def _shown(stream: bytes) -> Iterator[str]:
    """What the text operators of a page show, with line breaks where they move."""
    token = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]+>|\[|\]|[-+]?\d*\.?\d+|T[JjdDm*]|'|\"|\bET\b", re.S)
    strings, inside = [], False
    for m in token.finditer(stream):
        t = m[0]
        if t[:1] == b"(":
            strings.append(_literal(t[1:-1]))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            strings.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace"))
        elif t in (b"[", b"]"):
            inside = t == b"["
        elif inside and re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            if float(t) < -200:  # a wide move to the right within an array is a blank
                strings.append(" ")
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            yield ("\n" if t in (b"'", b'"') else "") + "".join(strings)
            strings = []
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            strings = []
            yield "\n"


def pdf(content: bytes, name: str) -> list[Object]:
    """A text for each page with text operators; no text for scans and for fonts with encodings of their own."""
    if b"/Encrypt" in content[-4096:]:
        raise ValueError("encrypted")
    known = _objects(content)
    for body in list(known.values()):  # objects that stand in compressed streams
        if b"/ObjStm" in body:
            data, first, n = _stream(body), re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
            if data and first and n:
                numbers = list(map(int, data[: int(first[1])].split()[: 2 * int(n[1])]))
                places = [*numbers[1::2], len(data) - int(first[1])]
                for key, start, end in zip(numbers[::2], places, places[1:]):
                    known.setdefault(key, data[int(first[1]) + start : int(first[1]) + end])
    out = []
    pages = [body for _, body in sorted(known.items()) if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    for i, page in enumerate(pages, 1):
        m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", page)
        refs = [int(x) for x in (re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m[1] is not None else [m[2]])] if m else []
        text = "".join("".join(_shown(_stream(known.get(r, b"")))) for r in refs).replace("\xa0", " ")
        lines = [" ".join(x.split()) for x in text.split("\n")]
        out.append(("text", "\n".join(x for x in lines if x), i))
    return out


def whole_text(objects: list[Object]) -> str:
    """The pages of a document one after the other."""
    return "\n".join(text for _, text, _ in objects)


PARSERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf}
