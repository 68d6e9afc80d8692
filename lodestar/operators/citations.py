"""Reference lists in documents: where they are, the single citations, and what kind of work a citation is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_vote
from ..session import ship_package

# Headings of lists of references, headings of large sections, and how an entry begins.
HEADERS = ["references?", "bibliography", "works cited", "список литературы", "литература", "использованные источники", "источники"]
SECTION_START = r"^\s*(?:приложение|application|appendix|chapter|глава|section)\b"
ENTRY_START = r"^\s*(?:\[\d+\]|\d+\.\s|\d+\)\s|[•\-–]\s)"
#: Entries of so many characters and fewer are none.
SHORT = 5
_HEADER, _SECTION, _ENTRY = re.compile(rf"\b(?:{'|'.join(HEADERS)})\b", re.I), re.compile(SECTION_START, re.I | re.M), re.compile(ENTRY_START, re.M)
# Words of reference works.
GUIDE_WORDS = ["справочник", "словарь", "энциклопедия", "глоссарий", "handbook", "dictionary", "encyclopedia", "guide", "glossary"]


def reference_blocks(text: str | None) -> list[str]:
    """What follows each header, up to the next one or to the next large section."""
    _, *after = _HEADER.split(text or "")
    return [b for b in (_SECTION.split(part)[0].strip() for part in after) if b]


def split_citations(block: str) -> list[str]:
    """Entries of over five characters: a line that begins one, and those that go on; what comes before the first is one too."""
    entries: list[list[str]] = []
    for line in filter(None, map(str.strip, block.replace("\r", "\n").split("\n"))):
        if _ENTRY.match(line) or not entries:
            entries.append([line])
        else:
            entries[-1].append(line)
    joined = (" ".join(_ENTRY.sub("", " ".join(lines), count=1).split()) for lines in entries)
    return [c for c in joined if len(c) > SHORT]


def extract_citations(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, citation_id, citation_text): each citation of a document once, whatever its case, numbered from 1."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                unique = {c.lower(): c for b in reversed(reference_blocks(t)) for c in reversed(split_citations(b))}
                rows += [(k, i + 1, c) for i, c in enumerate(reversed(unique.values()))]
            yield pd.DataFrame(rows, columns=[key, "citation_id", "citation_text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, citation_id int, citation_text string")


def guide_class(text: Column) -> Column:
    """Reference works by language of the citation, ru_guide, en_guide or other_guide, and not_guide for all else; null texts are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    guide, language = low.rlike("|".join(GUIDE_WORDS)), language_vote(text)
    of_language = F.when(language == "ru", "ru_guide").when(language == "en", "en_guide").otherwise("other_guide")
    return F.when(guide, of_language).otherwise("not_guide")


def classified_csv(spark, path: str, out: str) -> DataFrame:
    """Reads citations (citation_text) from a CSV, writes each class of reference works below ``out`` as a CSV of its own, and gives all rows."""
    from ..sources.readers import read_csv, write_csv

    rows = read_csv(spark, path, required=("citation_text",))
    rows = rows.withColumn("language", language_vote("citation_text")).withColumn("class_label", guide_class(F.col("citation_text")))
    for label in ("ru_guide", "en_guide", "other_guide"):
        write_csv(rows.where(F.col("class_label") == label), f"{out.rstrip('/')}/{label}")
    return rows


def citations_csv(files: DataFrame, out: str) -> DataFrame:
    """Citations of documents (relative_path, text) as a CSV of pdf_name, citation_id and citation_text; gives them too."""
    from ..sources.readers import write_csv

    name = F.element_at(F.split("relative_path", "/"), -1)
    found = extract_citations(files.select(name.alias("pdf_name"), "text"), "pdf_name")
    write_csv(found, out)
    return found
