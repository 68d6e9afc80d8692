"""Labels of any number in texts: whole words, the longest first, none overlapping one found before.

Labels that fit in a broadcast are one Aho-Corasick automaton, which goes over
each text once however many labels there are. More than that are joined: each
label is filed under its pair of neighbouring words that fewest other labels
have, texts give their distinct words and pairs, and only the labels that meet
a text so are looked for in it, again by an automaton. Either way finds the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..workspace import Workspace

#: Bytes of labels that are sent to all tasks; an automaton takes some fifty times that in a worker.
BROADCAST_BYTES = 4 << 20
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    return text.lower().replace("ё", "е")


def plain(text: str | None) -> str:
    """Folded, with runs of white space as one blank; places of matches are places in this."""
    return " ".join(fold(text or "").split())


class Labels:
    """Labels with their terms, in order of preference among labels of one length; of equal labels the first counts."""

    def __init__(self, labels: Iterable[tuple[str, str]]) -> None:
        """(label, term id)."""
        self.terms: dict[str, tuple[int, str]] = {}
        for i, (label, term) in enumerate(labels):
            if own := plain(label):
                self.terms.setdefault(own, (i, term))

    def __getstate__(self) -> dict:
        return {"terms": self.terms}  # the automaton is built anew where it is needed

    @cached_property
    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for label, (order, term) in self.terms.items():
            out.add_word(label, (-len(label), order, label, term))
        out.make_automaton()
        return out

    def find(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(term id, label, start, end) by place."""
        low = plain(text)
        if not self.terms or not low:
            return []
        seen, is_word = [], lambda c: c == "_" or c.isalnum()
        for last, (size, order, label, term) in self.automaton.iter(low):
            start, end = last + 1 + size, last + 1
            if not (start and is_word(low[start - 1])) and not (end < len(low) and is_word(low[end])):
                seen.append((size, order, start, end, label, term))
        taken, found, behind = bytearray(len(low)), [], {}
        for _, _, start, end, label, term in sorted(seen):
            if start < behind.get(label, 0):
                continue  # within a match of the same label
            behind[label] = end
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * (end - start)
                found.append((term, label, start, end))
        return sorted(found, key=lambda x: (x[2], x[3]))


def _schema(key: str, kind: str) -> str:
    return f"`{key}` {kind}, term_id string, label string, start int, end int"


def find_labels(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(key, term_id, label, start, end) of ``labels`` (term_id, label, pos) in each row of ``docs``; ``pos`` is the order among labels of one length.

    Null and empty texts and labels have no match; repeated rows of ``docs`` have theirs each.
    """
    ship_package(docs.sparkSession)
    # read twice and more, so what it takes to make them is done once
    labels = Workspace(docs.sparkSession, "labels").save(labels.where("label IS NOT NULL").select("term_id", "label", "pos"), "given")
    size = labels.agg(F.sum(F.octet_length("label") + 8)).first()[0] or 0
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows = labels.orderBy("pos", "label", "term_id").collect()
        return find_sent(docs, Labels((r.label, r.term_id) for r in rows), key, text)
    return _find_joined(docs, labels, key, text)


def find_sent(docs: DataFrame, labels: Labels, key: str, text: str = "text") -> DataFrame:
    """The same with labels that go to all tasks."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *m) for k, t in zip(pdf[key], pdf[text]) for m in sent.value.find(t)]
            yield pd.DataFrame(rows, columns=[key, "term_id", "label", "start", "end"])

    return docs.select(key, text).mapInPandas(run, _schema(key, dict(docs.dtypes)[key]))


#: One in so many texts tells how small a hash has to be to come into question.
PROBED = 64


def drawn_runs(docs: DataFrame, most: int, sizes: tuple[int, ...] = (2, 3), text: str = "text") -> DataFrame:
    """(label, h): of all distinct runs of ``sizes`` words in lower-cased texts, the ``most`` with the least MD5 ``h``, equal ones by label.

    Words of a run have one blank between them. The ``most``-th least hash of the
    runs of some texts is no less than that of all texts, so runs above it can be
    left out before they are made distinct; the result is that of all runs.
    """
    stretches = docs.select(text, F.explode(F.split(F.lower(text), r" {2,}|[^\p{L}\p{N}_ ]+")).alias("stretch"))
    words = stretches.select(text, F.split(F.trim("stretch"), " ").alias("words")).select(text, "words", F.posexplode("words").alias("i", "word"))
    at = lambda k: F.get("words", F.col("i") + k)
    runs = F.array(*(F.when(at(n - 1).isNotNull(), F.concat_ws(" ", *map(at, range(n)))) for n in sizes))
    runs = words.select(text, F.explode(runs).alias("label")).where("label <> ''").withColumn("h", F.md5("label"))
    firsts = lambda rows: rows.select("label", "h").distinct().orderBy("h", "label").limit(most)
    probe = firsts(runs.where(F.pmod(F.xxhash64(text), F.lit(PROBED)) == 0)).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
    return firsts(runs.where(F.col("h") <= probe.h) if 0 < most == probe.n else runs)


def _signs(words: list[str]) -> list[str]:
    """What a run of words can be filed under: pairs of neighbours, or the one word; nothing for labels without a word character."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])] or words or [""]


def _find_joined(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    ws = Workspace(docs.sparkSession, "terms")
    kind = dict(docs.dtypes)[key]

    def of_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["label"] = [plain(x) for x in pdf["label"]]
            pdf["signs"] = [list(dict.fromkeys(_signs(_WORD.findall(x)))) for x in pdf["label"]]
            yield pdf[pdf["label"] != ""]

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, t in zip(pdf["row"], pdf["text"]):
                words = _WORD.findall(plain(t))
                rows += [(row, sign) for sign in {"", *words, *_signs(words)}]
            yield pd.DataFrame(rows, columns=["row", "sign"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, own in zip(pdf["key"], pdf["text"], pdf["own"]):
                ordered = sorted((x["pos"], x["label"], x["term_id"]) for x in own)
                rows += [(k, *m) for m in Labels((label, term) for _, label, term in ordered).find(t)]
            yield pd.DataFrame(rows, columns=[key, "term_id", "label", "start", "end"])

    signed = labels.mapInPandas(of_labels, "term_id string, label string, pos long, signs array<string>")
    signed = ws.save(signed.groupBy("label").agg(F.min(F.struct("pos", "term_id", "signs")).alias("x")).select("label", "x.*"), "labels")
    each = signed.select("label", F.explode("signs").alias("sign"))
    rarest = each.join(each.groupBy("sign").agg(F.count("*").alias("n")), "sign").groupBy("label").agg(F.min(F.struct("n", "sign")).alias("x"))
    filed = ws.save(signed.drop("signs").join(rarest.select("label", F.col("x.sign").alias("sign")), "label"), "filed")
    rows = ws.save(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    signs = rows.select("row", "text").mapInPandas(of_texts, "row long, sign string")
    own = signs.join(filed, "sign").groupBy("row").agg(F.collect_list(F.struct("pos", "label", "term_id")).alias("own"))
    return rows.join(own, "row").select("key", "text", "own").mapInPandas(find, _schema(key, kind))
