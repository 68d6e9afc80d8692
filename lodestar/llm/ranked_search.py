"""Ranked lexical search of a set of queries over all documents, by WAND in shards of documents.

One pass over the texts counts terms and keeps, for each document, its length
and the frequencies of the terms that some query has. Shards are cut from the
rows that a task reads, by postings, so nothing is shuffled for them. A shard
sorts its documents by id, and each term's postings are grouped in windows of
documents.

WAND. For one query, each term has a cursor on its next window and a maximum
impact over the shard. In order of their windows, the terms' maxima are added
until they beat the score that the query's heap asks for: there is the pivot.
Windows before it hold no document that can enter the heap and the cursors
leap over them. In the pivot window the same test is made for each document at
once: a document is scored only if the maxima of the terms that it holds beat
the heap.

Shard heaps are merged by query. So that a shard returns only what can still
count, a thirty-second of the documents, drawn by hash, is searched first: the
score of a query's last hit there is a lower bound for all, and heaps begin
with it. That changes no result, and the rows that are merged stay at about 32
times the hits, whatever the number of shards.

Queries come in blocks of bounded size; each is held against all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace, spread

TOP = 50
#: Bytes of queries in one block: their terms are sent to all tasks.
BLOCK_BYTES = 4 << 20
#: Postings and documents of a shard at most, and documents of a window.
SHARD_POSTINGS, SHARD_DOCS, WINDOW = 1 << 21, 1 << 16, 128
#: One document of so many is searched first.
PILOT = 32
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes, A-Z lower-cased


def terms_of(text: bytes | None) -> list[bytes]:
    return _TERM.findall((text or b"").lower())


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What each posting adds to a score, in 64-bit integers."""
    m = 50 + (50 * length * docs) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """Postings of some documents, by term and window."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, impact: np.ndarray) -> None:
        """Postings: term, row of the document within the shard, impact."""
        order = np.lexsort((rows, terms))
        terms, self.rows, self.impact = terms[order], rows[order], impact[order]
        window = self.rows // WINDOW
        cut = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (window[1:] != window[:-1])])) if len(terms) else np.zeros(0, np.int64)
        self.starts = np.append(cut, len(terms)).tolist()
        self.windows = window[cut].tolist()
        own = terms[cut]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        self.lists = dict(zip(own[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(own)])))
        at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else cut
        self.most = dict(zip(terms[at].tolist(), np.maximum.reduceat(self.impact, at).tolist() if len(at) else []))

    def search(self, query: list[int], least: int, top: int) -> list[tuple[int, int]]:
        """(score, row) of the ``top`` best rows with a score of ``least`` or more; of equal scores the first rows."""
        cursors = []  # (window, place in windows, end, maximum impact)
        for t in query:
            if t in self.lists:
                at, end = self.lists[t]
                cursors.append((self.windows[at], at, end, self.most[t]))
        heap: list[tuple[int, int]] = []  # score, -row: the least is the one to beat
        beat = least - 1
        while cursors:
            cursors.sort()
            bound = 0
            for window, _, _, most in cursors:
                bound += most
                if bound > beat:
                    break
            else:
                break  # all terms together can't beat the heap
            pivot, moved, here = window, [], []
            for cursor in cursors:
                if cursor[0] < pivot:
                    at = bisect_left(self.windows, pivot, cursor[1], cursor[2])
                    if at == cursor[2]:
                        continue
                    cursor = (self.windows[at], at, cursor[2], cursor[3])
                if cursor[0] == pivot:
                    here.append(cursor)
                    if cursor[1] + 1 < cursor[2]:
                        moved.append((self.windows[cursor[1] + 1], cursor[1] + 1, cursor[2], cursor[3]))
                else:
                    moved.append(cursor)
            cursors = moved
            if sum(c[3] for c in here) > beat:
                for score, row in self._window(pivot, here, beat):
                    if len(heap) < top:
                        heapq.heappush(heap, (score, -row))
                    elif score > heap[0][0]:
                        heapq.heapreplace(heap, (score, -row))
                    if len(heap) == top:
                        beat = max(beat, heap[0][0])
        return [(score, -row) for score, row in heap]

    def _window(self, pivot: int, here: list[tuple[int, int, int, int]], beat: int) -> list[tuple[int, int]]:
        """(score, row) of a window's documents that can beat ``beat`` and do so."""
        spans = [slice(self.starts[at], self.starts[at + 1]) for _, at, _, _ in here]
        rows = np.concatenate([self.rows[s] for s in spans]) - pivot * WINDOW
        bound = np.zeros(WINDOW, np.int64)
        for (_, _, _, most), s in zip(here, spans):
            bound[self.rows[s] - pivot * WINDOW] += most  # a document holds a term once
        able = bound > beat
        if not able.any():
            return []
        impact, kept = np.concatenate([self.impact[s] for s in spans]), able[rows]
        score = np.zeros(WINDOW, np.int64)
        np.add.at(score, rows[kept], impact[kept])
        found = np.flatnonzero(score > beat)
        return list(zip(score[found].tolist(), (found + pivot * WINDOW).tolist()))


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of each of ``docs`` (doc_id, text) that has a term; terms by their number in ``vocabulary``, a broadcast dictionary."""
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(text)
                own = Counter(filter(None.__ne__, map(known.get, found)))
                lengths.append(len(found))
                terms.append(list(own))
                tfs.append(list(own.values()))
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(lengths) > 0))

    return docs.mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _hits(postings: DataFrame, block, top: int) -> DataFrame:
    """(query, doc_id, score): the heaps of all shards. ``block``: broadcast (queries as lists of terms, least score of each, weights, documents, terms in all)."""
    kind = dict(postings.dtypes)["doc_id"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, size = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                docs += part.num_rows
                size += len(part.column(2).flatten())
                if docs >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield pa.Table.from_batches(held)
                    held, docs, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least, weight, docs, total = block.value
        for table in shards(batches):
            table = table.sort_by([("doc_id", "ascending")])  # equal scores: the smaller id first; nulls come last
            sizes = table["terms"].combine_chunks().value_lengths().to_numpy()
            rows = np.repeat(np.arange(table.num_rows), sizes)
            terms, tfs = (table[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
            impact = impacts(weight[terms], tfs, table["n"].to_numpy()[rows], docs, total)
            shard = Shard(terms, rows, impact)
            found = [(q, row, score) for q, query in enumerate(queries) for score, row in shard.search(query, least[q], top)]
            if found:
                q, row, score = map(list, zip(*found))
                ids = table["doc_id"].combine_chunks().take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids, pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    hits = postings.mapInArrow(search, f"query int, doc_id {kind}, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, ws: Workspace | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``items`` (item_id, text) its ``top`` best ``docs`` (doc_id, text).

    Null and empty texts have no terms: such documents are found by no item and not
    counted, such items find nothing. Equal scores go by doc_id, null last; repeated
    documents are found one by one. Equal rows of items count once, and items that share
    an item_id, or have none, each have their hits. Empty tables give an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "search")
    items = ws.save(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, -(-size // BLOCK_BYTES)), None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", F.col("text").cast("binary").alias("text")).collect()
        found = _block(docs.select("doc_id", "text"), [(r.item, bytes(r.text or b"")) for r in rows], top, ws, b)
        out = found if out is None else out.unionByName(found)
    return out.join(items, "item").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: list[tuple[int, bytes]], top: int, ws: Workspace, number: int) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    queries = [[numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(terms_of(text))] for _, text in items]
    vocabulary = spark.sparkContext.broadcast(numbers)
    where = ws.path(f"postings{number}")
    pilot = F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0
    _postings(docs, vocabulary).withColumn("pilot", pilot).write.partitionBy("pilot").parquet(where)
    vocabulary.unpersist()
    kind = dict(docs.dtypes)["doc_id"]
    postings = spark.read.schema(f"doc_id {kind}, n long, terms array<int>, tfs array<long>, pilot boolean").parquet(where)
    n_docs, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.array([term_weight(n_docs, 0)] * len(numbers), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[r.t] = term_weight(n_docs, r["count"])

    def run(rows: DataFrame, least: list[int], name: str) -> DataFrame:
        block = spark.sparkContext.broadcast((queries, least, weight, n_docs, max(total, 1)))
        found = ws.save(_hits(rows.drop("pilot"), block, top), f"{name}{number}")
        block.unpersist()
        return found

    least = [1] * len(items)
    for r in run(postings.where("pilot"), least, "pilot hits").where(F.col("rank") == top).collect():
        least[r["query"]] = max(1, r.score)
    found = run(postings, least, "hits")
    order = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(items)], "query int, item long")
    return found.join(F.broadcast(order), "query").drop("query")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ranked_search`` of all benchmark items over all documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
