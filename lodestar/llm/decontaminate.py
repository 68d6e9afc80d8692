"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Texts become words: lower case, without ASCII punctuation. Documents and
benchmark items are joined on shared seeds, runs of ``SEED`` (5) words. For a
document and an item that share seeds, the longest match between words that no
tile covers yet is marked as a tile, again and again, down to the length of a
seed. Tiles may come in any order, so a passage whose sentences were
rearranged is found as well. A document is contaminated by an item if tiles
cover at least ``COVERAGE`` of the item's words.

The benchmark is read in blocks of bounded size, each broadcast, held against
all documents and released; a usual benchmark is one block. All whole documents
and all whole items take part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import Workspace, spread

SEED = 5
COVERAGE = 0.5
#: UTF-8 bytes of benchmark texts that are broadcast at once.
BLOCK_BYTES = 4 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER, _PUNCTUATION).split()


class _Rolling:
    """Karp-Rabin hashes, modulo 2^64, of all windows of a sequence; the hash of each size comes from one running sum."""

    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens)
        powers = lambda base: np.cumprod(np.array([1, *[base] * n], np.uint64))
        self.tokens, self.up, down = tokens, powers(_BASE), powers(_INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((tokens + 1).astype(np.uint64) * down[:-1])])

    def windows(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the windows of ``size`` free tokens."""
        taken = np.concatenate([[0], np.cumsum(~free)])
        starts = np.nonzero(taken[size:] == taken[:-size])[0] if len(free) >= size else np.zeros(0, np.int64)
        return (self.sums[starts + size] - self.sums[starts]) * self.up[starts], starts


def _maximal(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, places: Iterable[tuple[int, np.ndarray]], size: int) -> list[tuple[int, int, int]]:
    """(-length, place in item, place in text) of the matches of at least ``size`` that can't be longer, from where windows have equal hashes.

    A match that could begin one earlier is part of another, so of a run of
    equal words there are as many as item and text have words, and not their product.
    """
    found = []
    for p, at in places:
        if p and free_i[p - 1]:
            before = np.maximum(at - 1, 0)
            at = at[(at == 0) | ~free_t[before] | (text[before] != item[p - 1])]
        n, going = np.zeros(len(at), np.int64), np.arange(len(at))
        most = len(item) - p
        for k in range(most):
            if not free_i[p + k] or not len(going):
                break
            here = at[going] + k
            going, here = going[here < len(text)], here[here < len(text)]
            going = going[(text[here] == item[p + k]) & free_t[here]]
            n[going] = k + 1
        for length, t in zip(n.tolist(), at.tolist()):
            if length >= size:  # else the hashes only happened to be equal
                found.append((-length, p, t))
    return sorted(found)


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in item, place in text) of the tiles, as they were marked.

    Negative tokens match nothing. Of matches of one length the first in the
    item is marked first, then the first in the text.
    """
    own, other = np.asarray(item, np.int64), np.asarray(text, np.int64)
    free_i, free_t = own >= 0, other >= 0
    of_item, of_text = _Rolling(own), _Rolling(other)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(own), 20))
    while True:
        hashes, starts = of_text.windows(free_t, size)
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        values, at = of_item.windows(free_i, size)
        low, high = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
        places = ((int(p), starts[a:b]) for p, a, b in zip(at, low, high) if a < b)
        found = _maximal(own, other, free_i, free_t, places, size)
        if found and -found[0][0] > 2 * size:  # so long a match speaks for a greater size
            size = -found[0][0]
            continue
        cut = False
        for minus, p, t in found:
            n = -minus
            if not (free_i[p : p + n].all() and free_t[t : t + n].all()):
                cut = True  # by a tile; what is left of it must be found anew before lesser ones
                break
            free_i[p : p + n] = free_t[t : t + n] = False
            tiles.append((n, p, t))
        if cut:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


class Decontaminator:
    """Holds one block of benchmark items: (item_id, text)."""

    def __init__(self, items: Iterable[tuple[int, str | None]], coverage: float = COVERAGE) -> None:
        self.coverage, self.ids, self.items = coverage, {}, []
        seeds: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            tokens = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if not tokens:
                continue
            # items shorter than a seed must match as a whole
            self.items.append((item_id, tokens, min(SEED, len(tokens))))
        for size in {n for _, _, n in self.items}:
            for k, (_, tokens, n) in enumerate(self.items):
                if n == size:
                    for value in self._hashes(np.array(tokens), size):
                        if not seeds[int(value)] or seeds[int(value)][-1] != k:
                            seeds[int(value)].append(k)
        self.sizes = sorted({n for _, _, n in self.items})
        self.seeds = dict(seeds)
        self.known = np.array(sorted(self.seeds), np.uint64)

    @staticmethod
    def _hashes(tokens: np.ndarray, size: int) -> np.ndarray:
        """Of all windows; windows with negative tokens are to be left out by the caller."""
        n = len(tokens) - size + 1
        value = np.full(max(n, 0), size, np.uint64)
        for i in range(size if n > 0 else 0):
            value = (value ^ tokens[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, words covered) of each item that contaminates the text, as items were given."""
        get = self.ids.get
        words = words_of(text)
        tokens = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        touched: dict[int, list[int]] = defaultdict(list)
        for size in self.sizes:
            if len(tokens) < size:
                continue
            known = np.concatenate([[0], np.cumsum(tokens >= 0)])
            starts = np.nonzero(known[size:] - known[:-size] == size)[0]
            if not len(starts):
                continue
            values = self._hashes(tokens, size)[starts]
            at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
            hit = self.known[at] == values
            for start, value in zip(starts[hit].tolist(), values[hit].tolist()):
                for k in self.seeds[value]:
                    if self.items[k][2] == size:
                        touched[k].append(start)
        found = []
        for k in sorted(touched):
            item_id, item, least = self.items[k]
            # other words lie in no seed of this item, so in no tile
            places = np.unique(np.array(touched[k])[:, None] + np.arange(least))
            gaps = np.nonzero(np.diff(places) > 1)[0] + 1
            here = np.insert(tokens[places], gaps, -1)
            if not self._may_cover(item, here.tolist(), least):
                continue
            tiles = tile(item, here, least)
            covered = sum(n for n, _, _ in tiles)
            if covered >= self.coverage * len(item):
                found.append((item_id, covered / len(item), len(tiles), covered))
        return found

    def _may_cover(self, item: list[int], here: list[int], least: int) -> bool:
        """Tiles lie within shared seeds: whether these cover enough of the item."""
        seeds = {tuple(here[i : i + least]) for i in range(len(here) - least + 1)}
        covered: set[int] = set()
        for p in range(len(item) - least + 1):
            if tuple(item[p : p + least]) in seeds:
                covered.update(range(p, p + least))
        return len(covered) >= self.coverage * len(item)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[bool, object]]:
    """Whether it is the last, and the broadcast items of each block of the benchmark; at any time one block is held."""
    items, spark = benchmark.select("item_id", "text"), benchmark.sparkSession
    n_bytes = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    for block in range(n_blocks):
        at = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.where(at).orderBy("item_id", "text").collect()])
        yield block == n_blocks - 1, shared
        if block < n_blocks - 1:  # the caller has written what it found
            shared.destroy()


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, contaminated, coverage, n_tiles, n_words) for each document (doc_id, text) and item (item_id, text) that contaminates it.

    ``contaminated`` is true in all rows; documents without rows are clean.
    Items and documents without words match nothing, null texts have none; null
    ids are ids like any other, of whatever type. Repeated rows of documents come
    back as often; repeated items too. Empty tables give an empty result.
    Documents are read once for each ``block_bytes`` of the benchmark.
    """
    types = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = f"doc_id {types['doc_id'].simpleString()}, item_id {types['item_id'].simpleString()}, contaminated boolean, coverage double, n_tiles int, n_words int"
    kind, ws, out = to_arrow_type(types["item_id"]), Workspace(docs.sparkSession, "tiles"), None
    for i, (last, shared) in enumerate(_blocks(benchmark, block_bytes)):
        found = docs.select("doc_id", "text").mapInArrow(_scan(shared, coverage, kind), schema)
        found = found if last else ws.save(found, f"block{i}")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(shared, coverage: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Decontaminator(shared.value, coverage).find
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in find(text.as_py()):
                    rows.append(i)
                    hits.append(hit)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            item, cover, tiles, words = zip(*hits) if hits else ((), (), (), ())
            columns = [ids, pa.array(item, kind), pa.array([True] * len(hits), pa.bool_()), pa.array(cover, pa.float64()), pa.array(tiles, pa.int32()), pa.array(words, pa.int32())]
            if hits:
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "contaminated", "coverage", "n_tiles", "n_words"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The clean rows of ``docs``, judged one by one by their own text, those with null or repeated ids too; null texts are clean.

    All columns stay, whatever their names. Empty tables of documents give an
    empty result, and of an empty benchmark all rows stay.
    """
    ws = Workspace(docs.sparkSession, "clean")
    for last, shared in _blocks(benchmark, block_bytes):

        @F.pandas_udf("boolean")
        def clean(texts, shared=shared):
            find = Decontaminator(shared.value).find
            return texts.map(lambda t: not find(t)).astype(bool)

        docs = docs.where(clean("text"))
        docs = docs if last else ws.save(docs, "left")
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that contaminates it; what ``find_contamination`` says of nulls, repeats and empty tables holds."""
    return find_contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
