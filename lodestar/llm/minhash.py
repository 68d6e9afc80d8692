"""Near duplicates by circulant MinHash: texts whose sets of word shingles have a Jaccard similarity of a limit or more.

Signature. Shingles are positions of a ring of 2^32. One permutation of the
ring, ``_first``, takes their order away; a second, ``_second``, is shifted
around the ring by 0, 1, ... 239 positions, and the least value that a set has
under each shift is a coordinate of its signature. So two permutations make all
coordinates. They form 40 bands of six; a pair of similarity 0.8 has no band in
common with a chance of (1 - 0.8^6)^40 < 6e-6.

Candidates. Texts with one set are one node. Nodes with a band in common form a
block, and a block's centre is its node that meets most others over all its
blocks. Each node is first compared with the centre that it meets most, which
joins nearly all that belongs together. Blocks with one centre are one group;
a group whose nodes are still in several components is looked at again, but
for pairs within its greatest component. It is dealt out in cells of bounded
bytes, in which a positional prefix filter over the whole sets finds the pairs
that can be alike: shingles are ordered by how few of the cell have them, and
two sets that are alike share one of their first few. A cell returns at most
one link for each two components that it joins, so pairs, of which a template
has the square of its texts, never become rows, and no pair is left out.

Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..workspace import Workspace, spread

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 40, 6
#: Bytes of sets in one part of a group (a cell has one or two), in the cells that a task takes at once, and on either side of a grid's cell.
PART_BYTES, TASK_BYTES, GRID_BYTES = 4 << 20, 16 << 20, 2 << 20
#: Shingles whose coordinates are computed at once; bounds the memory for very long texts.
CHUNK = 1 << 8
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)
_MIX = np.random.default_rng(7).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_LINKS = "src long, dst long"


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of the columns, in their order."""
    out = np.zeros(len(columns[0]), np.uint64)
    for i, x in enumerate(columns):
        out = (out ^ x.astype(np.uint64)) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    return out


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased; white space is \\x20 and \\x09-\\x0D."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of all words as one where there are fewer; empty without words."""
    if 0 < len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], np.uint64)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    return np.unique(_mixed([h[i : len(h) - width + 1 + i] for i in range(width)]))


def shingle_count(words: list[bytes], width: int) -> int:
    """How many distinct shingles there are, compared word by word."""
    return len(set(zip(*(words[i:] for i in range(width))))) if len(words) >= width else min(1, len(words))


def _first(x: np.ndarray) -> np.ndarray:
    """A permutation of the ring of 2^32."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x2C1B3C6D)


def _second(x: np.ndarray) -> np.ndarray:
    """Another one, in place: each step can be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(found: np.ndarray) -> np.ndarray:
    """All coordinates of a set: the least value of the second permutation under each shift."""
    places = _first((found >> np.uint64(32)).astype(np.uint32))
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), CHUNK):
        np.minimum(least, _second(places[i : i + CHUNK, None] + _SHIFTS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, signed; keys of different bands differ."""
    rows = least.reshape(BANDS, ROWS)
    return _mixed([np.arange(BANDS), *(rows[:, i] for i in range(ROWS))]).view(np.int64)


def signed(docs: DataFrame, width: int, count: bool = False, fingerprint: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``docs`` (any columns, the last one the text) with ``node``, a digest of its set, ``n``, its size, and band ``keys``, null for an empty set, for the text.

    With ``count`` the size is that of the set of word tuples, else of the set of their hashes.
    ``fingerprint`` makes a column ``fp`` of the set's hashes, null for an empty set.
    """
    kept = [f"`{c}` {kind}" for c, kind in docs.dtypes[:-1]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                names = batch.schema.names
                digests, sizes, keys, prints = [], [], [], []
                for text in batch.column(len(names) - 1):
                    words = words_of(text.as_py())
                    found = shingle_set(words, width)
                    digests.append(xxhash.xxh3_128_hexdigest(found.astype("<u8").tobytes()))
                    sizes.append(shingle_count(words, width) if count else len(found))
                    keys.append(band_keys(signature(found)) if len(found) else None)
                    prints.append(fingerprint(found) if fingerprint and len(found) else None)
                made = [pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                if fingerprint:
                    made.append(pa.array(prints, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*names[:-1], *added])

    columns = ["node string", "n long", "keys array<long>", *(["fp long"] if fingerprint else [])]
    added = [c.split()[0] for c in columns]
    return docs.mapInArrow(sign, ", ".join([*kept, *columns]))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, shingles) of ``docs`` (id, text): the sorted set as 64-bit integers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(words_of(t.as_py()), width) for t in batch.column(1)]
            columns = [pa.array(map(len, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "shingles"])

    return docs.mapInArrow(sets, "id long, n long, shingles binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def _confirmed(percent: int):
    """Of a grid's cell, those pairs that are alike enough; the rows without a pair have the sets."""

    def confirm(table: pa.Table) -> pa.Table:
        sets, src, dst = {}, [], []
        alone = pc.is_null(table["dst"])
        own, pairs = table.filter(alone), table.filter(pc.invert(alone))
        for a, found in zip(own["src"].to_pylist(), own["shingles"]):
            sets[a] = np.frombuffer(found.as_buffer(), np.uint64)
        for a, b in zip(pairs["src"].to_pylist(), pairs["dst"].to_pylist()):
            both = common(sets[a], sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                src.append(a)
                dst.append(b)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, side: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets in ``sets`` (id, shingles) are alike enough.

    Pairs are laid on a grid of ``side`` x ``side`` cells by the hashes of both
    ends; a set goes once to each cell that has a pair with it, and not to each pair.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    pairs = pairs.select((at("src") * side + at("dst")).alias("cell"), "src", "dst")
    ends = pairs.select("cell", F.explode(F.array("src", "dst")).alias("id")).distinct()
    shipped = ends.join(sets, "id").select("cell", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "shingles")
    both = shipped.unionByName(pairs.withColumn("shingles", F.lit(None).cast("binary")))
    return both.groupBy("cell").applyInArrow(_confirmed(percent), _LINKS)


class _Cell:
    """Sets of one cell, by size, with their shared shingles as numbers, the rarest first."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.n = percent, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        row = np.repeat(np.arange(len(sets)), self.n)
        shared = count[code] > 1  # what no other set of the cell has can't be in common, and stands first
        row, code = row[shared], rank[code[shared]]
        order = np.lexsort((code, row))
        self.flat, row = code[order], row[order]
        self.vocabulary = len(count)
        size = np.bincount(row, minlength=len(sets))
        self.start = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(len(row)) - self.start[row] + (self.n - size)[row]
        most = self.n[row]
        within = place < most - -(-2 * percent * most // (100 + percent)) + 1  # prefix of a set that is looked for, by a set of its size at least
        self.posted = np.sort(self.flat[within] * len(sets) + row[within])
        self.probes = np.bincount(row[place < most - -(-percent * most // 100) + 1], minlength=len(sets))
        self.marked = np.zeros(self.vocabulary, bool)

    def alike(self, x: int, wanted: np.ndarray) -> np.ndarray:
        """Rows before x that are alike and ``wanted``."""
        low = int(np.searchsorted(self.n[:x], -(-self.percent * self.n[x] // 100)))
        probe = self.flat[self.start[x] : self.start[x] + self.probes[x]] * len(self.n)
        if low == x or not len(probe) or not wanted[low:x].any():
            return np.zeros(0, np.int64)
        begin, end = np.searchsorted(self.posted, probe + low), np.searchsorted(self.posted, probe + x)
        if not (end > begin).any():
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.n), bool)
        hit[self.posted[_ranges(begin, end)] % len(self.n)] = True
        rows = np.flatnonzero(hit & wanted)
        if not len(rows):
            return rows
        own = self.flat[self.start[x] : self.start[x + 1]]
        self.marked[own] = True
        size = self.start[rows + 1] - self.start[rows]
        both = np.add.reduceat(self.marked[self.flat[_ranges(self.start[rows], self.start[rows + 1])]].astype(np.int64), np.cumsum(size) - size)
        self.marked[own] = False
        return rows[100 * both >= self.percent * (self.n[rows] + self.n[x] - both)]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0], ... end[0] - 1, begin[1], ... in a row."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def cell_links(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what all links between the rows of a cell join, one for each join.

    Where a cell has two sides, only pairs with an end on either count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    _, own = np.unique(roots[order], return_inverse=True)
    cell, two, links = _Cell(sets, percent), sides.min() != sides.max(), []
    for x in range(1, len(ids)):
        wanted = own != own[x]
        if two:
            wanted &= sides != sides[x]
        for y in cell.alike(x, wanted):
            if own[y] != own[x]:
                links.append((int(ids[x]), int(ids[y])))
                own[own == own[y]] = own[x]
    return links


def _cells(percent: int):
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("centre", "ascending"), ("a", "ascending"), ("b", "ascending")])
        centre, a, b, ids, roots, sides = (table[c].to_numpy() for c in ("centre", "a", "b", "id", "root", "side"))
        ends = [*(np.flatnonzero((centre[1:] != centre[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(ids)]
        found, start = [], 0
        for end in ends:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].slice(start, end - start)]
            found += cell_links(ids[start:end], roots[start:end], sides[start:end], sets, percent)
            start = end
        return pa.table({"src": pa.array([x for x, _ in found], pa.int64()), "dst": pa.array([y for _, y in found], pa.int64())})

    return link


def _dealt(groups: DataFrame, ws: Workspace) -> DataFrame:
    """Cells (centre, a, b, id, root, side) of ``groups`` (centre, id, root, bytes): all pairs of a group but those within its greatest component."""
    sizes = groups.groupBy("centre", "root").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
    top = F.max(F.struct("c", "root", "bytes")).alias("top")
    per = sizes.groupBy("centre").agg(top, F.sum("bytes").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / PART_BYTES)).cast("int")
    per = per.select("centre", F.col("top.root").alias("main"), parts(F.col("top.bytes")).alias("mains"), parts(F.col("all") - F.col("top.bytes")).alias("rests"))
    per = ws.save(per, "mixed")  # so that the join below is of two tables, of which a large group can be split
    rows = groups.join(per, "centre").withColumn("hash", F.xxhash64("id"))
    part = lambda n: F.pmod("hash", n).cast("int")
    to = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    # parts of the rest are 0, 1, ...; those of the greatest component -1, -2, ...
    own, other = part(F.col("rests")), F.sequence(F.lit(0), F.col("rests") - 1)
    among = F.transform(other, lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), (own > j).cast("int").alias("side")))
    beside = F.transform(F.sequence(F.lit(1), F.col("mains")), lambda k: to(own, -k, 0))
    main = F.transform(other, lambda j: to(j, -1 - part(F.col("mains")), 1))
    cells = F.when(F.col("root") == F.col("main"), main).otherwise(F.concat(among, beside))
    return rows.select("centre", "id", "root", "bytes", F.inline(cells))


def alike_components(nodes: DataFrame, sets_of, percent: int, ws: Workspace, candidates: DataFrame | None = None) -> DataFrame:
    """(id, root) of those of ``nodes`` (id, n, keys) that are alike to another, by any chain: the smallest id reached.

    ``sets_of`` takes a table (id) and gives (id, n, shingles) of these. ``candidates``
    (src, dst) of another search are confirmed with the stars, before the cells are made.
    """
    entries = nodes.select("id", F.explode("keys").alias("key"))
    shared = ws.save(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = ws.save(entries.join(shared, "key"), "members")
    wanted = members.select("id")
    if candidates is not None:
        wanted = wanted.unionByName(candidates.select(F.explode(F.array("src", "dst")).alias("id")))
    sets = ws.save(sets_of(wanted.distinct()), "sets")
    side = max(1, -(-8 * (sets.agg(F.sum("n")).first()[0] or 0) // GRID_BYTES))

    weighed = members.join(members.groupBy("id").agg(F.sum("size").alias("weight")), "id")
    centres = ws.save(weighed.groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("centre")), "centres")
    meetings = ws.save(members.join(centres, "key").groupBy("id", "centre").agg(F.count("*").alias("times")), "meetings")
    for name in ("shared", "members", "centres"):
        ws.drop(name)
    most = meetings.where("id <> centre").groupBy("id").agg(F.max(F.struct("times", "centre")).alias("most"))
    stars = most.select(F.col("id").alias("src"), F.col("most.centre").alias("dst"))
    if candidates is not None:
        ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        stars = stars.select(*ends).unionByName(candidates.select(*ends)).distinct()
    stars = ws.save(stars, "stars of centres")
    links = ws.save(confirmed(stars, sets, side, percent), "links")
    roots = ws.save(connected_components(links, ws), "roots")

    placed = meetings.join(sets.select("id", (8 * F.col("n")).alias("bytes")), "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    groups = ws.save(placed.select("centre", "id", F.coalesce("root", "id").alias("root"), "bytes"), "groups")
    cells = ws.save(_dealt(groups, ws), "cells")
    tasks = max(1, -(-(cells.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    shipped = cells.drop("bytes").join(sets.drop("n"), "id").withColumn("task", F.pmod(F.xxhash64("centre", "a", "b"), F.lit(tasks)))
    more = shipped.groupBy("task").applyInArrow(_cells(percent), _LINKS)
    links = ws.save(links.unionByName(more), "links")
    for name in ("meetings", "stars of centres", "groups", "mixed", "cells", "sets"):
        ws.drop(name)
    return ws.save(connected_components(links, ws), "roots").withColumnRenamed("node", "id")


def minhash_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text, or one without words, has an empty set and links with
    nothing. A row with null doc_id takes part in no link; its component_id is null
    and it is kept. Repeated rows come back as often, and rows that share a doc_id
    link by their texts like any others. An empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "minhash")
    kind = dict(docs.dtypes)["doc_id"]
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = signed(docs.select("doc_id", digest.alias("digest"), "text"), shingle, count=True)
    rows = ws.save(rows.select(F.col("doc_id").cast(kind), "digest", "node", "n", "keys"), "rows")
    firsts = [F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")]
    nodes = rows.where("doc_id IS NOT NULL AND keys IS NOT NULL").groupBy("node").agg(*firsts)
    nodes = ws.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # from here on ids are fixed
    own = docs.where("doc_id IS NOT NULL").select("doc_id", digest.alias("digest"), "text")

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = nodes.join(wanted, "id").select("id", "rep.*")
        return full_sets(own.join(reps, ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "text"), shingle)

    roots = alike_components(nodes.select("id", "n", "keys"), sets_of, percent, ws)
    of = ws.save(nodes.join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root"), F.col("rep.doc_id").alias("doc_id")), "of")
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = ws.save(of.join(least, "root").select("node", "component_id"), "components")
    out = rows.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``minhash_components`` of all documents: two-word shingles, similarity 0.8."""
    return minhash_components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
