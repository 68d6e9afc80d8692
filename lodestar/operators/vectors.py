"""Nearest vectors by cosine for any number of questions: an inverted file of cells, with bounds that make it exact.

Vectors are filed under the nearest of a few hundred centres, with their angle to
it. A cell's greatest angle bounds how near a vector in it can be to a question, so
cells that can't hold one of the nearest are never read. Questions first look
into the cells whose centres are nearest, and then, unless told not to, into
all others whose bound reaches the k-th best found. Questions meet vectors in
blocks of bounded size on both sides, of which each returns its k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace

#: Cells of an index at most, and sampled vectors for each, by which centres are placed; both bound what the driver holds.
MAX_CELLS, SAMPLE = 1024, 32
ROUNDS, SEED, PROBE = 10, 7, 8
#: Bytes of vectors, as doubles, on either side of a block.
BLOCK_BYTES = 16 << 20
#: Similarities are told apart by four digits; bounds are held against them with this much to spare.
SPARE = 1e-4


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: id, vector, cell; ``cells``: cell, n, radius, centre. Both are plain tables that can be stored and read again."""

    rows: DataFrame
    cells: DataFrame


def unit_rows(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of length one; zeros for nulls, vectors of another size, and those that are zero or not finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), size))
    right = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    fit = right.to_numpy(zero_copy_only=False)
    if fit.any():
        out[fit] = column.filter(right).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norms = np.sqrt((out * out).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    out[~good] = 0
    out[good] /= norms[good, None]
    return out


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from seeded starts; a centre that loses all its vectors stays where it is."""
    sample = sample[sample.any(axis=1)]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    at = sample[np.random.default_rng(SEED).permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        nearest = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        at = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], at)
    return at


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, ws: Workspace | None = None) -> VectorIndex:
    """An index over every row of ``vectors``; centres are placed by ``sample`` vectors a cell, those of least key hash.

    As many cells as the root of the rows, ``MAX_CELLS`` at most. The size that most
    vectors have is the index's; null vectors and those of other sizes, zeros too,
    are 0 alike to everything. Rows with null key are left out, repeated keys come
    back as often. Other columns are ignored, and an empty table gives an empty index.
    """
    ws = ws or Workspace(vectors.sparkSession, "vectors")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    n, size = rows.agg(F.count("*"), F.mode(F.when(F.size("vector") > 0, F.size("vector")))).first()
    size = size or 1
    cells = cells or min(MAX_CELLS, max(1, int(n**0.5)))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(cells * sample).toArrow()
    centres = _centres(unit_rows(first["vector"], size), cells)
    kind = dict(rows.dtypes)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = unit_rows(batch.column(1), size) @ centres.T
            cell = like.argmax(axis=1)
            angle = np.arccos(np.clip(like[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], ["id", "vector", "cell", "angle"])

    filed = rows.mapInArrow(file, f"id {kind['id']}, vector {kind['vector']}, cell int, angle double")
    # a range of (cell, hash) a partition: cells lie together, and a large one is split
    spread = F.xxhash64("id")
    filed = ws.save(filed.repartitionByRange("cell", spread).sortWithinPartitions("cell"), "vectors")
    at = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    held = filed.groupBy("cell").agg(F.count("*").alias("n"), (F.max("angle") + 1e-6).alias("radius"))
    return VectorIndex(filed.drop("angle"), ws.save(held.join(F.broadcast(at), "cell"), "cells"))


def _reach(index: VectorIndex, asked: DataFrame) -> tuple[DataFrame, int] | None:
    """(query, cell, bound, place) of each of ``asked`` (query, asked) and each cell: what is possible there, and how near its centre is among all; and the vectors' size. None without cells."""
    cells = index.cells.orderBy("cell").collect()  # MAX_CELLS at most
    if not cells:
        return None
    centres, radii, numbers = np.array([c.centre for c in cells]), np.array([c.radius for c in cells]), np.array([c.cell for c in cells])
    size = centres.shape[1]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = unit_rows(batch.column(1), size) @ centres.T
            bound = np.cos(np.minimum(np.pi, np.maximum(0, np.arccos(np.clip(like, -1, 1)) - radii)))
            place = np.argsort(np.argsort(-like, axis=1, kind="stable"), axis=1)
            rows = np.repeat(np.arange(len(like)), len(numbers))
            made = [pa.array(np.tile(numbers, len(like)), pa.int32()), pa.array(bound.ravel()), pa.array(place.ravel(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *made], ["query", "cell", "bound", "place"])

    return asked.mapInArrow(bounds, f"query {dict(asked.dtypes)['query']}, cell int, bound double, place int"), size


def nearest_batch(index: VectorIndex, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", probe: int = PROBE, exact: bool = True, ws: Workspace | None = None) -> DataFrame:
    """(query, id, similarity, rank): for each of ``queries`` the k vectors nearest by cosine, to four digits, ties by id.

    Without ``exact`` only the ``probe`` cells with the nearest centres are looked
    into; ``probe_for`` measures how many a recall takes. Queries without a vector, or with one of another size, are 0 alike to all.
    Queries with null key are left out; keys of queries are distinct.
    """
    ws = ws or Workspace(queries.sparkSession, "nearest")
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("asked"))
    made = _reach(index, asked)
    if made is None:
        q, i = dict(asked.dtypes)["query"], dict(index.rows.dtypes)["id"]
        return asked.sparkSession.createDataFrame([], f"query {q}, id {i}, similarity double, rank int")
    reach, size = ws.save(made[0], "bounds"), made[1]
    best = ws.save(_best(_scanned(index, asked, reach.where(F.col("place") < probe), k, size), k), "best")
    if exact:
        last = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("least"))
        more = reach.where(F.col("place") >= probe).join(last, "query", "left").where(F.col("bound") + SPARE >= F.coalesce("least", F.lit(-2.0)))
        found = _scanned(index, asked, more, k, size).unionByName(best.drop("rank"))
        best = ws.save(_best(found, k), "best")
    return best


def probe_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.9, key: str = "vec_id", vector: str = "embedding", sample: int = 100) -> int:
    """How many cells hold that share of the k nearest, as measured for ``sample`` of ``queries``, those of least key hash. 0 without any."""
    some = queries.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample)
    made = _reach(index, some.select(F.col(key).alias("query"), F.col(vector).alias("asked")))
    if made is None:
        return 0
    true = nearest_batch(index, some, k, key, vector).select("query", "id").join(index.rows.select("id", "cell"), "id")
    places = true.join(made[0], ["query", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # MAX_CELLS at most
    held, wanted = 0, recall * sum(r.n for r in places)
    for r in places:
        held += r.n
        if held >= wanted:
            return r.place + 1
    return 0


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scanned(index: VectorIndex, asked: DataFrame, wanted: DataFrame, k: int, size: int) -> DataFrame:
    """(query, id, similarity): the k best for each query and block of the cells that are ``wanted`` (query, cell)."""
    held = max(1, BLOCK_BYTES // (8 * size))
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n / held)).cast("int")
    asking = wanted.groupBy("cell").agg(pieces(F.count("*")).alias("blocks"))
    grid = F.broadcast(index.cells.select("cell", pieces(F.col("n")).alias("parts")).join(asking, "cell"))  # a row a cell
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(grid, "cell").select("id", "vector", "cell", part("id", "parts").alias("part"), every("blocks").alias("block"))
    questions = wanted.select("query", "cell").join(asked, "query").join(grid, "cell").select("query", "asked", "cell", part("query", "blocks").alias("block"), every("parts").alias("part"))
    on = ["cell", "part", "block"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        has, wants = unit_rows(left["vector"], size), unit_rows(right["asked"], size)
        of, at, like = [], [], []
        step = max(1, BLOCK_BYTES // (8 * max(1, len(has))))
        for start in range(0, len(wants) if len(has) else 0, step):
            found = np.floor((wants[start : start + step] @ has.T) * 1e4 + 0.5) / 1e4
            for row, near in enumerate(found):
                near_enough = np.arange(len(near)) if len(near) <= k else np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
                top = near_enough[np.argsort(-near[near_enough], kind="stable")[:k]]
                of.append(np.full(len(top), start + row))
                at.append(top)
                like.append(near[top])
        index_of = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        scores = pa.array(np.concatenate(like) if like else np.zeros(0), pa.float64())
        return pa.table({"query": right["query"].take(index_of(of)), "id": left["id"].take(index_of(at)), "similarity": scores})

    schema = f"query {dict(asked.dtypes)['query']}, id {dict(index.rows.dtypes)['id']}, similarity double"
    return rows.groupBy(*on).cogroup(questions.groupBy(*on)).applyInArrow(compare, schema)
