"""Closed intervals of numbers by key: those that touch are made one, and where few are left each task holds them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .prefix import running_before

#: Keys beside a fact's entities, which begin with "=": of all constraints, and of those that ask for no entity.
ALL, UNASKED = "all", "no matter which"
GROUP = ["free", "of", "key"]


def merged(asked: DataFrame, ws: Workspace) -> DataFrame:
    """The intervals (free, of, key, begin, end) that are left when those of a key that overlap or touch are one, as a saved table of their edges.

    (free, of, key, last, begin, before): a row for the beginning of each, with the
    end of the one before it, and a last one of each key with the end of all.
    """
    reached = running_before(asked, GROUP, [F.col("begin"), F.col("end")], "end", "max", ws=ws)
    starts = reached.where("before IS NULL OR begin > before").select(*GROUP, F.lit(False).alias("last"), "begin", "before")
    ends = asked.groupBy(*GROUP).agg(F.max("end").alias("before")).select(*GROUP, F.lit(True).alias("last"), F.lit(0.0).alias("begin"), "before")
    return ws.save(starts.unionByName(ends), "merged")


def ordinal(x: np.ndarray) -> np.ndarray:
    """Integers in Spark's order of doubles: -0.0 equals 0.0, and NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _doubles(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return ordinal(pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False))


def _numbers(values: pa.Array, numbers: dict[str, int]) -> np.ndarray:
    """The number of each of ``values``, -1 for null and those without one."""
    coded = values.dictionary_encode()
    known = np.array([numbers.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], dtype=np.int64)
    return known[pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False)]


class Held:
    """The intervals of ``merged``, sorted by key and beginning: which facts meet one takes a binary search for each of a fact's keys."""

    def __init__(self, edges: pa.Table) -> None:
        columns = {c: edges.column(c).combine_chunks() for c in edges.column_names}
        of, key = ({x: i for i, x in enumerate(pc.unique(columns[c]).to_pylist())} for c in ("of", "key"))
        free = columns["free"].to_numpy(zero_copy_only=False)
        # number 0 is any dimension
        self.places, self.width = {x: i + 1 for x, i in of.items()}, max(1, len(key))
        self.every, self.unasked, self.entities = key.get(ALL, -1), key.get(UNASKED, -1), {x[1:]: i for x, i in key.items() if x.startswith("=")}
        code = np.where(free, 0, _numbers(columns["of"], self.places)) * self.width + _numbers(columns["key"], key)
        last, begin, before = columns["last"].to_numpy(zero_copy_only=False).astype(bool), _doubles(columns["begin"]), _doubles(columns["before"])
        order = np.lexsort((begin, last, code))
        code, last, begin, before = code[order], last[order], begin[order], before[order]
        self.begin, self.end = begin[~last], before[1:][~last[:-1]]  # behind each beginning stands the next edge of its key
        self.codes, first = np.unique(code[~last], return_index=True)
        self.bounds = np.append(first, len(self.begin))

    def meets(self, dimension: pa.Array, entities: pa.Array, low: pa.Array, high: pa.Array) -> np.ndarray:
        """Whether each fact's [low, high] overlaps an interval of its dimension or any, for its entities."""
        n = len(dimension)
        out = np.zeros(n, dtype=bool)
        if not len(self.codes):
            return out
        # a fact without entities meets any constraint of its dimension, others those that ask for none or for one of theirs
        none = pc.fill_null(pc.list_value_length(entities), 0).to_numpy(zero_copy_only=False) == 0
        keys = np.concatenate([np.where(none, self.every, self.unasked), _numbers(pc.list_flatten(entities), self.entities)])
        rows = np.concatenate([np.arange(n), pc.list_parent_indices(entities).to_numpy(zero_copy_only=False).astype(np.int64)])
        place = _numbers(dimension, self.places)
        rows, keys, place = np.concatenate([rows, rows]), np.concatenate([keys, keys]), np.concatenate([np.zeros(len(rows), dtype=np.int64), place[rows]])
        code = place * self.width + keys
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        asked = (place >= 0) & (keys >= 0) & (self.codes[at] == code) & pc.is_valid(low).to_numpy(zero_copy_only=False)[rows]
        rows, at = rows[asked], at[asked]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        low, high = _doubles(low)[rows], _doubles(high)[rows]
        groups, first = np.unique(at, return_index=True)
        for g, a, b in zip(groups, first, np.append(first[1:], len(at)), strict=True):
            # of those that begin by the fact's high end the last one reaches furthest
            begins = self.begin[self.bounds[g] : self.bounds[g + 1]]
            reached = np.searchsorted(begins, high[a:b], "right")
            hit = (reached > 0) & (self.end[self.bounds[g] + np.maximum(reached, 1) - 1] >= low[a:b])
            out[rows[a:b][hit]] = True
        return out


def meets(edges: DataFrame, dimension: Column, entities: Column, low: Column, high: Column) -> Column:
    """Whether a row's numbers overlap an interval of ``edges``, all of which each task holds; not null."""
    shared = edges.sparkSession.sparkContext.broadcast(Held(edges.toArrow()))

    @F.arrow_udf("boolean")
    def test(dimension: pa.Array, entities: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        return pa.array(shared.value.meets(dimension, entities, low, high))

    return test(dimension, entities, low, high)
