"""SimHash near-duplicate detection by the generalised pigeonhole principle.

Fingerprints: 64 bits, from the XXH64 (seed 42) of all 3-word shingles of the
whole lower-cased text. Two fingerprints link at ``radius`` (2) or fewer
differing bits; a component is what links reach.

Candidate search. The 64 bits are grouped so that correlated bits share a
partition. If partition i gets a threshold t_i, with t_1 + ... + t_m =
radius - m + 1 and t_i >= -1, every pair within the radius differs by at most
t_i bits in some partition i. The thresholds (and m) are chosen by dynamic
programming on candidate counts, estimated from the exact sizes of all blocks.
At t_i = -1 a partition is not looked at, at 0 equal keys meet, at 1 keys at
one flipped bit meet as well. Candidates are verified on all 64 bits.

A block (partition, key) with over ``block_limit`` rows is not expanded into
pairs: its members instead emit their 65 neighbours within one bit, and those
who share a neighbour link. Within radius 2 that finds the same links, and a
neighbour has at most 65 fingerprints around it, whatever the size of the
group. No pair is dropped or capped.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import SALTS, connected_components
from ..workspace import Workspace, spread
from .near_copies import copies_to_keep, text_digest

BITS = 64
RADIUS = 2
#: Larger blocks take the way by shared neighbours.
BLOCK_LIMIT = 32
#: A verified candidate costs about as much as this many emitted rows.
PAIR_COST = 0.2
#: Shingles that are counted at once; bounds the memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash as an unsigned integer; zero for a text without words, and for null."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    n = max(1, len(words) - 2)
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as an unsigned integer."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many of them set bits i and j, over all of ``fps``."""

    def count(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            raw = pdf["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(raw), CHUNK):
                bits = np.unpackbits(raw[i : i + CHUNK], axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*both[i, j].astype(np.int64), n]})

    rows = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; bits that say much about each other share a group."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(like, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = (BITS * (k + 1)) // m - (BITS * k) // m
        at = sorted(left)
        first = at[int(np.argmax(like[np.ix_(at, at)].sum(axis=1)))]
        group = [first]
        left.discard(first)
        while len(group) < width:
            at = sorted(left)
            group.append(at[int(np.argmax(like[np.ix_(at, group)].sum(axis=1)))])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, p: np.ndarray, groups: list[list[int]], pairs: list[float], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Least cost and thresholds t_i with sum radius - m + 1, by dynamic programming.

    ``pairs``: pairs with equal keys by group. At threshold 1 the number of
    candidates is estimated from how often random fingerprints differ in a bit.
    """
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group, equal in zip(groups, pairs):
        differ = np.clip(2 * p[group] * (1 - p[group]), 0, 0.999)
        near = (equal + n) * (1 + float(np.sum(differ / (1 - differ))))
        costs = {-1: 0.0, 0: n + PAIR_COST * equal, 1: n * (1 + len(group)) + PAIR_COST * near}
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in costs.items():
                if t <= radius and (total + t not in step or cost + c < step[total + t][0]):
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best[radius - m + 1]


def plan_search(spark: SparkSession, fps: DataFrame) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each partition that is looked at. Driver: a few thousand counts, whatever the input."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    choices = {m: group_bits(n, both, m) for m in (2, 3, 4)}
    keys = [
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key"))
        for m, groups in choices.items()
        for i, g in enumerate(groups)
    ]
    sizes = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("c"))
    rows = sizes.groupBy("k.m", "k.i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()
    pairs = {(r.m, r.i): r.pairs for r in rows}
    plans = []
    for m, groups in choices.items():
        cost, chosen = allocate(n, p, groups, [pairs.get((m, i), 0.0) for i in range(m)])
        plans.append((cost, m, [(_mask(g), g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def links(fps: DataFrame, plan: list[tuple[int, list[int], int]], ws: Workspace, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """(src, dst) for ``fps`` (fp, rep; fp distinct): enough verified links within radius 2 to connect what all links do."""
    rows = []
    for part, (mask, bits, t) in enumerate(plan):
        key = F.col("fp").bitwiseAND(F.lit(mask))
        at = lambda k, own, part=part: F.struct(F.lit(part).alias("part"), k.alias("key"), F.lit(own).alias("own"))
        rows.append(at(key, True))
        if t == 1:
            rows += [at(key.bitwiseXOR(F.lit(_signed(1 << b))), False) for b in bits]
    entries = fps.select("fp", "rep", F.inline(F.array(*rows)))
    heavy = ws.save(entries.groupBy("part", "key").count().where(F.col("count") > block_limit).select("part", "key"), "heavy")
    salted = entries.withColumn("salt", F.pmod(F.col("rep"), F.lit(SALTS)))
    copies = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = ["part", "key", "salt"]

    light = salted.join(copies, on, "left_anti").groupBy("part", "key").agg(F.collect_list(F.struct("fp", "rep", "own")).alias("all"))
    light = light.where(F.size("all") > 1)  # at most block_limit
    pairs = light.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where(
        "a.fp < b.fp AND (a.own OR b.own) AND bit_count(a.fp ^ b.fp) <= 2"
    )
    pairs = pairs.select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))

    crowd = salted.join(copies, on, "left_semi").select("fp", "rep").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]
    shared = crowd.select("rep", F.explode(F.array(*around)).alias("near")).groupBy("near").agg(F.collect_list("rep").alias("reps"))
    shared = shared.where(F.size("reps") > 1)  # at most 65
    stars = shared.select(F.explode("reps").alias("src"), F.array_min("reps").alias("dst")).where("src <> dst")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, fp long, component_id) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have fingerprint zero and link like any other. A row
    with null doc_id gets its fingerprint, links nothing and has the
    component of the other rows with that fingerprint, or else null. Repeated rows
    come back as often. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "simhash")
    rows = ws.save(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    fps = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    fps = ws.save(fps, "distinct")
    found = links(fps, plan_search(spark, fps), ws)
    roots = connected_components(found, ws)
    of = fps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    of = ws.save(of, "components")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id; rows with null doc_id stay.

    Near copies are as ``near_copies`` has them, five-word shingles at a
    similarity of 0.8. Candidates are found by the fingerprints of these, as ``links``
    has it, and as its radius is too small for all of them, by MinHash for the rest.
    Of rows that share that doc_id, texts that are no near copies of each other
    all stay; of near copies the text with the least MD5 stays, and of rows with
    that text the first by all columns. Null texts are as empty ones, and texts
    without words are copies of each other. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "copies")
    of = copies_to_keep(docs, ws, lambda found: _signed(majority(found)), lambda fps: links(fps, plan_search(docs.sparkSession, fps), ws))
    nested = docs.where("doc_id IS NOT NULL").select("doc_id", text_digest().alias("digest"), F.struct(*docs.columns).alias("doc"))
    unordered = [c for c, kind in docs.dtypes if "map<" in kind or "variant" in kind]
    first = F.min_by("doc", F.to_json("doc")) if unordered else F.min("doc")
    kept = nested.join(of, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(first.alias("doc")).select("doc.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
