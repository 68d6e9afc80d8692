"""Retrieval metrics and the search for parameters that raise them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.readers import read_jsonl, write_jsonl


# Classes of answers by words, in order.
NICHES = [
    ("membrane_desalination", ["обратный осмос", "reverse osmosis", "мембран"]),
    ("ion_exchange", ["ионный обмен", "ion exchange"]),
    ("electrolyte_circulation", ["католит", "catholyte"]),
    ("matte_slag_distribution", ["штейн", "matte", "шлак", "slag"]),
]
FEEDBACK = "query string, params map<string,double>, score double, comment string"


def niche_key(text: Column | str) -> Column:
    """The class of an answer or of facts by its words, else general."""
    low, out = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit("general")
    for name, words in reversed(NICHES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def append_feedback(rows: DataFrame, path: str) -> None:
    """Adds experts' scores of answers (query, params, score, comment) to a log of JSON lines."""
    write_jsonl(rows.select("query", "params", "score", "comment"), path, mode="append")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, StructType.fromDDL(FEEDBACK))


def particle_swarm(objective: Callable[[dict[str, float]], float], bounds: dict[str, tuple[float, float]], particles: int = 12, iterations: int = 20, seed: int = 0) -> tuple[dict[str, float], float]:
    """The best parameters found and their value; higher is better. Inertia 0.55, pulls to own and common best 1.3."""
    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][i] for n in names]) for i in (0, 1))
    x = rng.uniform(low, high, (particles, len(names)))
    v = np.zeros_like(x)
    value = lambda p: objective(dict(zip(names, map(float, p))))
    own, own_value = x.copy(), np.array([value(p) for p in x])
    best, best_value = own[own_value.argmax()].copy(), own_value.max()
    for _ in range(iterations):
        r1, r2 = rng.random(x.shape), rng.random(x.shape)
        v = 0.55 * v + 1.3 * r1 * (own - x) + 1.3 * r2 * (best - x)
        x = np.clip(x + v, low, high)
        values = np.array([value(p) for p in x])
        better = values > own_value
        own[better], own_value[better] = x[better], values[better]
        if own_value.max() > best_value:
            best, best_value = own[own_value.argmax()].copy(), own_value.max()
    return dict(zip(names, map(float, best))), float(best_value)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall, reciprocal rank and nDCG at ``k``, averaged over queries with a relevant row.

    ``ranked``: query_id, item_id, rank from 1. ``relevant``: query_id, item_id.
    """
    want = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("want"))
    hit = ranked.where(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "item_id"], "left_semi")
    per = hit.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("want", F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    rows = want.join(per, "query_id", "left").select(
        (F.coalesce("hits", F.lit(0)) / F.col("want")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg")
    )
    return rows.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
