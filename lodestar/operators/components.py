"""Connected components by alternating large-star and small-star rounds.

Each round is a constant number of shuffles over the edges that are left, and
the number of rounds grows with the logarithm of the longest path, not with
its length. The minimum of each node's neighbours is found with a map-side
combine; a hub's edges are then salted, so no task ever holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

SALTS = 8


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours in ``edges``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 100) -> DataFrame:
    """Edges (src, dst) to (node, root): the smallest node that each node reaches.

    Nodes without an edge to another node, and the roots themselves, do not
    appear. Null ends are dropped; loops and repeated edges make no difference.
    """
    e = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = ws.save(e, "stars")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_min(large)
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = small.select(F.inline(pairs)).where("u <> v").distinct()
        e = ws.save(e, "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_star_forest(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high"))
    )
    seen = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return seen.where("low > 1 OR (low = 1 AND high = 1)").limit(1).count() == 0


def grown_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of a graph with ``roots`` (node, root, as ``connected_components`` has them) to which ``edges`` (src, dst) come.

    Rounds run over the new edges alone, between the roots of their ends; nodes
    known before are relabelled by one join, salted, as a component may hold most of them.
    """
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    ends = ends.join(root_of("src"), "src", "left").join(root_of("dst"), "dst", "left")
    met = ends.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"))
    moved = connected_components(met, Workspace(roots.sparkSession, "grown"))  # ``roots`` may lie in the caller's
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("fresh"), salts)
    known = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(to, ["root", "salt"], "left")
    return known.select("node", F.coalesce("fresh", "root").alias("root")).unionByName(moved.select("node", "root"))
