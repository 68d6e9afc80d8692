"""Property graphs: building, degrees, centralities, health. Components are in ``components``.

Vertices and edges are DataFrames. Iterative operators write their state to the
shared workspace each round, so lineage stays short and lost executors cost one
round at most. Nothing is collected but scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..workspace import Workspace


def edge_counts(triples: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, weight) of complete triples."""
    return whole(triples).groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("weight"))


def whole(triples: DataFrame) -> DataFrame:
    """Complete triples."""
    return triples.where("coalesce(subject_id, '') <> '' AND coalesce(predicate, '') <> '' AND coalesce(object_id, '') <> ''")


def node_counts(triples: DataFrame) -> DataFrame:
    """(node_id, n): each end counts once for each triple."""
    ends = triples.select(F.explode(F.array("subject_id", "object_id")).alias("node_id")).where("coalesce(node_id, '') <> ''")
    return ends.groupBy("node_id").agg(F.count("*").alias("n"))


def store_graph(entities: DataFrame, facts: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) of entities, facts and triples, and distinct directed edges (src, dst), fact-entity edges included."""
    fact_edges = facts.select(F.col("fact_id").alias("src"), F.explode("entity_ids").alias("e")).select("src", prefixed(F.col("e")).alias("dst"))
    edges = triples.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).unionByName(fact_edges)
    given = edges.where("coalesce(src, '') <> '' AND coalesce(dst, '') <> ''")
    # ends are of edges as they come, repeats and all, which a task drops itself: distinct edges would be shuffled for them once more
    ids = [entities.select(F.col("entity_id").alias("id")), facts.select(F.col("fact_id").alias("id")), given.select(F.explode(F.array("src", "dst")).alias("id"))]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).where("coalesce(id, '') <> ''").distinct(), given.distinct()


def prefixed(entity: Column) -> Column:
    return F.when(entity.startswith("onto:"), entity).otherwise(F.concat(F.lit("onto:"), entity))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours either way; 0 for isolated vertices."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = edges.where("src <> dst").select(F.inline(ends)).distinct().groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.join(near, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_scalars(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges (undirected), isolated, average_degree, density, components, health. ``components``: (node, root)."""
    d = degrees(vertices, edges).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolated"))
    joined = components.agg(F.count("*").alias("joined"))  # each node that isn't a root takes one component away
    n, e = F.col("nodes"), F.col("edges")
    rows = d.crossJoin(joined).withColumn("components", n - F.col("joined"))  # one row each
    return rows.select(
        "nodes",
        "edges",
        "isolated",
        F.round(F.when(n > 0, 2 * e / n).otherwise(0.0), 6).alias("average_degree"),
        F.round(F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0), 8).alias("density"),
        "components",
        health(n, F.col("isolated"), F.col("components")).alias("health"),
    )


def health(nodes: Column, isolated: Column, components: Column) -> Column:
    return (
        F.when(isolated > F.greatest(F.lit(10), F.floor(nodes * 0.25)), "weak_graph")
        .when(components > F.greatest(F.lit(10), F.floor(nodes * 0.15)), "split_needed")
        .otherwise("ok")
    )


#: A source of more edges than ``HUB`` has them dealt to ``SALTS`` tasks.
HUB, SALTS = 10_000, 16


def _with_shares(edges: DataFrame, weight: str) -> DataFrame:
    """(frm, to, share, salts, salt) of ``edges`` (frm, to and a weight): a share of its source's weight, and which of the source's ``salts`` it falls to."""
    own = edges.groupBy("frm").agg(F.sum(weight).alias("total"), F.when(F.count("*") > HUB, SALTS).otherwise(1).alias("salts"))
    shares = edges.join(own, "frm").select("frm", "to", (F.col(weight) / F.col("total")).alias("share"), "salts")
    return shares.withColumn("salt", F.pmod(F.xxhash64("to"), F.col("salts")).cast("int"))


def _ranked(vertices: DataFrame, flow: DataFrame, ws: Workspace, rounds: int, damping: float, tolerance: float | None = None) -> DataFrame:
    """(id, rank) by power iteration over ``flow``, as saved; what vertices without out-edges hold is spread evenly.

    A round is one job: what the next one needs of all ranks, the share of those
    vertices and by how much ranks have changed, is observed as they are written.
    """
    n = vertices.count()
    salts = flow.groupBy(F.col("frm").alias("id")).agg(F.max("salts").alias("salts"))
    start = vertices.join(salts, "id", "left").select("id", F.coalesce("salts", F.lit(0)).alias("salts"), F.lit(1.0 / max(1, n)).alias("rank"), F.lit(0.0).alias("change"))

    def saved(ranks: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        ranks = ranks.observe(seen, F.sum(F.when(F.col("salts") == 0, F.col("rank"))).alias("idle"), F.sum("change").alias("change"))
        return ws.save(ranks, "ranks"), seen.get

    ranks, seen = saved(start)
    for _ in range(rounds):
        base = (1 - damping) / max(1, n) + damping * (seen.get("idle") or 0.0) / max(1, n)
        held = ranks.where("salts > 0").select(F.col("id").alias("frm"), "rank", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        # merged, as else all ranks of a round go through the driver as long as they are small enough
        into = flow.join(held.hint("merge"), ["frm", "salt"]).groupBy("to").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
        fresh = ranks.join(into, F.col("id") == F.col("to"), "left").select("id", "salts", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        ranks, seen = saved(fresh)
        if tolerance is not None and (seen.get("change") or 0.0) < n * tolerance:
            break
    return ranks.select("id", "rank")


def pagerank(vertices: DataFrame, edges: DataFrame, ws: Workspace, iterations: int = 25, damping: float = 0.85) -> DataFrame:
    """(id, rank): directed, uniform weights, a fixed number of rounds."""
    one = edges.select(F.col("src").alias("frm"), F.col("dst").alias("to"), F.lit(1.0).alias("weight"))
    return _ranked(vertices, ws.save(_with_shares(one, "weight"), "flow"), ws, iterations, damping)


def weighted_centrality(vertices: DataFrame, edges: DataFrame, ws: Workspace, iterations: int = 30, tolerance: float = 1e-4, damping: float = 0.85) -> DataFrame:
    """(id, centrality): PageRank of the undirected graph of edges (subject_id, object_id, weight), loops left out.

    Weights of one pair add up. Stops when ranks change by under ``tolerance``
    for each vertex on average; without any edge all are zero. ``degree_share``
    is the plainer measure.
    """
    pairs = edges.where("subject_id <> object_id").select(F.col("subject_id").alias("frm"), F.col("object_id").alias("to"), F.col("weight").cast("double").alias("w"))
    both = pairs.unionByName(pairs.select(F.col("to").alias("frm"), F.col("frm").alias("to"), "w")).groupBy("frm", "to").agg(F.sum("w").alias("w"))
    flow = ws.save(_with_shares(both, "w"), "undirected")
    if flow.limit(1).count() == 0:
        return vertices.select("id", F.lit(0.0).alias("centrality"))
    return _ranked(vertices, flow, ws, iterations, damping, tolerance).select("id", F.bround("rank", 8).alias("centrality"))


def degree_share(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): a vertex's share of all weighted degrees, loops counted twice."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id"), F.col("weight").cast("double").alias("w"))
    own = ends.groupBy("id").agg(F.sum("w").alias("w"))
    total = own.agg(F.sum("w").alias("total"))
    joined = vertices.join(own, "id", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("id", F.bround(F.coalesce("w", F.lit(0.0)) / F.coalesce("total", F.lit(1.0)), 8).alias("centrality"))


def betweenness(vertices: DataFrame, edges: DataFrame, ws: Workspace, sample: int | None = 32, seed: int = 13) -> DataFrame:
    """(id, betweenness): dependencies of shortest paths from the roots, summed and divided by the number of roots.

    Half of the roots are those of highest degree, half those of least seeded id
    hash; all vertices where there are no more than ``sample``, or with None (one
    row for each pair of vertices: for small graphs). Breadth first from all roots
    at once, level by level until nothing new is reached, then back: joins only.
    Vertices with the same neighbours are one row, weighed by how many they are.
    """
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    near = ws.save(edges.where("src <> dst").select(F.inline(ends)).distinct(), "near")
    vertices = ws.save(vertices, "vertices")
    n = vertices.count()
    if sample is None or n <= sample:
        roots = vertices.select("id")
    else:
        degree = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
        by_degree = vertices.join(degree, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(sample // 2).select("id")
        by_hash = vertices.join(by_degree, "id", "left_anti").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(sample - sample // 2)
        roots = by_degree.unionByName(by_hash)
    roots = ws.save(roots, "roots")
    n_roots = roots.count()
    members, near = _twins(near, roots, ws)
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth"))
    seen = level = ws.save(level, "level0")
    depth = 0
    while True:
        step = level.join(near, level.node == near.a).groupBy("root", F.col("b").alias("node")).agg(F.sum(F.col("paths") * F.col("a_size")).alias("paths"))
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth + 1))
        level = ws.save(fresh.select("root", "node", "paths", "depth"), f"level{depth + 1}")
        if level.limit(1).count() == 0:
            break
        depth += 1
        seen = seen.unionByName(level)
    reached = ws.save(seen, "reached")
    below = reached.where(F.col("depth") == depth).select("root", "node", "paths", F.lit(0.0).alias("owed"))
    parts = [below]
    for d in range(depth - 1, -1, -1):
        child = below.select("root", F.col("node").alias("child"), ((1 + F.col("owed")) / F.col("paths")).alias("rate"))
        at = reached.where(F.col("depth") == d)
        pulls = near.join(child, near.b == child.child).groupBy("root", F.col("a").alias("node")).agg(F.sum(F.col("rate") * F.col("b_size")).alias("rate"))
        own = at.join(pulls, ["root", "node"], "left").select("root", "node", "paths", (F.col("paths") * F.coalesce("rate", F.lit(0.0))).alias("owed"))
        below = ws.save(own, f"owed{d}")
        parts.append(below)
    owed = parts[0]
    for p in parts[1:]:
        owed = owed.unionByName(p)
    sums = owed.where("root <> node").groupBy(F.col("node").alias("twin")).agg((F.sum("owed") / max(n_roots, 1)).alias("betweenness"))
    sums = members.join(sums, "twin").select("id", "betweenness")
    return vertices.join(sums, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _twins(near: DataFrame, roots: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, twin, size) of the vertices in ``near`` (a, b), and (a, b, a_size, b_size) between twins alone.

    Vertices with the same neighbours are as far from any root, by as many paths,
    and have the same dependencies, so the least stands for all; roots stand for
    themselves. Where one of a group is next to one of another, so is each to each.
    Sets of neighbours are told apart by their size and 128 bits of hashes.
    """
    signs = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "b")).alias("y"))
    alone = roots.select("id", F.col("id").alias("root"))
    signs = ws.save(signs.join(alone, "id", "left"), "signs")
    same = ["n", "x", "y"]
    groups = signs.where("root IS NULL").groupBy(*same).agg(F.min("id").alias("twin"), F.count("*").cast("double").alias("size"))
    members = signs.where("root IS NULL").join(groups, same).select("id", "twin", "size")
    members = ws.save(members.unionByName(signs.where("root IS NOT NULL").select("id", F.col("id").alias("twin"), F.lit(1.0).alias("size"))), "members")
    stand = members.where("id = twin")
    ends = [stand.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size")) for c in ("a", "b")]
    return members, ws.save(near.join(ends[0], "a").join(ends[1], "b").select("a", "b", "a_size", "b_size"), "between")


def top_labelled(scores: DataFrame, labels: DataFrame, name: str, top_n: int = 20) -> DataFrame:
    """(kind, node_id, label, score) of the vertices (id, ``name``) with the highest scores, to 6 digits; a vertex without a label has its id."""
    best = scores.orderBy(F.desc(name), "id").limit(top_n).join(labels.select("id", "label"), "id", "left")
    return best.select(F.lit(f"top_{name}").alias("kind"), F.col("id").alias("node_id"), F.coalesce("label", "id").alias("label"), F.round(F.col(name).cast("double"), 6).alias("score"))


def graph_metrics(vertices: DataFrame, edges: DataFrame, labels: DataFrame, ws: Workspace, top_n: int = 20, iterations: int = 40, sample: int | None = 64) -> DataFrame:
    """One row: the scalars of ``graph_scalars``, the largest component and ratios, and top lists (array of kind, node_id, label, score).

    Each step saves in a part of ``ws``, as the row is read when all have been planned.
    """
    from .components import connected_components

    vertices, edges = ws.save(vertices, "vertices"), ws.save(edges, "edges")
    roots = ws.save(connected_components(edges, ws.part("components")), "members")  # of components
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("largest"))
    tops = top_labelled(degrees(vertices, edges), labels, "degree", top_n)
    tops = tops.unionByName(top_labelled(pagerank(vertices, edges, ws.part("pagerank"), iterations).withColumnRenamed("rank", "pagerank"), labels, "pagerank", top_n))
    tops = tops.unionByName(top_labelled(betweenness(vertices, edges, ws.part("betweenness"), sample), labels, "betweenness", top_n))
    listed = tops.agg(F.array_sort(F.collect_list(F.struct("kind", (-F.col("score")).alias("order"), "node_id", "label", "score"))).alias("tops"))  # 3 x top_n rows
    rows = graph_scalars(vertices, edges, roots).crossJoin(sizes).crossJoin(listed)  # one row each
    n = F.greatest(F.col("nodes"), F.lit(1))
    return rows.select(
        "*", F.when(F.col("nodes") > 0, F.col("largest")).otherwise(0).alias("largest_component_size"), F.round(F.when(F.col("nodes") > 0, F.col("largest")).otherwise(0) / n, 4).alias("largest_component_ratio"),
        F.round(F.col("isolated") / n, 4).alias("isolated_nodes_ratio"),
    ).drop("largest")


def central_labels(metrics: DataFrame) -> DataFrame:
    """(label, weight, score) of the top lists of ``graph_metrics``, as routing takes them."""
    from .search import CENTRAL_WEIGHTS

    weight = F.element_at(F.create_map(*[F.lit(x) for kv in CENTRAL_WEIGHTS.items() for x in kv]), F.col("t.kind"))
    return metrics.select(F.explode("tops").alias("t")).select(normalize(F.col("t.label")).alias("label"), weight.alias("weight"), F.col("t.score").alias("score"))


def grown_degrees(degrees: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """(id, degree) after ``new`` edges (src, dst) come to a graph with ``edges`` and ``degrees`` (id, degree).

    Only neighbours that are not neighbours yet, either way, count; repeated new
    edges count once, and ids that had no row get one.
    """
    met = lambda e: e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    fresh = met(new).join(met(edges), ["a", "b"], "left_anti")
    more = fresh.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("more"))
    alone = new.where("src = dst").select(F.col("src").alias("id"), F.lit(0).cast("long").alias("more")).distinct()
    more = more.unionByName(alone).groupBy("id").agg(F.sum("more").alias("more"))
    return degrees.join(more, "id", "full").select("id", (F.coalesce("degree", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("degree"))
