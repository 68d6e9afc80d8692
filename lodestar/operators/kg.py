"""Knowledge graphs over stored tables: co-occurrence, lexical similarity, the cheap graph and the retrieval index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import bind, index_tokens, normalize
from .graph import edge_counts, node_counts, prefixed, whole

PAIRS_PER_CHUNK, BAND, BAND_ROWS, SIMILARITY_EDGES, LEAST_SIMILARITY, STEM = 24, 400, 3000, 2000, 0.35, 5
#: Nodes of a stem or word that meet others in one cell, at most on average.
CELL = 1000


def chunk_entities(triples: DataFrame) -> DataFrame:
    """(chunk_id, entity_ids): distinct ontology ends of a chunk's triples, sorted."""
    ends = triples.select("chunk_id", F.explode(F.array("subject_id", "object_id")).alias("e")).where("chunk_id <> '' AND e LIKE 'onto:%'")
    # moved by chunk first: lists made before would be made again behind the shuffle
    return ends.repartition("chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set("e")).alias("entity_ids"))


def cooccurrence(per_chunk: DataFrame, cap: int | None = PAIRS_PER_CHUNK) -> DataFrame:
    """(subject_id, predicate, object_id, weight): in how many chunks two entities meet.

    ``cap`` takes the first so many entities of a chunk in order, which is part
    of the retrieval graph's definition; None pairs all, as the cheap graph does.
    """
    ids = F.col("entity_ids") if cap is None else F.slice("entity_ids", 1, max(2, cap))
    rows = per_chunk.select(ids.alias("ids"))
    rows = rows.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("weight"))
    return counted.select(F.col("a").alias("subject_id"), F.lit("CO_OCCURS_IN_CHUNK").alias("predicate"), F.col("b").alias("object_id"), "weight")


def _signs(label: Column) -> Column:
    """What labels are told apart by: norm, the distinct words, and the stems of words of ``STEM`` letters or more."""
    norm = F.replace(normalize(label), F.lit("onto:"), F.lit(""))
    words = F.array_distinct(index_tokens(F.translate(norm, "_", " ")))
    stems = lambda t: F.array_distinct(F.transform(F.filter(t, lambda x: F.length(x) >= STEM), lambda x: F.substring(x, 1, STEM)))
    return bind(words, lambda w: F.struct(norm.alias("norm"), w.alias("words"), stems(w).alias("stems")))


def _similarity(a: Column, b: Column) -> Column:
    """Of two labels' signs."""
    ta, tb = a["words"], b["words"]
    jaccard = F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1))
    prefix = F.when(F.arrays_overlap(a["stems"], b["stems"]), LEAST_SIMILARITY).otherwise(0.0)
    none = (a["norm"] == "") | (b["norm"] == "") | (a["norm"] == b["norm"]) | (F.size(ta) == 0) | (F.size(tb) == 0)
    return F.when(none, 0.0).otherwise(F.greatest(jaccard, prefix))


def label_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the labels' token sets, or 0.35 where tokens of five letters or more share their first five; 0 for equal labels."""
    return _similarity(_signs(a), _signs(b))


def _weighted(pairs: DataFrame) -> DataFrame:
    weight = F.greatest(F.lit(1), F.bround(F.col("similarity") * 10).cast("int")).cast("long")
    return pairs.select("subject_id", F.lit("SIMILAR_ONTOLOGY").alias("predicate"), "object_id", weight.alias("weight"), "similarity")


def similarity_edges(nodes: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, weight, similarity) of all pairs among ``nodes`` (id, label; an id once) that are similar.

    Pairs are as similar as that if they share a stem, or a word among the first of
    both in one order of all words: a set that another's overlap must reach 0.35 of
    can't miss all of those. Long words come first there, and sharing one of them is
    sharing a stem, so nodes are filed under stems and the short words left. Who
    shares a stem is an edge, so work grows with the edges; the nodes of a stem meet
    in cells of ``CELL`` by ``CELL``, so none is one task's alone.
    """
    n = F.size("signs.words")
    order = F.array_sort(F.transform("signs.words", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    first = F.slice(order, 1, (n - F.floor((n * int(100 * LEAST_SIMILARITY) + 99) / 100) + 1).cast("int"))  # in whole numbers: 0.35 * 20 is more than 7
    short = F.transform(F.filter(first, lambda x: x["l"] > -STEM), lambda x: x["w"])
    rows = nodes.where("id IS NOT NULL").select("id", _signs(F.col("label")).alias("signs")).where(n > 0)
    rows = rows.withColumn("keys", F.concat(F.col("signs.stems"), short))  # stems are longer than short words
    filed = rows.select("*", F.explode("keys").alias("key"))
    sizes = filed.groupBy("key").agg(F.ceil(F.count("*") / CELL).alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    filed = filed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    own = lambda side: F.struct("id", "signs", "keys").alias(side)
    left = filed.select("key", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), own("a"))
    right = filed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))).alias("i"), F.col("part").alias("j"), own("b"))
    # each pair in the cell of its first key alone
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("key")
    met = left.join(right, ["key", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a.id") < F.col("b.id"))) & once)
    ends = [f("a.id", "b.id").alias(c) for f, c in ((F.least, "subject_id"), (F.greatest, "object_id"))]
    return _weighted(met.select(*ends, _similarity(F.col("a.signs"), F.col("b.signs")).alias("similarity")).where(F.col("similarity") >= LEAST_SIMILARITY))


def banded_edges(nodes: DataFrame, band: int = BAND, rows: int = BAND_ROWS, most: int = SIMILARITY_EDGES) -> DataFrame:
    """``similarity_edges`` within a band, as one query asks for it: no graph is made of these.

    Row i of the first ``rows`` in order of id is held against the ``band`` rows
    after it, and the ``most`` best pairs stay.
    """
    first = nodes.orderBy("id").limit(rows + band)
    ranked = first.withColumn("rn", F.row_number().over(Window.orderBy("id")))  # rows + band rows
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, F.expr(f"b.rn BETWEEN a.rn + 1 AND a.rn + {band} AND a.rn <= {rows}"))
    pairs = pairs.select(F.col("a.id").alias("subject_id"), F.col("b.id").alias("object_id"), label_similarity(F.col("a.label"), F.col("b.label")).alias("similarity"))
    return _weighted(pairs.where(F.col("similarity") >= LEAST_SIMILARITY).orderBy(F.desc("similarity"), F.desc("subject_id"), F.desc("object_id")).limit(most))


def fact_entity_edges(facts: DataFrame) -> DataFrame:
    """Edges of facts to their entities, to be added to those that triples already hold."""
    return _about(facts).groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("weight"))


def _about(facts: DataFrame) -> DataFrame:
    e = facts.select(F.col("fact_id").alias("subject_id"), F.lit("ABOUT_ENTITY").alias("predicate"), F.explode("entity_ids").alias("e"))
    return e.select("subject_id", "predicate", prefixed(F.col("e")).alias("object_id"))


def retrieval_edges(triples: DataFrame, facts: DataFrame, similar: DataFrame) -> DataFrame:
    """All weighted edges of the retrieval graph; equal ones add up, in one grouping of them all."""
    names = ["subject_id", "predicate", "object_id", "weight"]
    one = [*names[:3], F.lit(1).cast("long").alias("weight")]
    met = cooccurrence(chunk_entities(triples))
    all_edges = whole(triples).select(*one).unionByName(_about(facts).select(*one)).unionByName(met).unionByName(similar.select(*names))
    return all_edges.groupBy(*names[:3]).agg(F.sum("weight").alias("weight"))


def chunk_facts(facts: DataFrame) -> DataFrame:
    """(chunk_id, numeric_fact_count, numeric_properties, numeric_units)."""
    distinct = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return facts.where("coalesce(chunk_id, '') <> ''").groupBy("chunk_id").agg(
        F.count("*").alias("numeric_fact_count"), distinct("property_id").alias("numeric_properties"), distinct("unit").alias("numeric_units")
    )


def retrieval_index(chunks: DataFrame, triples: DataFrame, facts: DataFrame, centrality: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, text, domain_tags, others) with graph features and graph_boost.

    ``centrality``: (id, centrality). A chunk without entities in triples has those of its tags.
    """
    n_triples = triples.where("coalesce(chunk_id, '') <> ''").groupBy("chunk_id").agg(F.count("*").alias("triple_count"))
    rows = chunks.join(chunk_entities(triples), "chunk_id", "left").join(chunk_facts(facts), "chunk_id", "left").join(n_triples, "chunk_id", "left")
    tags = F.array_sort(F.array_distinct(F.transform(F.coalesce("domain_tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("onto:"), t))))
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            "of_tags": F.when(F.col("entity_ids").isNull(), F.array_join(tags, "\0")).otherwise(""),
            "entity_ids": F.coalesce("entity_ids", tags),
            "numeric_fact_count": F.coalesce("numeric_fact_count", F.lit(0)),
            "numeric_properties": F.coalesce("numeric_properties", none),
            "numeric_units": F.coalesce("numeric_units", none),
            "triple_count": F.coalesce("triple_count", F.lit(0)),
        }
    )
    first = rows.select("chunk_id", "of_tags", F.explode(F.slice("entity_ids", 1, 16)).alias("id")).join(centrality, "id")
    # rows of one chunk_id have the same entities, or those of their own tags; a set, as such rows may be repeated
    met = first.groupBy("chunk_id").agg(F.collect_set(F.struct("of_tags", "id", F.col("centrality").cast("double").alias("c"))).alias("met"))
    # added up in order of ids, 16 at most: in another order the last digit of a sum differs
    own = F.filter(F.array_sort("met"), lambda x: x["of_tags"] == F.col("of_tags"))
    rows = rows.join(met, "chunk_id", "left").withColumn("central", F.aggregate(own, F.lit(0.0), lambda total, x: total + x["c"]))
    text = F.coalesce("text", F.lit(""))
    cents = (  # whole numbers, so that a boost at the edge between two digits is the same wherever it is added up
        F.least(F.lit(200), F.col("numeric_fact_count") * 35)
        + F.when(text.rlike(V.INDEX_NUMERIC), 50).otherwise(0)
        + F.least(F.lit(200), F.size("entity_ids") * 12)
        + F.when(text.rlike(V.PROCESS_HINT), 45).otherwise(0)
        + F.when(text.rlike(V.PROPERTY_HINT), 35).otherwise(0)
    )
    boost = cents / 100 + F.coalesce("central", F.lit(0.0)) * 10
    return rows.withColumn("graph_boost", F.round(boost * 10000) / 10000).withColumn("chars", F.length(text)).drop("central", "met", "of_tags")


def cheap_kg(triples: DataFrame, facts: DataFrame, top_n: int = 50) -> DataFrame:
    """(kind, key, n): the top nodes, edges, co-occurrences, properties and units, ties by key."""
    key = F.concat_ws(" ", "subject_id", "predicate", "object_id")
    kinds = [
        ("node", node_counts(triples).select(F.col("node_id").alias("key"), "n")),
        ("edge", edge_counts(triples).select(key.alias("key"), F.col("weight").alias("n"))),
        ("cooccurrence", cooccurrence(chunk_entities(triples), cap=None).select(key.alias("key"), F.col("weight").alias("n"))),
        ("property", facts.groupBy(F.coalesce("property_id", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))),
        ("unit", facts.groupBy(F.coalesce("unit", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))),
    ]
    parts = [df.orderBy(F.desc("n"), "key").limit(top_n).select(F.lit(kind).alias("kind"), "key", "n") for kind, df in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
