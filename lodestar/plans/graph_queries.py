"""Queries over the relational tables as a graph, over vectors, and over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, kg, search, store, vectors
from ..operators.components import connected_components, grown_components
from ..workspace import Workspace
from .fixtures import FACTS_OF_LINES_SQL, FACTS_SQL, LINES_SQL, TRIPLES_SQL, facts, lines, table, triples

ROUNDS, CENTRAL_ROUNDS, TOLERANCE = 25, 30, 1e-4


def edge_counts(spark, sf_dir):
    rows = graph.edge_counts(triples(spark, sf_dir)).where("predicate = 'MENTIONS'")
    return rows.groupBy("predicate", "object_id").agg(F.sum("weight").alias("weight"))


def node_counts(spark, sf_dir):
    return graph.node_counts(triples(spark, sf_dir)).orderBy(F.desc("n"), "node_id").limit(50)


def cooccurrence(spark, sf_dir):
    return kg.cooccurrence(_order_entities(spark, sf_dir), cap=None)


def cooccurrence_capped(spark, sf_dir):
    return kg.cooccurrence(_order_entities(spark, sf_dir), cap=3)


def _order_entities(spark, sf_dir) -> DataFrame:
    return kg.chunk_entities(triples(spark, sf_dir))


def facts_by_property(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("property_id", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def cheap_kg(spark, sf_dir):
    return kg.cheap_kg(triples(spark, sf_dir), facts(spark, sf_dir), top_n=20)


def _labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("label")).distinct()


def band_similarity(spark, sf_dir):
    rows = kg.banded_edges(_labels(spark, sf_dir))
    return rows.select("subject_id", "object_id", "weight", F.round("similarity", 6).alias("similarity"))


def _customer_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers, nations, segments and regions: customers point to nation and segment, nations to regions."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    edges = edges.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), "c_mktsegment").alias("dst")))
    edges = edges.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))).distinct()
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


def _same_text(spark, sf_dir) -> DataFrame:
    """Documents are linked if they share a first line or a last line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    ends = d.select("doc_id", F.explode(F.array(F.concat(F.lit("f:"), F.element_at("l", 1)), F.concat(F.lit("l:"), F.element_at("l", -1)))).alias("k"))
    return ends.join(ends.groupBy("k").agg(F.min("doc_id").alias("dst")), "k").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")


def components(spark, sf_dir):
    ws = Workspace(spark, "components")
    found = connected_components(_same_text(spark, sf_dir), ws)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    return d.join(found, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("component_id"))


def components_grown(spark, sf_dir):
    """As ``components``, where the links of every third document come later, in two lots."""
    ws, links = Workspace(spark, "grown"), _same_text(spark, sf_dir)
    found = ws.save(connected_components(links.where("src % 3 = 0"), ws), "first")
    for lot in (1, 2):
        found = ws.save(grown_components(found, links.where(f"src % 3 = {lot}")), f"lot{lot}")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    return d.join(found, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("component_id"))


def degrees_grown(spark, sf_dir):
    """As ``degree_density``, where the edges of nations and segments come later and some come again, turned round."""
    vertices, edges = _customer_graph(spark, sf_dir)
    old, new = edges.where("dst NOT LIKE 's%' AND src NOT LIKE 'n%'"), edges.where("dst LIKE 's%' OR src LIKE 'n%' OR src LIKE '%7'")
    turned = new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = old.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.grown_degrees(graph.degrees(ends, old), old, turned)


def degree_density(spark, sf_dir):
    vertices, edges = _customer_graph(spark, sf_dir)
    return graph.degrees(vertices, edges)


def graph_health(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    edges = _same_text(spark, sf_dir).select("src", "dst")
    found = connected_components(edges, Workspace(spark, "health"))
    return graph.graph_scalars(d, edges, found)


def pagerank(spark, sf_dir):
    vertices, edges = _customer_graph(spark, sf_dir)
    ranks = graph.pagerank(vertices, edges, Workspace(spark, "pagerank"))
    return ranks.select("id", F.round("rank", 10).alias("rank"))


def degree_share(spark, sf_dir):
    vertices, edges = _customer_graph(spark, sf_dir)
    weighted = edges.select(F.col("src").alias("subject_id"), F.col("dst").alias("object_id"), F.lit(1).alias("weight"))
    return graph.degree_share(vertices, weighted).select("id", F.round("centrality", 6).alias("centrality"))


def weighted_centrality(spark, sf_dir):
    vertices, edges = _customer_graph(spark, sf_dir)
    weighted = edges.select(F.col("src").alias("subject_id"), F.col("dst").alias("object_id"), F.lit(1).alias("weight"))
    ranks = graph.weighted_centrality(vertices, weighted, Workspace(spark, "central"))
    return ranks.select("id", F.round("centrality", 7).alias("centrality"))


def betweenness(spark, sf_dir):
    """On the customer graph, with the sampled roots."""
    vertices, edges = _customer_graph(spark, sf_dir)
    return graph.betweenness(vertices, edges, Workspace(spark, "between")).select("id", F.round("betweenness", 6).alias("betweenness"))


def _share(n: Column, total: Column) -> Column:
    """To 8 digits as SQL has it, where the product is rounded: ``bround`` rounds the digits, which differs for shares half-way between."""
    return F.rint(n / total * 1e8) / 1e8


def retrieval_index(spark, sf_dir):
    """Orders as chunks; degree share over brands and types as centrality."""
    t, f = triples(spark, sf_dir), facts(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("text"), F.array().cast("array<string>").alias("domain_tags"))
    nodes = graph.node_counts(t).where("node_id LIKE 'onto:%'")
    total = nodes.agg(F.sum("n").alias("total"))
    central = nodes.crossJoin(total).select(F.col("node_id").alias("id"), _share(F.col("n"), F.col("total")).alias("centrality"))  # one row
    rows = kg.retrieval_index(o, t, f, central)
    return rows.select("chunk_id", "numeric_fact_count", "triple_count", F.size("entity_ids").cast("long").alias("entities"), F.array_join("numeric_units", ",").alias("units"), F.floor(F.col("graph_boost") * 100 + 1e-6).alias("boost_cents"))


def validate_store(spark, sf_dir):
    """Lines as chunks of orders, of which those of every seventh are missing; each fifth line has no text."""
    sources = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("source_id"))
    chunks = lines(spark, sf_dir).select(F.col("line_id").alias("chunk_id"), F.col("order_id").alias("source_id"), F.when(F.col("quantity") % 5 != 0, F.col("kind")).alias("text"))
    f = facts(spark, sf_dir).select("fact_id", "source_id", F.regexp_extract("fact_id", r"(line:[0-9]+\.[0-9]+)", 1).alias("chunk_id"), "value", F.when(F.col("property_id") != "discount", F.col("unit")).alias("unit"))
    return store.violation_counts(sources, chunks, f)


def store_stats(spark, sf_dir):
    t = {"triples": triples(spark, sf_dir), "numeric_facts": facts(spark, sf_dir), "sources": table(spark, sf_dir, "orders")}
    return store.store_stats(t).where("kind <> 'facts_by_source'")


def merge_entities(spark, sf_dir):
    """Brands by the suppliers of their first and second line numbers."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = lambda n, at: li.where(F.col("l_linenumber") == n).groupBy(F.col("p_brand").alias("entity_id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("source_ids")).withColumn("label", F.concat("entity_id", F.lit(at)))
    merged = store.merge_entities(own(1, " old"), own(2, " new"))
    return merged.select("entity_id", "label", F.array_join(F.array_sort("source_ids"), ",").alias("source_ids"))


def interval_facts(spark, sf_dir):
    """Facts that meet any of: quantity 10 to 12, price over 90,000, discount of 0.05."""
    c = spark.createDataFrame(
        [("quantity", "range", 10.0, 12.0, None), ("price", ">", 90000.0, None, None), ("discount", "=", 0.05, None, None)],
        "c_dimension string, c_operator string, c_value double, c_value_max double, c_entity_ids array<string>",
    )
    return search.facts_matching(facts(spark, sf_dir), c).select("fact_id", "property_id", "value")


def constraint_batch(spark, sf_dir):
    """Facts that meet any of as many constraints as there are orders: narrow prices, bounds for one brand, equal numbers of any dimension."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = k % 5
    pick = lambda *values: F.element_at(F.array(*values), kind.cast("int") + 1)
    price = F.col("o_totalprice") / 4
    brand = F.array(F.concat(F.lit("onto:brand_"), F.col("o_custkey") % 5 + 1, k % 5 + 1))
    return search.facts_matching(
        facts(spark, sf_dir),
        o.select(
            pick(F.lit("price"), F.lit("price"), F.lit("quantity"), F.lit(None), F.lit("discount")).alias("c_dimension"),
            pick(F.lit("range"), F.lit(">="), F.lit("<"), F.lit("="), F.lit(">")).alias("c_operator"),
            pick(price, 20000 + price, (F.col("o_custkey") % 3).cast("double"), F.floor(price) + 0.5, F.lit(0.09)).alias("c_value"),
            F.when(kind == 0, price - 1).alias("c_value_max"),
            F.when(kind.isin(1, 2, 4), brand).alias("c_entity_ids"),
        ),
    ).select("fact_id", "property_id", "value")


QUESTION = "NATION_3 and REGION_1 in 1995 please"
VECTOR = [1.0 if i % 3 else -1.0 for i in range(64)]


def _routable(spark, sf_dir) -> DataFrame:
    """Nations as themes in regions, customers as sources, with statuses, years, central labels and, but for some, vectors as profiles."""
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    sources = c.groupBy("c_nationkey").agg(F.count("*").alias("sources"))
    t = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(sources, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n_nationkey"), F.col("embedding").alias("profile")).where("n_nationkey % 4 <> 1")
    key = F.col("n_nationkey")
    status = F.element_at(F.array(*map(F.lit, ("search_ready", "retrieval_kg_ready", "parsed_ready", "full_kg_ready"))), key.cast("int") % 4 + 1)
    label = F.struct(F.concat(F.lit("please "), "n_name").alias("label"), F.when(key % 2 == 0, 1.0).otherwise(0.5).alias("weight"), (key / 1000.0).alias("score"))
    return t.join(e, "n_nationkey", "left").select(
        F.concat(F.lit("t"), "n_nationkey").alias("theme_id"), F.col("n_name").alias("theme_name"), F.col("r_name").alias("collection"), status.alias("status"),
        F.coalesce("sources", F.lit(0)).alias("sources"), F.array((key + 1980).cast("int")).alias("years"), F.col("n_name").alias("ontology_text"),
        F.concat_ws(" ", "n_name", "r_name").alias("keyword_text"), F.array(label).alias("central"), "profile",
    )


def route_themes(spark, sf_dir):
    return search.route_themes(_routable(spark, sf_dir), QUESTION, max_themes=12, min_score=0.0)


def route_by_vectors(spark, sf_dir):
    return search.route_themes(_routable(spark, sf_dir), QUESTION, VECTOR, max_themes=12, min_score=0.0)


def route_fallback(spark, sf_dir):
    """Nothing fits the question, so the first ready themes are taken."""
    return search.route_themes(_routable(spark, sf_dir).withColumn("sources", F.lit(0)), "qqq", max_themes=6)


def readiness_state(spark, sf_dir):
    """Nations as themes, with statuses dealt by key."""
    status = F.element_at(F.array(*map(F.lit, ("not_ready", "parsed_ready", "search_ready", "cheap_kg_ready", "full_kg_ready"))), F.col("n_nationkey") % 5 + 1)
    t = table(spark, sf_dir, "nation").select("n_nationkey", status.alias("status"), F.col("n_nationkey").cast("long").alias("sources"))
    return store.knowledge_state(t)


def cosine_topk(spark, sf_dir):
    return search.nearest(table(spark, sf_dir, "embeddings"), [1.0 if i % 2 else -1.0 for i in range(64)], 20)


def vector_batch(spark, sf_dir):
    """The ten nearest of all vectors for each vector whose id 50 divides."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest_batch(vectors.build_index(rows), rows.where("vec_id % 50 = 0"), 10).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "similarity", "rank")


def theme_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (
    edge_counts, node_counts, cooccurrence, cooccurrence_capped, facts_by_property, cheap_kg, band_similarity, components, components_grown, degree_density, degrees_grown,
    graph_health, pagerank, degree_share, weighted_centrality, betweenness, retrieval_index, validate_store, store_stats, merge_entities,
    interval_facts, constraint_batch, route_themes, route_by_vectors, route_fallback, readiness_state, cosine_topk, vector_batch, theme_centroids, event_windows,
)}

_ENTITIES = """per_chunk AS (SELECT DISTINCT chunk_id, e FROM (SELECT chunk_id, brand AS e FROM lines UNION ALL SELECT chunk_id, kind FROM lines))"""
_CUSTOMERS = """edges AS (
    SELECT DISTINCT src, dst FROM (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
    UNION ALL SELECT 'c' || c_custkey, 's' || c_mktsegment FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
), vertices AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""
_SAME = """ends AS (SELECT doc_id, 'f:' || string_split(text, chr(10))[1] AS k FROM documents UNION ALL SELECT doc_id, 'l:' || string_split(text, chr(10))[-1] FROM documents),
    e1 AS (SELECT doc_id AS src, dst FROM ends JOIN (SELECT k, min(doc_id) AS dst FROM ends GROUP BY k) USING (k) WHERE doc_id <> dst),
    near AS (SELECT src AS a, dst AS b FROM e1 UNION SELECT dst, src FROM e1),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)"""
#: Rounds one after the other; each is kept, as the next one reads it twice.
_PAGERANK_ROUNDS = "".join(
    f""", r{i} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM edges)) / n + 0.85 * coalesce(got, 0) AS rank
        FROM total, vertices v LEFT JOIN (SELECT f.dst, sum(p.rank * f.share) AS got FROM r{i - 1} p JOIN flow f ON f.src = p.id GROUP BY f.dst) g ON g.dst = v.id)"""
    for i in range(1, CENTRAL_ROUNDS + 1)
)
_ROUND = _PAGERANK_ROUNDS.index(f", r{ROUNDS + 1} AS")
#: The change of each round, and the first round that changes ranks by less than the limit.
_SETTLED = ", settled AS (SELECT coalesce(min(i), {last}) AS round FROM ({rounds}) WHERE change < (SELECT n FROM total) * {limit})".format(
    last=CENTRAL_ROUNDS, limit=TOLERANCE, rounds=" UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS change FROM r{i} a JOIN r{i - 1} b USING (id)" for i in range(1, CENTRAL_ROUNDS + 1))
)
_ALL_ROUNDS = " UNION ALL ".join(f"SELECT {i} AS i, id, rank FROM r{i}" for i in range(1, CENTRAL_ROUNDS + 1))

DEPTH = 8
#: Breadth first, level by level, and back: what each node owes to paths through it. No path of the customer graph is longer than ``DEPTH``.
_LEVELS = "".join(
    f""", l{i} AS (SELECT root, b AS node, sum(paths) AS paths FROM l{i - 1} JOIN near ON a = node
        WHERE (root, b) NOT IN ({' UNION ALL '.join(f'SELECT (root, node) FROM l{j}' for j in range(i))}) GROUP BY root, b)"""
    for i in range(1, DEPTH + 1)
) + f", o{DEPTH} AS (SELECT root, node, paths, 0.0::DOUBLE AS owed FROM l{DEPTH})" + "".join(
    f""", o{i} AS (SELECT l.root, l.node, l.paths, l.paths * coalesce(sum((1 + o.owed) / o.paths), 0) AS owed FROM l{i} l
        LEFT JOIN (near JOIN o{i + 1} o ON near.b = o.node) ON near.a = l.node AND o.root = l.root GROUP BY l.root, l.node, l.paths)"""
    for i in range(DEPTH - 1, -1, -1)
)
_OWED = " UNION ALL ".join(f"SELECT root, node, owed FROM o{i}" for i in range(DEPTH + 1))
_ROUTES = f"""WITH t AS (
    SELECT n_nationkey AS k, 't' || n_nationkey AS theme_id, n_name, r_name, lower(n_name) AS o, lower(n_name || ' ' || r_name) AS kt, lower(r_name) AS c,
        (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS sources, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END * least(1.0, n_nationkey / 1000.0 * 10 + 0.1) AS central,
        e.embedding IS NOT NULL AS has, greatest(0.0, coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), {VECTOR}), 0.0)) AS vec
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN embeddings e ON e.vec_id = n_nationkey AND n_nationkey % 4 <> 1 WHERE n_nationkey % 4 <> 2),
    q AS (SELECT ['1995', 'and', 'nation_3', 'please', 'region_1'] AS q),
    parts AS (SELECT *, len(list_filter(q, lambda x: contains(o, x))) / 5 AS onto, len(list_filter(q, lambda x: contains(kt, x))) / 5 AS kw, array_to_string(list_filter(q, lambda x: contains(kt, x)), ', ') AS why,
        least(1.0, CASE WHEN contains('nation_3 and region_1 in 1995 please', o) THEN 0.6 ELSE 0 END + CASE WHEN contains('nation_3 and region_1 in 1995 please', c) THEN 0.25 ELSE 0 END
            + CASE WHEN k + 1980 = 1995 THEN 0.35 ELSE 0 END) AS meta FROM t, q)"""
_PLAIN = "(0.35 * onto + 0.35 * kw + 0.15 * least(1.0, central) + 0.15 * meta)"
_WITH_VECTOR = "(0.35 * vec + 0.25 * onto + 0.20 * kw + 0.10 * least(1.0, central) + 0.10 * meta)"
_ROUTE_COLUMNS = """theme_id, CAST(round_even({score} + CASE WHEN sources > 0 THEN 0.02 ELSE 0 END, 4) AS DOUBLE) AS route_score, CAST(round_even({vector}, 4) AS DOUBLE) AS vector, round_even(onto, 4) AS ontology,
    round_even(kw, 4) AS keyword, CAST(round_even(least(1.0, central), 4) AS DOUBLE) AS centrality, CAST(round_even(meta, 4) AS DOUBLE) AS metadata, CASE WHEN why = '' THEN 'weak lexical/semantic match' ELSE why END AS reason"""

SQL = {
    "edge_counts": f"WITH {TRIPLES_SQL} SELECT predicate, object_id, count(*) AS weight FROM triples WHERE predicate = 'MENTIONS' GROUP BY 1, 2",
    "node_counts": f"""WITH {TRIPLES_SQL} SELECT node_id, count(*) AS n FROM (SELECT subject_id AS node_id FROM triples UNION ALL SELECT object_id FROM triples)
        GROUP BY 1 ORDER BY n DESC, node_id LIMIT 50""",
    "cooccurrence": f"""WITH {LINES_SQL}, {_ENTITIES} SELECT a.e AS subject_id, 'CO_OCCURS_IN_CHUNK' AS predicate, b.e AS object_id, count(*) AS weight
        FROM per_chunk a JOIN per_chunk b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY 1, 3""",
    "cooccurrence_capped": f"""WITH {LINES_SQL}, {_ENTITIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY e) AS rn FROM per_chunk)
        SELECT a.e AS subject_id, 'CO_OCCURS_IN_CHUNK' AS predicate, b.e AS object_id, count(*) AS weight
        FROM ranked a JOIN ranked b ON a.chunk_id = b.chunk_id AND a.e < b.e WHERE a.rn <= 3 AND b.rn <= 3 GROUP BY 1, 3""",
    "facts_by_property": f"WITH {FACTS_SQL} SELECT property_id, unit, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY 1, 2",
    "cheap_kg": f"""WITH {TRIPLES_SQL}, {_ENTITIES}, {FACTS_OF_LINES_SQL}, counted AS (
        SELECT 'node' AS kind, k AS key, count(*) AS n FROM (SELECT subject_id AS k FROM triples UNION ALL SELECT object_id FROM triples) GROUP BY k
        UNION ALL SELECT 'edge', subject_id || ' ' || predicate || ' ' || object_id, count(*) FROM triples GROUP BY subject_id, predicate, object_id
        UNION ALL SELECT 'cooccurrence', a.e || ' CO_OCCURS_IN_CHUNK ' || b.e, count(*) FROM per_chunk a JOIN per_chunk b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY a.e, b.e
        UNION ALL SELECT 'property', property_id, count(*) FROM facts GROUP BY property_id UNION ALL SELECT 'unit', unit, count(*) FROM facts GROUP BY unit)
        SELECT kind, key, n FROM counted QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= 20""",
    "band_similarity": r"""WITH t AS (SELECT DISTINCT p_name AS id FROM part), ranked AS (
        SELECT id, row_number() OVER (ORDER BY id) AS rn, list_distinct(regexp_extract_all(lower(id), '[0-9a-zа-яё_.+-]{2,}')) AS w FROM t), pairs AS (
        SELECT a.id AS subject_id, b.id AS object_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j,
            len(list_intersect(list_transform(list_filter(a.w, lambda x: length(x) >= 5), lambda x: x[1:5]), list_transform(list_filter(b.w, lambda x: length(x) >= 5), lambda x: x[1:5]))) > 0 AS p
        FROM ranked a JOIN ranked b ON b.rn BETWEEN a.rn + 1 AND a.rn + 400 AND a.rn <= 3000)
        SELECT subject_id, object_id, CAST(greatest(1, round_even(10 * s, 0)) AS BIGINT) AS weight, round(s, 6) AS similarity
        FROM (SELECT *, greatest(j, CASE WHEN p THEN 0.35 ELSE 0 END) AS s FROM pairs) WHERE s >= 0.35 ORDER BY s DESC, subject_id DESC, object_id DESC LIMIT 2000""",
    "components": f"WITH RECURSIVE {_SAME} SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a",
    "components_grown": f"WITH RECURSIVE {_SAME} SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a",
    "degrees_grown": f"""WITH {_CUSTOMERS}, near AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)
        SELECT id, count(b) AS degree FROM vertices LEFT JOIN near ON a = id GROUP BY id""",
    "degree_density": f"""WITH {_CUSTOMERS}, near AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)
        SELECT id, count(b) AS degree FROM vertices LEFT JOIN near ON a = id GROUP BY id""",
    "graph_health": f"""WITH RECURSIVE {_SAME}, d AS (SELECT doc_id, count(b) AS degree FROM documents LEFT JOIN near ON a = doc_id GROUP BY doc_id), s AS (
        SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, count(*) FILTER (WHERE degree = 0) AS isolated,
            (SELECT count(DISTINCT c) FROM (SELECT min(b) AS c FROM reach GROUP BY a)) AS components FROM d)
        SELECT nodes, edges, isolated, round(2 * edges / nodes, 6) AS average_degree, round(2 * edges / (nodes * (nodes - 1)), 8) AS density, components,
            CASE WHEN isolated > greatest(10, floor(nodes * 0.25)) THEN 'weak_graph' WHEN components > greatest(10, floor(nodes * 0.15)) THEN 'split_needed' ELSE 'ok' END AS health FROM s""",
    "pagerank": f"""WITH {_CUSTOMERS}, total AS (SELECT count(*) AS n FROM vertices), flow AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM edges),
        r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM vertices, total){_PAGERANK_ROUNDS[:_ROUND]} SELECT id, round(rank, 10) AS rank FROM r{ROUNDS}""",
    "degree_share": f"""WITH {_CUSTOMERS}, own AS (SELECT id, count(*) AS w FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
        SELECT id, round(w / (SELECT sum(w) FROM own), 6) AS centrality FROM own""",
    "retrieval_index": f"""WITH {TRIPLES_SQL}, {_ENTITIES}, n AS (SELECT object_id AS e, count(*) AS n FROM triples WHERE predicate = 'MENTIONS' GROUP BY 1),
        central AS (SELECT e, round_even(n / (SELECT sum(n) FROM n), 8) AS c FROM n),
        per AS (SELECT chunk_id, count(*) AS entities, sum(c) FILTER (WHERE rn <= 16) AS c FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY e) AS rn FROM per_chunk) JOIN central USING (e) GROUP BY 1),
        f AS (SELECT chunk_id, 3 * count(*) AS k FROM lines GROUP BY 1)
        SELECT 'order:' || o_orderkey AS chunk_id, coalesce(k, 0) AS numeric_fact_count, coalesce(k, 0) AS triple_count, coalesce(entities, 0) AS entities,
            CASE WHEN k IS NULL THEN '' ELSE 'dollars,pieces,share' END AS units,
            CAST(floor(round(least(2.0, coalesce(k, 0) * 0.35) + least(2.0, coalesce(entities, 0) * 0.12) + coalesce(c, 0) * 10, 4) * 100 + 1e-6) AS BIGINT) AS boost_cents
        FROM orders LEFT JOIN per ON per.chunk_id = 'order:' || o_orderkey LEFT JOIN f ON f.chunk_id = 'order:' || o_orderkey""",
    "validate_store": f"""WITH {LINES_SQL}, s AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT 'error' AS level, 'chunk with unknown source_id' AS rule, count(*) AS n FROM lines WHERE chunk_id NOT IN (SELECT id FROM s)
        UNION ALL SELECT 'error', 'chunk without text', count(*) FROM lines WHERE quantity % 5 = 0
        UNION ALL SELECT 'error', 'fact with a value and no unit', count(*) FROM lines
        UNION ALL SELECT 'warning', 'duplicate chunk_id', count(*) FROM (SELECT line_id FROM lines GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""",
    "store_stats": f"""WITH {LINES_SQL} SELECT 'rows' AS kind, 'triples' AS key, 3 * count(*) AS n FROM lines UNION ALL SELECT 'rows', 'numeric_facts', 3 * count(*) FROM lines
        UNION ALL SELECT 'rows', 'sources', count(*) FROM orders
        UNION ALL SELECT 'facts_by_property', unnest(['quantity', 'price', 'discount']), count(*) FROM lines""",
    "merge_entities": """SELECT p_brand AS entity_id, p_brand || CASE WHEN max(l_linenumber) = 2 THEN ' new' ELSE ' old' END AS label,
        array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS source_ids FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2 GROUP BY p_brand""",
    "interval_facts": f"""WITH {FACTS_SQL} SELECT fact_id, property_id, value FROM facts
        WHERE (property_id = 'quantity' AND value BETWEEN 10 AND 12) OR (property_id = 'price' AND value >= 90000) OR (property_id = 'discount' AND value = 0.05)""",
    "constraint_batch": f"""WITH {FACTS_SQL}, c AS (SELECT o_orderkey % 5 AS kind, o_totalprice / 4 AS p, o_custkey AS cust, 'onto:brand_' || (o_custkey % 5 + 1) || (o_orderkey % 5 + 1) AS brand FROM orders)
        SELECT fact_id, property_id, value FROM facts f WHERE (property_id = 'price' AND EXISTS (SELECT 1 FROM c WHERE kind = 0 AND f.value BETWEEN p - 1 AND p))
            OR (property_id = 'price' AND value >= (SELECT min(20000 + p) FROM c WHERE kind = 1 AND c.brand = f.brand))
            OR (property_id = 'quantity' AND value <= (SELECT max(cust % 3) FROM c WHERE kind = 2 AND c.brand = f.brand))
            OR value IN (SELECT floor(p) + 0.5 FROM c WHERE kind = 3)
            OR (property_id = 'discount' AND value >= 0.09 AND brand IN (SELECT brand FROM c WHERE kind = 4))""",
    "route_themes": f"""{_ROUTES} SELECT {_ROUTE_COLUMNS.format(vector='0.0', score=_PLAIN)} FROM parts ORDER BY route_score DESC, theme_id LIMIT 12""",
    "route_by_vectors": f"""{_ROUTES} SELECT {_ROUTE_COLUMNS.format(vector='vec', score=f'CASE WHEN has THEN {_WITH_VECTOR} ELSE {_PLAIN} END')} FROM parts ORDER BY route_score DESC, theme_id LIMIT 12""",
    "route_fallback": f"""SELECT 't' || n_nationkey AS theme_id, 0.0::DOUBLE AS route_score, 0.0::DOUBLE AS vector, 0.0::DOUBLE AS ontology, 0.0::DOUBLE AS keyword, 0.0::DOUBLE AS centrality, 0.0::DOUBLE AS metadata,
        'fallback_ready_theme' AS reason FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 2 ORDER BY r_name, n_name, theme_id LIMIT 6""",
    "readiness_state": """WITH t AS (SELECT n_nationkey AS k, ['not_ready', 'parsed_ready', 'search_ready', 'cheap_kg_ready', 'full_kg_ready'][n_nationkey % 5 + 1] AS status FROM nation),
        r AS (SELECT k, status, CASE status WHEN 'parsed_ready' THEN 1 WHEN 'search_ready' THEN 2 WHEN 'cheap_kg_ready' THEN 3 WHEN 'full_kg_ready' THEN 5 ELSE 0 END AS rank FROM t)
        SELECT count(*) AS themes, count(*) FILTER (WHERE rank >= 2) AS search_ready, count(*) FILTER (WHERE rank >= 3) AS graph_ready, arg_max(status, rank) AS best_status, CAST(sum(k) AS BIGINT) AS sources FROM r""",
    "weighted_centrality": f"""WITH {_CUSTOMERS}, total AS (SELECT count(*) AS n FROM vertices), both_ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
        flow AS (SELECT a AS src, b AS dst, count(*) / sum(count(*)) OVER (PARTITION BY a) AS share FROM both_ways WHERE a <> b GROUP BY a, b),
        r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM vertices, total){_PAGERANK_ROUNDS.replace('NOT IN (SELECT src FROM edges)', 'NOT IN (SELECT src FROM flow)')}{_SETTLED}
        SELECT id, round(round_even(rank, 8), 7) AS centrality FROM ({_ALL_ROUNDS}) WHERE i = (SELECT round FROM settled)""",
    "betweenness": f"""WITH {_CUSTOMERS}, near AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
        degree AS (SELECT id, count(b) AS d FROM vertices LEFT JOIN near ON a = id GROUP BY id), high AS (SELECT id FROM degree ORDER BY d DESC, id LIMIT 16),
        roots AS (SELECT id FROM high UNION ALL SELECT id FROM (SELECT id FROM vertices WHERE id NOT IN (SELECT id FROM high) ORDER BY md5('13:' || id), id LIMIT 16)),
        l0 AS (SELECT id AS root, id AS node, 1.0::DOUBLE AS paths FROM roots){_LEVELS}
        SELECT id, round(coalesce(s, 0) / 32, 6) AS betweenness FROM vertices LEFT JOIN (SELECT node, sum(owed) AS s FROM ({_OWED}) WHERE root <> node GROUP BY node) ON node = id""",
    "cosine_topk": f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {[1.0 if i % 2 else -1.0 for i in range(64)]}), 4) AS similarity
        FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20""",
    "vector_batch": """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS similarity,
        CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) DESC, v.vec_id) AS INT) AS rank
        FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""",
    "theme_centroids": """SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2""",
    "event_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
