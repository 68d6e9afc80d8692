"""Queries over themes, documents, runs and facts as a store keeps them, made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import answers, evidence, graph, kg, search, selection, store, themes, upkeep
from ..operators.extraction import Ontology, Term, extract_facts, parse_queries
from ..workspace import Workspace
from .fixtures import FACTS_SQL, LINES_SQL, facts, lines, table, triples

STATUSES = ["failed", "not_ready", "parsed_ready", "search_ready", "cheap_kg_ready", "retrieval_kg_ready", "compressed_kg_ready", "full_kg_ready"]
#: Paths of documents, in which {n} stands for a part's name and {y} for a year.
PATHS = [
    "articles/{n}/x.pdf", "in/журнал/data/{n}.pdf", "{n}.txt", "a/b/{n} final {y}.docx", "patents/2001/files/p.pdf", "SO2 removal/{n}.pdf", "docs/mine water.txt", "books/gost/{n}.pdf",
    "x/{y}/slag {n}.txt", "misc/документы.pdf", "root/reports/{n}/{y}/r.pdf", "x/data.csv", "ALTA {y} Ni and Co.pdf", "presentations/{n}.pptx", "x/mhp {n}.txt", "z/files.txt",
]
CONTENTS = ["", "about mixed hydroxide", "a conference talk", "ppv was low", "plain words"]
SMALL = Ontology(
    (
        Term("bolt", "Part", ("bolt", "болт"), ("screw",), ("gear",)),
        Term("gear", "Part", ("gear", "шестерня"), ("cog", "wheel", "toothed wheel", "spur"), ("bolt", "red")),
        Term("red", "Colour", ("red",), ("crimson",)),
    ),
    {"temperature": ("temperature", "heat"), "concentration": ("sulfate", "concentration")},
    {"foreign": ("world", "abroad"), "domestic": ("domestic", "local")},
)
ASKED = ["compare {n} with others in the world", "why is {n} hot, last 5 years", "evidence of {n} since 1999 and 2005", "what if sulfate ≤ 300 mg/L for {n}", "recommend a {n} for local use at 20 °C", "{n}"]


def _pick(words: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


# themes


def _resolved(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    path = F.replace(F.replace(_pick(PATHS, k), F.lit("{n}"), F.col("p_name")), F.lit("{y}"), (k % 60 + 1960).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("relative_path"), _pick(CONTENTS, k).alias("preview"), (k % 4).alias("chunks"))
    return themes.resolve(rows, themes.ThemeRules(least_confidence=0.72))


def theme_rules(spark, sf_dir):
    names = ("p_partkey", "theme_id", "collection", "theme_name", "source_name", "source_type", "confidence")
    return _resolved(spark, sf_dir).select(*names, F.coalesce("year", F.lit(0)).alias("year"), F.array_join("evidence", ";").alias("evidence"))


def theme_preview(spark, sf_dir):
    rows = themes.theme_distribution(_resolved(spark, sf_dir).withColumn("relative_path", F.concat("relative_path", F.lit("."), "p_partkey")), least_documents=20)
    return rows.select("theme_id", "documents", "chunks", F.array_join("examples", "; ").alias("examples"), F.array_join("evidence", ", ").alias("evidence"), "is_small")


def themes_by_size(spark, sf_dir):
    return themes.documents_by_theme(_resolved(spark, sf_dir), 5)


def stamped_chunks(spark, sf_dir):
    """Lines get the theme of their part's document; their own columns of that name give way."""
    t = _resolved(spark, sf_dir).withColumnRenamed("relative_path", "path").withColumn("relative_path", F.col("p_partkey").cast("string"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("relative_path"), F.lit("own").alias("theme_id"), "l_quantity")
    return themes.stamped(li, t).groupBy("theme_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def _themes(spark, sf_dir) -> DataFrame:
    """Nations as themes: theme_id, theme_name, collection, status, years."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("t"), key).alias("theme_id"), F.col("n_name").alias("theme_name"), F.when(key % 6 != 0, F.col("r_name")).alias("collection"), _pick(STATUSES, key).alias("status"),
        F.array((key % 3 + 2000).cast("int"), (key % 5 + 2000).cast("int")).alias("years"), "n_nationkey",
    )


def theme_upsert(spark, sf_dir):
    t = _themes(spark, sf_dir).drop("n_nationkey").withColumn("years", F.array_sort(F.array_distinct("years")))
    new = t.where("theme_id LIKE '%1'").withColumn("years", F.array(F.lit(1999), F.lit(2001))).withColumn("status", F.lit("search_ready"))
    return store.upsert_themes(t, new).select("theme_id", "status", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


def catalog_order(spark, sf_dir):
    """The catalog with themes that only customers' sources name, in order."""
    t = _themes(spark, sf_dir).where("n_nationkey % 4 <> 0").select("theme_id", "theme_name", "collection", "status")
    s = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), "c_nationkey").alias("theme_id"), F.concat(F.lit("s"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("source_id"), F.lit(None).cast("string").alias("collection"),
        F.col("c_mktsegment").alias("theme_name"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("source_type"),
    )
    rows = upkeep.catalog(upkeep.recovered_themes(t, s))
    return rows.select("theme_id", "theme_name", F.coalesce("collection", F.lit("")).alias("collection"), "status").limit(20)


def build_targets(spark, sf_dir):
    """Themes below a readiness, those that selectors name, and both."""
    t = _themes(spark, sf_dir)
    parts = [
        ("below", upkeep.below_target(t, "retrieval_kg_ready")), ("first", upkeep.below_target(t, "full_kg_ready", limit=4)),
        ("named", upkeep.select_themes(t, ["t3", "nation-7", "GION_2"])), ("forced", upkeep.below_target(t, "parsed_ready", force=True, selectors=["NATION_1"])),
    ]
    rows = [df.select(F.lit(kind).alias("kind"), "theme_id") for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# documents and runs


def _sources(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("s"), k).alias("source_id"), F.when(k % 4 != 0, F.concat("c_mktsegment", F.lit("/"), k)).alias("original_path"), F.col("c_name").alias("source_name"),
        F.concat(F.lit("t"), "c_nationkey").alias("theme_id"), (k * 10).alias("total_chars"), F.when(k % 2 == 0, k % 5).alias("objects_count"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("updated_at"),
    )


def document_list(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.concat(F.lit("s"), "o_custkey").alias("source_id"))
    rows = upkeep.list_documents(_sources(spark, sf_dir), chunks, _themes(spark, sf_dir), limit=100)
    return rows.select("id", "filename", "status", "theme_id", F.coalesce("collection", F.lit("")).alias("collection"), F.col("chars").cast("long").alias("chars"), F.col("chunks").cast("long").alias("chunks"), "updated_at")


def recent_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("run:"), "event_id").alias("run_id"), F.date_trunc("hour", "ts").alias("created_at"))
    return upkeep.recent_runs(e, 50).select("run_id")


def latest_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("f"), "user_id").alias("file_name"), F.date_trunc("day", "ts").alias("updated_at"))
    return upkeep.latest_documents(e).select("doc_id", "file_name")


def _states(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = _pick(["pending", "processed", "failed", "duplicate", "processing", "failed"], F.col("event_id"))
    return e.select(F.concat(F.lit("f"), "user_id").alias("file_name"), status.alias("status"), F.col("event_id").alias("updated_at"))


def queued_outcomes(spark, sf_dir):
    queued = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("file_name"))
    return upkeep.queued_outcomes(queued, _states(spark, sf_dir))


def status_counts(spark, sf_dir):
    return upkeep.status_counts(_states(spark, sf_dir))


def deleted_source(spark, sf_dir):
    """Rows of each table after a source has gone, which entities outlive."""
    s = _sources(spark, sf_dir)
    entities = s.groupBy(F.col("theme_id").alias("entity_id")).agg(F.array_sort(F.collect_list("source_id")).alias("source_ids"))
    left = store.delete_source({"sources": s, "entities": entities, "themes": _themes(spark, sf_dir)}, "s7")
    kept = F.sum(F.size("source_ids")).cast("long")
    rows = [left["sources"].agg(F.count("*").alias("n")).select(F.lit("sources").alias("what"), "n"), left["entities"].agg(kept.alias("n")).select(F.lit("source_ids").alias("what"), "n")]
    rows.append(left["themes"].agg(F.count("*").alias("n")).select(F.lit("themes").alias("what"), "n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def quality_report(spark, sf_dir):
    """Nations as themes, customers as sources, their orders as facts, some without unit or chunk."""
    s = _sources(spark, sf_dir).where("theme_id <> 't3'")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    f = o.where("c_nationkey % 2 = 1").select(
        F.concat(F.lit("t"), "c_nationkey").alias("theme_id"), F.when(k % 9 != 0, "C").alias("unit"), F.when(F.col("c_nationkey") != 5, F.lit("c")).alias("chunk_id"), F.when(k % 2 == 0, 1.0).alias("value")
    )
    health = _themes(spark, sf_dir).select("theme_id", _pick(["ok", "weak_graph", "split_needed"], F.col("n_nationkey")).alias("graph_health"))
    rows = upkeep.quality_report(s, f, health)
    return rows.select("theme_id", "sources", "numeric_facts", "facts_without_unit", "facts_without_chunk", F.array_join("issues", ",").alias("issues"))


def imported_facts(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "fact:").otherwise(""), (F.col("o_orderkey") % 500).cast("string")).alias("fact_id"))
    kept = upkeep.import_facts(old, old.limit(3)).select(F.lit("kept").alias("kind"), F.lit("").alias("fact_id")).limit(1)
    return upkeep.import_facts(old, None).select(F.lit("imported").alias("kind"), "fact_id").unionByName(kept)


# profiles and vectors


def profile_texts(spark, sf_dir):
    """Customers' themes by orders as chunks; profiles within a budget that cuts the last one."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tags = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(F.col("o_orderpriority"), F.lit(" of "), F.col("c_name"), F.when(F.col("o_orderkey") % 5 == 0, F.repeat(F.lit(" x"), 400)).otherwise(""))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.translate(text, "0123456789", "")).otherwise(text)
    chunks = o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("chunk_id"), F.concat(F.lit("t"), "c_nationkey").alias("theme_id"), text.alias("text"), tags.alias("domain_tags"))
    rows = upkeep.profile_texts(_themes(spark, sf_dir).withColumn("collection", F.coalesce("collection", F.lit("none"))), chunks, most_chunks=6, most_chars=1500)
    return rows.select("theme_id", F.length("profile").cast("long").alias("chars"), "content_hash")


def reused_vectors(spark, sf_dir):
    """Vectors of unchanged profiles stay, others are made anew."""
    p = _themes(spark, sf_dir).select("theme_id", F.col("theme_name").alias("profile"), F.substring(F.sha1("theme_name"), 1, 16).alias("content_hash"), "n_nationkey")
    stored = p.where("n_nationkey % 3 <> 0").select("theme_id", F.when(F.col("n_nationkey") % 3 == 1, F.col("content_hash")).otherwise("old").alias("content_hash"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    rows = upkeep.theme_embeddings(p.drop("n_nationkey"), stored)
    return rows.select("theme_id", "content_hash", (F.size("embedding") == 1).alias("kept"))


def mean_vectors(spark, sf_dir):
    rows = upkeep.mean_vectors(table(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.select("label", "dim", F.round("x", 5).alias("mean"))


# graphs


def _store_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    entities = table(spark, sf_dir, "nation").select(F.concat(F.lit("onto:n"), "n_nationkey").alias("entity_id"))
    return graph.store_graph(entities, facts(spark, sf_dir), triples(spark, sf_dir))


def store_graph(spark, sf_dir):
    """Vertices and distinct edges by kind of end."""
    vertices, edges = _store_graph(spark, sf_dir)
    kind = lambda c: F.substring_index(c, ":", 1)
    rows = vertices.groupBy(kind("id").alias("kind")).agg(F.count("*").alias("n"))
    return rows.unionByName(edges.groupBy(F.concat(kind("src"), F.lit(">"), kind("dst")).alias("kind")).agg(F.count("*").alias("n")))


def retrieval_edges(spark, sf_dir):
    """The heaviest edges of the retrieval graph, in which facts' entities count beside triples."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("onto:"), F.translate(F.lower("p_brand"), " #", "__")).alias("id")).distinct()
    similar = kg.similarity_edges(parts.withColumn("label", F.regexp_replace("id", "onto:", "")))
    edges = kg.retrieval_edges(triples(spark, sf_dir), facts(spark, sf_dir), similar).where("predicate <> 'CONTAINS'")
    return edges.orderBy(F.desc("weight"), "subject_id", "predicate", "object_id").limit(40)


def graph_metrics(spark, sf_dir):
    """Of customers, nations and regions: scalars, and the vertices of highest degree."""
    from .graph_queries import _customer_graph

    vertices, edges = _customer_graph(spark, sf_dir)
    labels = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    m = graph.graph_metrics(vertices, edges, labels, Workspace(spark, "metrics"), top_n=5, iterations=2, sample=2)
    m = Workspace(spark, "metrics").save(m, "document")
    best = F.array_join(F.transform(F.filter("tops", lambda t: t["kind"] == "top_degree"), lambda t: F.concat(t["label"], F.lit("="), t["score"].cast("int"))), ",")
    return m.select("nodes", "edges", "isolated", "components", "health", "largest_component_size", F.round("largest_component_ratio", 4).alias("largest_component_ratio"), best.alias("top_degree"), F.size("tops").cast("long").alias("listed"))


# facts and questions


def expanded_terms(spark, sf_dir):
    """Labels of the terms of each part's name, those of neighbours after them, by joins over the ontology's tables."""
    t = SMALL.tables(spark)
    rows = [(term.term_id, i, x) for term in SMALL.terms for i, x in enumerate(SMALL.expand([term.term_id]))]
    made = spark.createDataFrame(rows, "term_id string, place int, label string")
    return made.join(t["terms"], "term_id").select("term_id", "class_name", "place", "label")


def parsed_questions(spark, sf_dir):
    """Intents, terms, places, years, facets and numbers of questions about parts."""
    k = F.col("p_partkey")
    q = table(spark, sf_dir, "part").select(k.alias("question_id"), F.replace(_pick(ASKED, k), F.lit("{n}"), F.col("p_name")).alias("text"))
    rows = parse_queries(q, SMALL, 2024)
    join = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("question_id", "intent", join("term_ids"), join("places"), F.coalesce("year_from", F.lit(0)).alias("year_from"), F.coalesce("year_to", F.lit(0)).alias("year_to"), join("facets"), join("constraints"))


def fact_search(spark, sf_dir):
    """The best facts for a question with numbers, a brand, and words of the context."""
    f = facts(spark, sf_dir).withColumns({"context": F.concat(F.lit("held in "), "property_id", F.lit(" by "), "chunk_id"), "confidence": F.col("value") % 7 / 10, "source_name": F.col("source_id")})
    c = spark.createDataFrame(
        [("quantity", ">=", 40.0, None, None), ("discount", "range", 0.02, 0.04, ["onto:brand_11"])],
        "c_dimension string, c_operator string, c_value double, c_value_max double, c_entity_ids array<string>",
    )
    rows = search.fact_search(f, c, ["onto:brand_11"], ["quantity", "Order:1", "none of it"], limit=30, places=["discount"])
    return rows.select("fact_id", "fact_score", F.round("confidence", 6).alias("confidence"))


def fact_confidence(spark, sf_dir):
    """Property and confidence by the distance of a name from the number, with the terms around it."""
    k = F.col("p_partkey")
    gap = F.repeat(F.lit("x"), (k % 31 * 3).cast("int"))
    text = F.concat(F.when(k % 3 != 0, F.concat(F.lit("sulfate "), gap)).otherwise("amount"), F.lit(" "), (k % 50 + 1).cast("string"), F.lit(" mg/L "), F.col("p_name"))
    rows = extract_facts(table(spark, sf_dir, "part").select(k.cast("string").alias("object_id"), F.lit("s").alias("source_name"), text.alias("text")), SMALL)
    return rows.select("object_id", "property_id", "value", F.round("confidence", 4).alias("confidence"), F.array_join("entity_ids", ",").alias("entities"))


def evidence_units(spark, sf_dir):
    """Scores of sentences made of parts' names, by words, numbers with units, signals of the domain and contacts."""
    k = F.col("p_partkey")
    text = F.concat(F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit(" at "), k % 30, F.lit(" мг/л"))).otherwise(""), F.when(k % 3 == 0, " leaching").otherwise(""), F.when(k % 5 == 0, " результат ").otherwise(""), F.when(k % 7 == 0, " a@b").otherwise(""), F.when(k % 11 == 0, F.repeat(F.lit(" y"), 300)).otherwise(""))
    score = evidence.unit_score(text, F.array(F.lit("bolt"), F.lit("gear")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


def answer_claims(spark, sf_dir):
    """Claims for each part as a question, from its lines as hits: a sentence with a number and one without."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("int")
    text = F.concat(
        F.lit("In the leaching run of supplier "), "l_suppkey", F.lit(" it was held at "), n, F.lit(" мг/л of acid. The operators of order "),
        F.col("l_orderkey") % 20, F.lit(" saw nothing else that was worth a word"), F.when(F.col("l_linenumber") % 2 == 0, " and went home").otherwise(""), F.lit("."),
    )
    hits = li.select(
        F.col("l_partkey").alias("question_id"), F.array(F.lit("acid"), F.lit("home")).alias("tokens"), F.concat_ws(".", *[F.lpad(c, 9, "0") for c in ("l_linenumber", "l_orderkey", "l_suppkey")], F.lpad(n, 9, "0")).alias("chunk_id"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("source_name"), (F.col("l_linenumber") % 3).cast("double").alias("score"), text.alias("text"),
    )
    return evidence.claims(hits)


def chunk_order(spark, sf_dir):
    """Lines in the order of their source: by line number where it is known, else by a number in the id."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("o"), "l_orderkey").alias("source_name"), F.concat(F.lit("chunk:"), F.col("l_linenumber") * 3, F.lit("x"), "l_suppkey").alias("chunk_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise("?").alias("page"))
    from pyspark.sql.window import Window

    order = selection.source_order(rows)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source_name").orderBy(*order[1:])).cast("long")).select("source_name", "chunk_id", "place")


QUERIES = {f.__name__: f for f in (
    theme_rules, theme_preview, themes_by_size, stamped_chunks, theme_upsert, catalog_order, build_targets, document_list, recent_runs, latest_documents, queued_outcomes, status_counts, deleted_source,
    quality_report, imported_facts, profile_texts, reused_vectors, mean_vectors, store_graph, retrieval_edges, graph_metrics, expanded_terms, parsed_questions, fact_search, fact_confidence, evidence_units, answer_claims,
    chunk_order,
)}


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _key_sql(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ё', 'е'), '[^0-9a-zа-я]', '', 'g')"


def _slug_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, 'ёЁ', 'еЕ'), '[^0-9A-Za-zА-Яа-я_.-]+', '_', 'g'), '_+', '_', 'g'), '_.-')"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])").replace("'", "''")


def _first_sql(rules: list, hay: str, place: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({hay}, '{_re2(r[0])}') THEN '{r[place]}'" for r in rules) + " END"


_ALIASES = ", ".join(f"'{k}': '{v}'" for k, v in themes.ThemeRules().aliases().items())
_GENERIC_KEYS = _list([themes._key(x) for x in themes.GENERIC])
_THEMES = f"""paths AS (SELECT p_partkey AS k, replace(replace({_list(PATHS)}[p_partkey % {len(PATHS)} + 1], '{{n}}', p_name), '{{y}}', CAST(p_partkey % 60 + 1960 AS VARCHAR)) AS path,
        {_list(CONTENTS)}[p_partkey % {len(CONTENTS)} + 1] AS content, p_partkey % 4 AS chunks FROM part),
    names AS (SELECT MAP {{{_ALIASES}}} AS m),
    p0 AS (SELECT *, string_split(path, '/') AS a FROM paths, names),
    p1 AS (SELECT *, CASE WHEN len(a) >= 3 AND m[{_key_sql('a[2]')}] IS NOT NULL AND m[{_key_sql('a[1]')}] IS NULL THEN a[2:] ELSE a END AS p FROM p0),
    p2 AS (SELECT *, p[-1] AS file, CASE WHEN len(p) > 1 THEN p[:-2] ELSE p END AS d, array_to_string(p, '/') || chr(10) || content AS hay FROM p1),
    p3 AS (SELECT *, list_position(list_transform(d, lambda x: m[{_key_sql('x')}] IS NOT NULL), true) AS pos,
        list_filter(flatten(list_transform(p, lambda x: regexp_extract_all(x, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1))), lambda x: true)[1] AS y FROM p2),
    p4 AS (SELECT *, CASE WHEN pos > 0 THEN m[{_key_sql('d[pos]')}] END AS coll, CASE WHEN pos > 0 AND len(p) > 1 THEN
        list_filter(d[pos + 1:], lambda x: m[{_key_sql('x')}] IS NULL AND {_key_sql('x')} <> '' AND NOT list_contains({_GENERIC_KEYS}, {_key_sql('x')}) AND NOT regexp_matches(trim(x), '^(?:19|20)[0-9][0-9]$'))[1] END AS themed,
        {_first_sql(themes.OVERRIDES, 'hay', 2)} AS o, {_first_sql(themes.OVERRIDES, 'hay', 1)} AS oc, {_first_sql(themes.OVERRIDES, 'hay', 3)} AS os,
        {_first_sql(themes.FILE_RULES, 'lower(file)', 1)} AS f, {_first_sql(themes.FILE_RULES, 'lower(file)', 2)} AS fs, {_first_sql(themes.CONTENT_RULES, 'lower(content)', 1)} AS c,
        nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file, '\\.[^./]+$', ''), '(?i)\\b(?:proceedings|article|final|draft|presentation)\\b', ' ', 'g'), '(^|[^0-9])(?:19|20)[0-9][0-9]($|[^0-9])', '\\1 \\2', 'g'),
            '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')), '') AS named FROM p3),
    p5 AS (SELECT *, CASE WHEN NOT list_contains({_GENERIC_KEYS}, {_key_sql('named')}) THEN named END AS auto FROM p4),
    p6 AS (SELECT *, coalesce(f, auto, c) AS told, coalesce(fs, CASE WHEN auto IS NOT NULL THEN 'filename:auto_theme' WHEN c IS NOT NULL THEN 'content_preview:domain_pattern' ELSE 'fallback:default_theme' END) AS says,
        CASE WHEN f IS NOT NULL THEN 0.75 WHEN auto IS NOT NULL THEN 0.60 WHEN c IS NOT NULL THEN 0.75 ELSE 0.25 END AS sure FROM p5),
    p7 AS (SELECT *, coalesce(oc, coll, CASE WHEN told = 'blasting_seismics' THEN 'геотехника' END, 'general') AS collection, coalesce(o, themed, told, 'general') AS theme,
        CASE WHEN o IS NOT NULL THEN 0.98 ELSE least(0.99, CASE WHEN themed IS NOT NULL THEN 0.85 ELSE greatest(CASE WHEN pos > 0 THEN 0.55 ELSE 0.25 END, sure) END + CASE WHEN y IS NOT NULL THEN 0.03 ELSE 0 END) END AS conf FROM p6),
    p8 AS (SELECT *, o IS NULL AND themed IS NULL AND f IS NULL AND auto IS NOT NULL AND theme <> 'general' AND conf < 0.72 AS falls FROM p7),
    resolved AS (SELECT k, path, chunks, {_slug_sql('collection')} || '__' || {_slug_sql("CASE WHEN falls THEN 'general' ELSE theme END")} AS theme_id, collection, CASE WHEN falls THEN 'general' ELSE theme END AS theme_name, file AS source_name,
        coalesce(os, MAP {{{', '.join(f"'{a}': '{b}'" for a, b in themes.SOURCE_TYPES.items())}}}[collection], {_first_sql(themes.SOURCE_TYPE_WORDS[:-1], "lower(hay || ' ' || file)", 1)},
            CASE WHEN regexp_matches(file, '(?i)\\.pptx?$') THEN 'presentation' END, {_first_sql(themes.SOURCE_TYPE_WORDS[-1:], "lower(hay || ' ' || file)", 1)}, 'report_or_article') AS source_type,
        CAST(round(CASE WHEN falls THEN greatest(conf, 0.55) ELSE conf END, 3) AS DOUBLE) AS confidence, CAST(coalesce(y, '0') AS INT) AS year,
        array_to_string(list_filter(CASE WHEN o IS NOT NULL THEN ['override_pattern', CASE WHEN y IS NOT NULL THEN 'year_detected' END] ELSE [CASE WHEN pos > 0 THEN 'path:collection:' || d[pos] END, 'path:theme:' || themed,
            CASE WHEN themed IS NULL THEN says END, CASE WHEN y IS NOT NULL THEN 'year_detected' END, CASE WHEN falls THEN 'low_confidence_theme_collapsed:' || theme || ':' || printf('%.2f', CAST(conf AS DOUBLE)) || '<min:0.72' END] END, lambda x: x IS NOT NULL), ';') AS evidence FROM p8)"""
_NATIONS = f"""t AS (SELECT n_nationkey AS k, 't' || n_nationkey AS theme_id, n_name, CASE WHEN n_nationkey % 6 <> 0 THEN r_name END AS collection, {_list(STATUSES)}[n_nationkey % 8 + 1] AS status FROM nation JOIN region ON n_regionkey = r_regionkey),
    ranks AS (SELECT *, MAP {{{', '.join(f"'{k}': {v}" for k, v in V.READINESS.items())}}}[status] AS rank FROM t)"""
_STATES = "states AS (SELECT 'f' || user_id AS file_name, ['pending', 'processed', 'failed', 'duplicate', 'processing', 'failed'][event_id % 6 + 1] AS status, event_id AS pos FROM events)"
_ASKED_SQL = "replace(" + _list(ASKED) + f"[p_partkey % {len(ASKED)} + 1], '{{n}}', p_name)"

SQL = {
    "theme_rules": f"WITH {_THEMES} SELECT k AS p_partkey, theme_id, collection, theme_name, source_name, source_type, confidence, year, evidence FROM resolved",
    "theme_preview": f"""WITH {_THEMES}, e AS (SELECT theme_id, e, count(*) AS n FROM (SELECT theme_id, unnest(string_split(evidence, ';')) AS e FROM resolved) GROUP BY 1, 2),
        top AS (SELECT theme_id, string_agg(e || ':' || n, ', ' ORDER BY n DESC, e) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, e) AS r FROM e) WHERE r <= 4 GROUP BY 1),
        x AS (SELECT theme_id, path || '.' || k AS x, row_number() OVER (PARTITION BY theme_id ORDER BY path || '.' || k) AS r FROM resolved)
        SELECT s.theme_id, documents, chunks, (SELECT string_agg(x, '; ' ORDER BY r) FROM x WHERE x.theme_id = s.theme_id AND r <= 3) AS examples, evidence, documents < 20 OR chunks < 3 AS is_small
        FROM (SELECT theme_id, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks FROM resolved GROUP BY 1) s JOIN top USING (theme_id)""",
    "themes_by_size": f"WITH {_THEMES} SELECT theme_id, count(*) AS documents FROM resolved GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "stamped_chunks": f"WITH {_THEMES} SELECT theme_id, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN resolved ON k = l_partkey GROUP BY 1",
    "theme_upsert": f"""WITH {_NATIONS} SELECT theme_id, CASE WHEN theme_id LIKE '%1' THEN 'search_ready' ELSE status END AS status,
        array_to_string(list_sort(list_distinct(list_concat([k % 3 + 2000, k % 5 + 2000], CASE WHEN theme_id LIKE '%1' THEN [1999, 2001] ELSE [] END))), ',') AS years FROM t""",
    "catalog_order": f"""WITH {_NATIONS}, lost AS (SELECT 't' || c_nationkey AS theme_id, arg_min(c_mktsegment, c_custkey) AS theme_name FROM customer WHERE c_nationkey % 4 = 0 GROUP BY 1),
        u AS (SELECT theme_id, n_name AS theme_name, coalesce(collection, '') AS collection, status FROM t WHERE k % 4 <> 0 UNION ALL SELECT theme_id, theme_name, 'unknown', 'parsed_ready' FROM lost)
        SELECT * FROM u ORDER BY collection, theme_name, theme_id LIMIT 20""",
    "build_targets": f"""WITH {_NATIONS}, o AS (SELECT *, row_number() OVER (ORDER BY coalesce(collection, ''), n_name, theme_id) AS r FROM ranks WHERE rank < 5)
        SELECT 'below' AS kind, theme_id FROM ranks WHERE rank < 4 UNION ALL SELECT 'first', theme_id FROM o WHERE r <= 4
        UNION ALL SELECT 'named', theme_id FROM t WHERE theme_id = 't3' OR n_name = 'NATION_7' OR contains(coalesce(collection, ''), 'GION_2')
        UNION ALL SELECT 'forced', theme_id FROM t WHERE contains(n_name, 'NATION_1')""",
    "document_list": f"""WITH {_NATIONS}, n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
        SELECT 's' || c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || '/' || c_custkey ELSE c_name END AS filename, CASE WHEN rank >= 2 THEN 'processed' ELSE status END AS status, theme_id,
            coalesce(collection, '') AS collection, c_custkey * 10 AS chars, CAST(coalesce(n.n, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 END, 0) AS BIGINT) AS chunks, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS updated_at
        FROM customer JOIN ranks ON ranks.k = c_nationkey LEFT JOIN n ON n.k = c_custkey ORDER BY updated_at DESC, filename DESC LIMIT 100""",
    "recent_runs": "SELECT 'run:' || event_id AS run_id FROM events ORDER BY date_trunc('hour', ts) DESC, run_id LIMIT 50",
    "latest_documents": "SELECT event_id AS doc_id, 'f' || user_id AS file_name FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) = 1",
    "queued_outcomes": f"""WITH {_STATES}, best AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY CASE status WHEN 'duplicate' THEN 0 WHEN 'processed' THEN 1 ELSE 2 END, pos DESC) = 1)
        SELECT 'f' || c_custkey AS file_name, coalesce(status, 'queued') AS status FROM customer LEFT JOIN best ON file_name = 'f' || c_custkey""",
    "status_counts": f"""WITH {_STATES} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('processed', 'duplicate')) AS processed, count(*) FILTER (WHERE status = 'failed') AS failed,
        count(*) FILTER (WHERE status IN ('pending', 'processing')) AS in_flight, count(*) FILTER (WHERE status IN ('pending', 'processing')) = 0 AS done FROM states""",
    "deleted_source": """SELECT 'sources' AS what, count(*) AS n FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'source_ids', count(*) FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'themes', count(*) FROM nation""",
    "quality_report": """WITH s AS (SELECT 't' || c_nationkey AS theme_id, count(*) AS sources FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
        f AS (SELECT 't' || c_nationkey AS theme_id, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 9 = 0 AND o_orderkey % 2 = 0) AS u, count(*) FILTER (WHERE c_nationkey = 5) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 1 GROUP BY 1),
        j AS (SELECT coalesce(s.theme_id, f.theme_id) AS theme_id, coalesce(sources, 0) AS sources, coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(c, 0) AS c FROM s FULL JOIN f ON s.theme_id = f.theme_id)
        SELECT theme_id, sources, n AS numeric_facts, u AS facts_without_unit, c AS facts_without_chunk, array_to_string(list_filter([CASE WHEN sources = 0 THEN 'empty_theme' END,
            [NULL, 'weak_graph', 'split_needed'][CAST(substr(theme_id, 2) AS INT) % 3 + 1], CASE WHEN u > 0 THEN 'numeric_facts_without_unit' END, CASE WHEN c > 0 THEN 'numeric_facts_without_chunk' END], lambda x: x IS NOT NULL), ',') AS issues FROM j""",
    "imported_facts": "SELECT DISTINCT 'imported' AS kind, 'fact:' || (o_orderkey % 500) AS fact_id FROM orders UNION ALL SELECT 'kept', ''",
    "profile_texts": """WITH c AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, c_nationkey AS k, o_orderkey % 3 AS tags, CASE WHEN o_orderkey % 4 = 0 THEN regexp_replace(x, '[0-9]', '', 'g') ELSE x END AS text
            FROM (SELECT *, o_orderpriority || ' of ' || c_name || CASE WHEN o_orderkey % 5 = 0 THEN repeat(' x', 400) ELSE '' END AS x FROM orders JOIN customer ON o_custkey = c_custkey)),
        r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tags DESC, CAST(regexp_matches(text, '[0-9]') AS INT) DESC, least(length(text), 8000) DESC, id) AS r FROM c),
        b AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY k ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM r WHERE r <= 6),
        p AS (SELECT k, string_agg(substr(text, 1, least(length(text), 1500 - before)), chr(10) ORDER BY r) AS body FROM b WHERE before < 1500 GROUP BY k)
        SELECT 't' || n_nationkey AS theme_id, length(profile) AS chars, substr(sha1(profile), 1, 16) AS content_hash FROM (SELECT n_nationkey,
            n_name || chr(10) || CASE WHEN n_nationkey % 6 <> 0 THEN r_name ELSE 'none' END || chr(10) || coalesce(body, '') AS profile FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON k = n_nationkey)""",
    "reused_vectors": "SELECT 't' || n_nationkey AS theme_id, substr(sha1(n_name), 1, 16) AS content_hash, n_nationkey % 3 = 1 AS kept FROM nation",
    "mean_vectors": """SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2""",
    "store_graph": f"""WITH {LINES_SQL}, f AS (SELECT 'fact:' || line_id || '.' || p AS id, brand FROM lines, (SELECT unnest(['quantity', 'price', 'discount']) AS p)),
        e AS (SELECT chunk_id AS a, line_id AS b FROM lines UNION SELECT line_id, brand FROM lines UNION SELECT line_id, kind FROM lines UNION SELECT id, brand FROM f),
        v AS (SELECT 'onto:n' || n_nationkey AS id FROM nation UNION SELECT id FROM f UNION SELECT a FROM e UNION SELECT b FROM e)
        SELECT string_split(id, ':')[1] AS kind, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT string_split(a, ':')[1] || '>' || string_split(b, ':')[1], count(*) FROM e GROUP BY 1""",
    "retrieval_edges": f"""WITH {LINES_SQL}, per AS (SELECT DISTINCT chunk_id, e FROM (SELECT chunk_id, brand AS e FROM lines UNION ALL SELECT chunk_id, kind FROM lines)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY e) AS rn FROM per),
        b AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, [replace(replace(id, 'onto:', ''), '_', ' ')] AS l FROM (SELECT DISTINCT brand AS id FROM lines UNION SELECT DISTINCT 'onto:' || translate(lower(p_brand), ' #', '__') FROM part)),
        w AS (SELECT id, rn, list_distinct(regexp_extract_all(l[1], '[0-9a-zа-яё_.+-]{{2,}}')) AS w FROM b),
        sim AS (SELECT x.id AS s, y.id AS o, greatest(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))),
            CASE WHEN len(list_intersect(list_transform(list_filter(x.w, lambda v: length(v) >= 5), lambda v: v[1:5]), list_transform(list_filter(y.w, lambda v: length(v) >= 5), lambda v: v[1:5]))) > 0 THEN 0.35 ELSE 0 END) AS v
            FROM w x JOIN w y ON y.rn > x.rn),
        e AS (SELECT line_id AS s, 'MENTIONS' AS p, brand AS o, 1 AS n FROM lines UNION ALL SELECT line_id, 'MENTIONS', kind, 1 FROM lines
            UNION ALL SELECT 'fact:' || line_id || '.' || x, 'ABOUT_ENTITY', brand, 1 FROM lines, (SELECT unnest(['quantity', 'price', 'discount']) AS x)
            UNION ALL SELECT x.e, 'CO_OCCURS_IN_CHUNK', y.e, 1 FROM ranked x JOIN ranked y ON x.chunk_id = y.chunk_id AND x.rn < y.rn AND y.rn <= 24
            UNION ALL SELECT s, 'SIMILAR_ONTOLOGY', o, CAST(greatest(1, round_even(10 * v, 0)) AS BIGINT) FROM sim WHERE v >= 0.35)
        SELECT s AS subject_id, p AS predicate, o AS object_id, CAST(sum(n) AS BIGINT) AS weight FROM e GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 40""",
    "graph_metrics": """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'c' || c_custkey, 's' || c_mktsegment FROM customer
            UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)), v AS (SELECT a AS id FROM e UNION SELECT b FROM e), near AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        d AS (SELECT id, count(b) AS d FROM v LEFT JOIN near ON a = id GROUP BY 1), hubs AS (SELECT id FROM v WHERE substr(id, 1, 1) <> 'c'),
        links AS (SELECT x.b AS a, y.b AS b FROM near x JOIN near y ON x.a = y.a WHERE substr(x.a, 1, 1) = 'c' GROUP BY 1, 2 UNION SELECT a, b FROM near WHERE substr(a, 1, 1) <> 'c' AND substr(b, 1, 1) <> 'c'),
        reach(a, b) AS (SELECT id, id FROM hubs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1),
        of AS (SELECT id, c FROM comp UNION ALL SELECT DISTINCT ON (a) a, c FROM near JOIN comp ON id = b WHERE substr(a, 1, 1) = 'c'), sizes AS (SELECT c, count(*) AS n FROM of GROUP BY 1),
        s AS (SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, count(*) FILTER (WHERE d = 0) AS isolated FROM d)
        SELECT nodes, edges, isolated, (SELECT count(*) FROM sizes) AS components, CASE WHEN isolated > greatest(10, floor(nodes * 0.25)) THEN 'weak_graph' WHEN (SELECT count(*) FROM sizes) > greatest(10, floor(nodes * 0.15)) THEN 'split_needed' ELSE 'ok' END AS health,
            (SELECT max(n) FROM sizes) AS largest_component_size, round((SELECT max(n) FROM sizes) / nodes, 4) AS largest_component_ratio,
            (SELECT string_agg(coalesce(n_name, id) || '=' || d, ',' ORDER BY d DESC, id) FROM (SELECT * FROM d ORDER BY d DESC, id LIMIT 5) LEFT JOIN nation ON id = 'n' || n_nationkey) AS top_degree, CAST(15 AS BIGINT) AS listed FROM s""",
    "parsed_questions": f"""WITH q AS (SELECT p_partkey AS k, p_name, p_partkey % {len(ASKED)} AS a, lower({_ASKED_SQL}) AS x FROM part),
        hits AS (SELECT k, t, strpos(' ' || regexp_replace(x, '[^a-z]', ' ', 'g') || ' ', ' ' || t || ' ') AS pos FROM q, (SELECT unnest(['bolt', 'gear', 'red', 'screw', 'cog', 'wheel', 'spur', 'crimson']) AS t)),
        ids AS (SELECT k, string_agg(id, ',' ORDER BY pos) AS ids FROM (SELECT k, CASE t WHEN 'screw' THEN 'bolt' WHEN 'cog' THEN 'gear' WHEN 'wheel' THEN 'gear' WHEN 'spur' THEN 'gear' WHEN 'crimson' THEN 'red' ELSE t END AS id, min(pos) AS pos FROM hits WHERE pos > 0 GROUP BY 1, 2) GROUP BY 1)
        SELECT q.k AS question_id, CASE WHEN contains(x, 'compare') THEN 'compare' WHEN contains(x, 'evidence') OR contains(x, 'source') THEN 'find_evidence' WHEN contains(x, 'what if') THEN 'what_if'
            WHEN contains(x, 'why') OR contains(x, 'cause') THEN 'causal_hypothesis' WHEN contains(x, 'recommend') THEN 'recommend_methods' ELSE 'technical_qa' END AS intent, coalesce(ids, '') AS term_ids,
            CASE a WHEN 0 THEN 'foreign' WHEN 4 THEN 'domestic' ELSE '' END AS places, CAST(CASE a WHEN 1 THEN 2019 WHEN 2 THEN 1999 ELSE 0 END AS INT) AS year_from, CAST(CASE a WHEN 1 THEN 2024 WHEN 2 THEN 2005 ELSE 0 END AS INT) AS year_to,
            CASE WHEN contains(x, 'world') THEN 'geography' ELSE '' END AS facets, CASE a WHEN 3 THEN 'concentration <= 300' WHEN 4 THEN 'temperature observed 20' ELSE '' END AS constraints FROM q LEFT JOIN ids USING (k)""",
    "fact_search": f"""WITH {FACTS_SQL}, m AS (SELECT *, value % 7 / 10 AS confidence, lower(chunk_id || ' ' || property_id || ' ' || brand || ' held in ' || property_id || ' by ' || chunk_id) AS hay FROM facts
            WHERE (property_id = 'quantity' AND value >= 40) OR (property_id = 'discount' AND value BETWEEN 0.02 AND 0.04 AND brand = 'onto:brand_11')),
        s AS (SELECT *, CASE WHEN brand = 'onto:brand_11' THEN 4 ELSE 0 END + CAST(contains(hay, 'quantity') AS INT) + CAST(contains(hay, 'order:1') AS INT) + CAST(contains(hay, 'none of it') AS INT) AS score FROM m),
        p AS (SELECT *, score - CASE WHEN contains(lower('held in ' || property_id || ' by ' || chunk_id), 'discount') THEN 0 ELSE 1 END AS place FROM s WHERE score <> 0)
        SELECT fact_id, CAST(place AS INT) AS fact_score, round(confidence, 6) AS confidence FROM (SELECT * FROM p ORDER BY place DESC, p.confidence DESC, fact_id LIMIT 30) WHERE place >= 0""",
    "fact_confidence": """WITH t AS (SELECT p_partkey AS k, p_name, p_partkey % 31 * 3 AS gap, p_partkey % 3 <> 0 AS named FROM part)
        SELECT CAST(k AS VARCHAR) AS object_id, 'concentration' AS property_id, CAST(k % 50 + 1 AS DOUBLE) AS value,
            -- blanks before the number are part of the match, so a name of 7 letters ends gap + 1 characters before it, or right there, and must begin within 96
            CAST(CASE WHEN named AND gap + 8 <= 96 THEN round(least(0.97, 0.77 + 0.20 * (96 - CASE WHEN gap = 0 THEN 0 ELSE gap + 1 END) / 96.0), 4) ELSE 0.66 END AS DOUBLE) AS confidence,
            coalesce((SELECT string_agg(w, ',' ORDER BY pos) FROM (SELECT w, strpos(' ' || p_name || ' ', ' ' || w || ' ') AS pos FROM (SELECT unnest(['bolt', 'gear', 'red']) AS w)) WHERE pos > 0), '') AS entities FROM t""",
    "evidence_units": """SELECT p_partkey, round(1.4 * (CAST(contains(p_name, 'bolt') AS INT) + CAST(contains(p_name, 'gear') AS INT)) + CASE WHEN p_partkey % 2 = 0 THEN 3.0 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1.6 ELSE 0 END
        + CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 AND NOT contains(p_name, 'bolt') AND NOT contains(p_name, 'gear') THEN 2.0 ELSE 0 END - CASE WHEN p_partkey % 11 = 0 THEN 0.4 ELSE 0 END, 6) AS score FROM part""",
    "answer_claims": """WITH hits AS (SELECT l_partkey AS q, l_linenumber AS l, l_suppkey AS s, CAST(trunc(l_quantity) AS INT) AS n, l_orderkey % 20 AS p, l_linenumber % 3 AS score,
            row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 3 DESC, l_linenumber, l_orderkey, l_suppkey, trunc(l_quantity)) AS hit FROM lineitem),
        best AS (SELECT *, min(hit) OVER (PARTITION BY q, s % 3) AS first FROM hits WHERE hit <= 8),
        refs AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY first) AS ref FROM best),
        u AS (SELECT q, s, ref, hit, 0 AS i, true AS is_numeric, 'In the leaching run of supplier ' || s || ' it was held at ' || n || ' мг/л of acid.' AS claim, n::VARCHAR AS k, 1.4 + 3.0 + 1.6 + 0.05 * score AS gain FROM refs
            UNION ALL SELECT q, s, ref, hit, 1, false, 'The operators of order ' || p || ' saw nothing else that was worth a word' || CASE WHEN l % 2 = 0 THEN ' and went home' ELSE '' END || '.',
                p || '.' || l % 2, CASE WHEN l % 2 = 0 THEN 1.4 ELSE 0 END + 0.05 * score FROM refs),
        once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY q, is_numeric, k ORDER BY hit, i) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q, is_numeric ORDER BY gain DESC, hit, i) AS place, least(5, count(*) FILTER (WHERE is_numeric) OVER (PARTITION BY q)) AS figures FROM once)
        SELECT q AS question_id, is_numeric AS "numeric", CAST(place AS INT) AS place, claim, CAST(ref AS INT) AS ref, 's' || s % 3 AS source_name FROM ranked
        WHERE place <= CASE WHEN is_numeric THEN 5 ELSE greatest(2, 6 - figures) END""",
    "chunk_order": """WITH r AS (SELECT 'o' || l_orderkey AS source_name, 'chunk:' || (l_linenumber * 3) || 'x' || l_suppkey AS chunk_id, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE l_linenumber * 3 END AS n FROM lineitem)
        SELECT source_name, chunk_id, row_number() OVER (PARTITION BY source_name ORDER BY n, chunk_id) AS place FROM r""",
    "expanded_terms": """WITH l AS (SELECT * FROM (VALUES ('bolt', 'Part', 0, 'bolt'), ('bolt', 'Part', 1, 'болт'), ('bolt', 'Part', 2, 'screw'), ('gear', 'Part', 0, 'gear'), ('gear', 'Part', 1, 'шестерня'), ('gear', 'Part', 2, 'cog'), ('gear', 'Part', 3, 'wheel'),
            ('gear', 'Part', 4, 'toothed wheel'), ('gear', 'Part', 5, 'spur'), ('red', 'Colour', 0, 'red'), ('red', 'Colour', 1, 'crimson')) AS v(t, c, i, x)),
        n AS (SELECT * FROM (VALUES ('bolt', 0, 'gear'), ('gear', 0, 'bolt'), ('gear', 1, 'red')) AS v(t, j, o)),
        u AS (SELECT t, i AS place, x FROM l UNION ALL SELECT n.t, 100 + 10 * j + i, x FROM n JOIN l ON l.t = n.o WHERE i < 4),
        f AS (SELECT t, x, min(place) AS place FROM u GROUP BY 1, 2)
        SELECT f.t AS term_id, (SELECT min(c) FROM l WHERE l.t = f.t) AS class_name, CAST(row_number() OVER (PARTITION BY f.t ORDER BY place) - 1 AS INT) AS place, x AS label FROM f""",
}
