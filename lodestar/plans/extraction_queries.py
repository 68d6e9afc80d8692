"""Queries over texts made from the relational tables, whose terms, facts and records SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.extraction import Ontology, Term, extract_facts, find_terms
from ..operators.records import repair_table
from ..operators.terms import drawn_runs, find_labels
from ..streaming.ingest import sessions
from .fixtures import table

#: Longer labels go first: a "small bolt" is no "bolt".
PART_TERMS = Ontology(tuple(Term(t.replace(" ", "_"), "Part", (t,)) for t in ("bolt", "gear", "small bolt", "red", "hot gear")), {"concentration": ("sulfate",)})


def numeric_facts_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.concat("l_orderkey", F.lit("."), "l_linenumber")
    text = F.concat(F.lit("Sulfate ≤"), F.col("l_quantity").cast("int"), F.lit(" mg/L, held at "), (F.col("l_discount") * 100).cast("int") + 20, F.lit(" °C for long."))
    facts = extract_facts(li.select(key.alias("object_id"), F.lit("t").alias("source_name"), text.alias("text")), PART_TERMS)
    return facts.groupBy("property_id", "operator", "value", "unit", "dimension").agg(F.count("*").alias("n"))


def find_part_terms(spark, sf_dir):
    found = find_terms(table(spark, sf_dir, "part").select("p_partkey", "p_name"), PART_TERMS, "p_partkey", "p_name")
    return found.select("p_partkey", "term_id", "start", "end")


#: Labels of ``document_terms``.
MANY_LABELS = 10_000


def document_terms(spark, sf_dir):
    """10,000 labels, runs of two and three words of the texts drawn by their hash, in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = drawn_runs(docs, MANY_LABELS)
    drawn = drawn.select("label", F.concat(F.lit("t:"), F.substring("h", 1, 12)).alias("term_id"), F.conv(F.substring("h", 1, 12), 16, 10).cast("long").alias("pos"))
    return find_labels(docs, drawn, "doc_id").select("doc_id", "term_id", "label", "start", "end")


#: Sentences of ``fact_ids`` with a quantity and a temperature; blanks, line breaks and ё as they come.
SENTENCES = (
    ("Расчёт:  концентрация   сульфатов ", "не   более ", " \n мг/л ,  при  температуре\t", "  °C  за ёмкостью. "),
    (" Sulfate   content ", "<= ", "  mg/L,\nheld at temperature near", "  °C\t for long."),
)
FACT_TERMS = Ontology((Term("sulfate", "Ion", ("сульфаты", "sulfate"), ("сульфатов",)),), {"concentration": ("концентрация", "content"), "temperature": ("температур", "temperature")})


def fact_ids(spark, sf_dir):
    """Facts of Russian and English sentences with their ids, raw values and contexts."""
    li = table(spark, sf_dir, "lineitem")
    quantity, warmth = F.col("l_quantity").cast("int").cast("string"), ((F.col("l_discount") * 100).cast("int") + 20).cast("string")
    a, b = (F.concat(F.lit(s[0]), F.lit(s[1]), quantity, F.lit(s[2]), F.lit(" "), warmth, F.lit(s[3])) for s in SENTENCES)
    text = F.when(F.col("l_linenumber") % 2 == 0, a).otherwise(b)
    key = F.concat("l_orderkey", F.lit("."), "l_linenumber")
    facts = extract_facts(li.select(key.alias("object_id"), F.lit("lab").alias("source_name"), text.alias("text")), FACT_TERMS)
    return facts.select("fact_id", "object_id", "property_id", "operator", "value", "raw_value", "unit", "context", "confidence", F.array_join("entity_ids", ",").alias("entities"))


def record_repair(spark, sf_dir):
    """Nations as records, each second one as a line with pipes."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('("entity"<|>"'), "n_name", F.lit('"<|>"Nation"<|>"in '), "r_name", F.lit('")##')))
    raw = raw.otherwise(F.concat(F.lit("| "), "n_name", F.lit(" | Nation | in "), "r_name", F.lit(" |")))
    rows = repair_table(n.select("n_nationkey", raw.alias("raw"), F.lit("").alias("prompt")), "n_nationkey")
    return rows.select("n_nationkey", "tag", F.array_join("fields", ";").alias("fields"))


def event_sessions(spark, sf_dir):
    rows = sessions(table(spark, sf_dir, "events").select("ts", "user_id"), gap="2 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (numeric_facts_text, find_part_terms, document_terms, fact_ids, record_repair, event_sessions)}

_PIECES = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
#: Pieces of the text that matches are placed in.
_PLAIN = r"regexp_extract_all(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"

_AHEAD = ", ".join(f"lead(piece, {k}) OVER w AS p{k}" for k in (1, 2, 3, 4))
_RUNS = "[CASE WHEN p1 = ' ' THEN piece || ' ' || p2 END, CASE WHEN p1 = ' ' AND p3 = ' ' THEN piece || ' ' || p2 || ' ' || p4 END]"

SQL = {
    "document_terms": rf"""WITH given AS (SELECT doc_id, unnest({_PIECES}) AS piece, unnest(range(1, len({_PIECES}) + 1)) AS i FROM documents),
        runs AS (SELECT unnest({_RUNS}) AS label FROM (SELECT *, {_AHEAD} FROM given WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE regexp_matches(piece, '^[\p{{L}}\p{{N}}_]')),
        labels AS (SELECT label, 't:' || md5(label)[1:12] AS term_id, len(label) AS size, md5(label) AS h FROM (SELECT DISTINCT label FROM runs WHERE label IS NOT NULL) ORDER BY md5(label), label LIMIT 10000),
        t AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)),
        own AS (SELECT doc_id, s, unnest({_RUNS}) AS label FROM (SELECT *, {_AHEAD}, sum(len(piece)) OVER w - len(piece) AS s FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i))
            WHERE regexp_matches(piece, '^[\p{{L}}\p{{N}}_]')),
        hits AS (SELECT doc_id, list({{'s': s, 'e': s + size, 'label': label, 'term_id': term_id}} ORDER BY size DESC, h, s) AS hits FROM own JOIN labels USING (label) GROUP BY doc_id),
        kept AS (SELECT doc_id, unnest(list_reduce(list_transform(hits, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM hits)
        SELECT doc_id, k.term_id AS term_id, k.label AS label, CAST(k.s AS INT) AS start, CAST(k.e AS INT) AS "end" FROM kept""",
    "fact_ids": rf"""WITH li AS (SELECT l_orderkey || '.' || l_linenumber AS object_id, l_linenumber % 2 = 0 AS ru, CAST(trunc(l_quantity) AS INT)::VARCHAR AS q, (CAST(trunc(l_discount * 100) AS INT) + 20)::VARCHAR AS t FROM lineitem),
        texts AS (SELECT *, CASE WHEN ru THEN 'Расчет: концентрация сульфатов не более ' || q || ' мг/л , при температуре ' || t || ' °C за емкостью.'
            ELSE 'Sulfate content <= ' || q || ' mg/L, held at temperature near ' || t || ' °C for long.' END AS clean FROM li),
        found AS (SELECT *, 0 AS i, 'concentration' AS property_id, '<=' AS operator, q::DOUBLE AS value, CASE WHEN ru THEN 'не более ' || q || ' мг/л' ELSE '<= ' || q || ' mg/L' END AS raw_value, 'mg/L' AS unit,
                CASE WHEN ru THEN 'концентрация' ELSE 'content' END AS named FROM texts
            UNION ALL SELECT *, 1, 'temperature', 'observed', t::DOUBLE, ' ' || t || ' °C', 'C', CASE WHEN ru THEN 'температур' ELSE 'temperature' END FROM texts),
        placed AS (SELECT *, strpos(clean, raw_value) AS a, strpos(clean, named) AS p FROM found)
        SELECT substr(sha1('lab|' || object_id || '|' || i || '|' || property_id || '|' || raw_value || '|' || clean[1:40]), 1, 20) AS fact_id, object_id, property_id, operator, value, raw_value, unit, clean AS context,
            round(least(0.97::DOUBLE, 0.77::DOUBLE + 0.20::DOUBLE * (96 - least(abs(a - p), abs(a - p - len(named)))) / 96), 4) AS confidence, 'sulfate' AS entities FROM placed""",
    "numeric_facts_text": """SELECT 'concentration' AS property_id, '<=' AS operator, CAST(CAST(trunc(l_quantity) AS INT) AS DOUBLE) AS value, 'mg/L' AS unit, 'concentration' AS dimension, count(*) AS n FROM lineitem GROUP BY 3
        UNION ALL SELECT 'temperature', 'observed', CAST(CAST(trunc(l_discount * 100) AS INT) + 20 AS DOUBLE), 'C', 'temperature', count(*) FROM lineitem GROUP BY 3""",
    "find_part_terms": r"""WITH hits AS (
        SELECT p_partkey, t, strpos(' ' || p_name || ' ', ' ' || t || ' ') - 1 AS start FROM part, (SELECT unnest(['bolt', 'gear', 'small bolt', 'red', 'hot gear']) AS t))
        SELECT p_partkey, replace(t, ' ', '_') AS term_id, CAST(h.start AS INT) AS start, CAST(h.start + length(t) AS INT) AS "end" FROM hits h WHERE h.start >= 0
            AND NOT EXISTS (SELECT 1 FROM hits l WHERE l.p_partkey = h.p_partkey AND l.start >= 0 AND length(l.t) > length(h.t) AND l.start < h.start + length(h.t) AND h.start < l.start + length(l.t))""",
    "record_repair": "SELECT n_nationkey, 'entity' AS tag, n_name || ';Nation;in ' || r_name AS fields FROM nation JOIN region ON n_regionkey = r_regionkey",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)
        SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM e GROUP BY user_id""",
}
