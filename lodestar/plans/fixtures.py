"""The relational tables in the graph's vocabulary: orders hold lines, lines mention parts, facts are their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import spread


#: Tables of few bytes and much work a row.
BUSY = ("part", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in few files and tables of ``BUSY`` are spread over the cores.

    Those of ``BUSY`` in any case: a file of few bytes has few row groups, and splits
    without one have no rows, however many splits there are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUSY:
        return rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    return spread(rows) if name == "documents" else rows


def line_id() -> Column:
    return F.concat(F.lit("line:"), "l_orderkey", F.lit("."), "l_linenumber")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, order_id, chunk_id, brand, kind, quantity, price, discount): chunk = order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    order = F.concat(F.lit("order:"), "l_orderkey")
    onto = lambda c: F.concat(F.lit("onto:"), F.translate(F.lower(c), " #", "__"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), onto("p_brand").alias("brand"), onto("p_type").alias("kind"))
    return li.join(part, "l_partkey").select(
        line_id().alias("line_id"), order.alias("order_id"), order.alias("chunk_id"), "brand", "kind",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, predicate, object_id, chunk_id)."""
    t = lambda s, p, o: F.struct(s.alias("subject_id"), F.lit(p).alias("predicate"), o.alias("object_id"))
    c = F.col
    three = F.array(t(c("order_id"), "CONTAINS", c("line_id")), t(c("line_id"), "MENTIONS", c("brand")), t(c("line_id"), "MENTIONS", c("kind")))
    return lines(spark, sf_dir).select(F.inline(three), "chunk_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, chunk_id, source_id, property_id, unit, dimension, operator, value, value_max, entity_ids)."""
    f = lambda name, unit, value: F.struct(F.lit(name).alias("property_id"), F.lit(unit).alias("unit"), F.col(value).alias("value"))
    rows = lines(spark, sf_dir).select("line_id", "chunk_id", "brand", F.inline(F.array(f("quantity", "pieces", "quantity"), f("price", "dollars", "price"), f("discount", "share", "discount"))))
    return rows.select(
        F.concat(F.lit("fact:"), "line_id", F.lit("."), "property_id").alias("fact_id"),
        "chunk_id",
        F.col("chunk_id").alias("source_id"),
        "property_id",
        "unit",
        F.col("property_id").alias("dimension"),
        F.lit("observed").alias("operator"),
        "value",
        F.lit(None).cast("double").alias("value_max"),
        F.array("brand").alias("entity_ids"),
    )


#: The same for DuckDB; queries begin with WITH and these.
LINES_SQL = """lines AS (
    SELECT 'line:' || l_orderkey || '.' || l_linenumber AS line_id, 'order:' || l_orderkey AS chunk_id,
        'onto:' || translate(lower(p_brand), ' #', '__') AS brand, 'onto:' || translate(lower(p_type), ' #', '__') AS kind,
        l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""
TRIPLES_SQL = LINES_SQL + """, triples AS (
    SELECT chunk_id AS subject_id, 'CONTAINS' AS predicate, line_id AS object_id, chunk_id FROM lines
    UNION ALL SELECT line_id, 'MENTIONS', brand, chunk_id FROM lines
    UNION ALL SELECT line_id, 'MENTIONS', kind, chunk_id FROM lines)"""
FACTS_OF_LINES_SQL = """facts AS (
    SELECT 'fact:' || line_id || '.quantity' AS fact_id, chunk_id, 'quantity' AS property_id, 'pieces' AS unit, quantity AS value, brand FROM lines
    UNION ALL SELECT 'fact:' || line_id || '.price', chunk_id, 'price', 'dollars', price, brand FROM lines
    UNION ALL SELECT 'fact:' || line_id || '.discount', chunk_id, 'discount', 'share', discount, brand FROM lines)"""
FACTS_SQL = LINES_SQL + ", " + FACTS_OF_LINES_SQL
