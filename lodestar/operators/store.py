"""The knowledge store: upserts, merges, statistics, validation, catalog of themes, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from .tables import VersionedTables

#: What tells the rows of a table apart.
IDS = {"sources": "source_id", "source_fragments": "fragment_id", "chunks": "chunk_id", "numeric_facts": "fact_id", "entities": "entity_id", "triples": "triple_id", "ingestion_runs": "run_id"}
TABLES = ("sources", "source_fragments", "chunks", "numeric_facts", "entities", "triples", "relations", "claims", "ingestion_runs")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "source_hash", "source_name")) -> DataFrame:
    """``old`` without the rows that share any of ``keys`` with a row of ``new``, and ``new``.

    One anti join for each key, so no join has an OR; null keys replace nothing.
    """
    kept = old
    for k in keys:
        kept = kept.join(new.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return kept.select(*old.columns).unionByName(new, allowMissingColumns=True)


def delete_source(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """All tables without that source; entities lose it from their lists and stay."""
    out = {}
    for name, df in tables.items():
        if "source_ids" in df.columns:
            out[name] = df.withColumn("source_ids", F.array_remove("source_ids", source_id))
        else:
            out[name] = df.where(~F.col("source_id").eqNullSafe(source_id)) if "source_id" in df.columns else df
    return out


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_id, label, source_ids): the last label wins, source ids are joined in order, none is ever removed."""
    both = old.select("entity_id", "label", "source_ids", F.lit(0).alias("at")).unionByName(new.select("entity_id", "label", "source_ids", F.lit(1).alias("at")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("at", "source_ids"))), lambda s: s["source_ids"])
    return both.groupBy("entity_id").agg(F.max_by("label", F.struct("at", "label")).alias("label"), F.array_distinct(F.flatten(lists)).alias("source_ids"))


def skip_existing(found: DataFrame, stored: DataFrame, path: str = "original_path") -> DataFrame:
    """Rows of ``found`` whose path isn't stored yet."""
    return found.join(stored.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti").select(*found.columns)


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, n): rows of each table, facts by property and by source; null as unknown."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), F.lit(name).alias("key"), "n") for name, df in sorted(tables.items())]
    facts = tables["numeric_facts"]
    for kind, column in (("facts_by_property", "property_id"), ("facts_by_source", "source_id")):
        parts.append(facts.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(sources: DataFrame, chunks: DataFrame, facts: DataFrame) -> list[DataFrame]:
    """(level, rule, key) of what breaks the store's integrity, a table for each rule."""
    ids = sources.select("source_id").distinct()
    chunk_ids = chunks.select("chunk_id").distinct()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def found(df: DataFrame, level: str, rule: str, key: str) -> DataFrame:
        return df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.coalesce(F.col(key), F.lit("")).alias("key"))

    return [
        found(chunks.groupBy("chunk_id").count().where("count > 1"), "warning", "duplicate chunk_id", "chunk_id"),
        found(chunks.where(blank("source_id")), "error", "chunk without source_id", "chunk_id"),
        found(chunks.where(~blank("source_id")).join(ids, "source_id", "left_anti"), "error", "chunk with unknown source_id", "chunk_id"),
        found(chunks.where(blank("text")), "error", "chunk without text", "chunk_id"),
        found(facts.where(blank("source_id")), "error", "fact without source_id", "fact_id"),
        found(facts.where(blank("chunk_id")), "warning", "fact without chunk_id", "fact_id"),
        found(facts.where(~blank("chunk_id")).join(chunk_ids, "chunk_id", "left_anti"), "warning", "fact with unknown chunk_id", "fact_id"),
        found(facts.where(F.col("value").isNotNull() & blank("unit")), "error", "fact with a value and no unit", "fact_id"),
    ]


def violation_counts(sources: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(level, rule, n) of each rule that something breaks; those of ``violations``.

    Ids are counted before they are shuffled, and those named by facts are held
    against those of chunks where both are summed up, so no join has a row a fact.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def counted(df: DataFrame, *rules: tuple[str, str, Column]) -> DataFrame:
        # one row, and of that one for each rule
        one = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n{i}") for i, (_, _, c) in enumerate(rules)))
        rows = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n")) for i, (level, rule, _) in enumerate(rules)))
        return one.select(F.inline(rows)).where("n > 0")

    is_ = lambda c: F.when(c, 1).otherwise(0).cast("long")
    own = chunks.select("chunk_id", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("named"))
    named = facts.where(~blank("chunk_id")).select("chunk_id", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("named"))
    ids = own.unionByName(named).groupBy("chunk_id").agg(F.sum("n").alias("n"), F.sum("named").alias("named"))
    of = chunks.where(~blank("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    lost = of.join(sources.select("source_id").distinct(), "source_id", "left_anti")
    parts = [
        counted(ids, ("warning", "duplicate chunk_id", is_(F.col("n") > 1)), ("warning", "fact with unknown chunk_id", F.when(F.col("n") == 0, F.col("named")).otherwise(0))),
        counted(lost, ("error", "chunk with unknown source_id", F.col("n"))),
        counted(chunks, ("error", "chunk without source_id", is_(blank("source_id"))), ("error", "chunk without text", is_(blank("text")))),
        counted(
            facts,
            ("error", "fact without source_id", is_(blank("source_id"))),
            ("warning", "fact without chunk_id", is_(blank("chunk_id"))),
            ("error", "fact with a value and no unit", is_(F.col("value").isNotNull() & blank("unit"))),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(sources: DataFrame, chunks: DataFrame, facts: DataFrame, most: int = 200) -> DataFrame:
    """(level, rule, key): what breaks the store's integrity, ``most`` of each level in order."""
    parts = violations(sources, chunks, facts)
    firsts = [p.orderBy("key").limit(most) for p in parts]  # so that the window below has few rows
    out = firsts[0]
    for p in firsts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("level").orderBy("rule", "key"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def readiness_rank(status) -> F.Column:
    table = F.create_map(*[F.lit(x) for kv in V.READINESS.items() for x in kv])
    return F.coalesce(F.element_at(table, status), F.lit(0))


def knowledge_state(themes: DataFrame) -> DataFrame:
    """One row: themes, ready ones, the best status and the number of sources. ``themes``: theme_id, status, sources."""
    rank = readiness_rank(F.col("status"))
    return themes.agg(
        F.count("*").alias("themes"),
        F.count_if(rank >= V.READINESS["search_ready"]).alias("search_ready"),
        F.count_if(rank >= V.READINESS["cheap_kg_ready"]).alias("graph_ready"),
        F.max_by("status", F.struct(rank, "status")).alias("best_status"),
        F.sum("sources").alias("sources"),
    )


def upsert_themes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Theme rows replaced by theme_id; the years of both stay."""
    before = old.select("theme_id", F.col("years").alias("_before"))
    fresh = new.join(before, "theme_id", "left").withColumn("years", F.array_sort(F.array_union("years", F.coalesce("_before", F.array().cast("array<int>"))))).drop("_before")
    return old.join(new.select("theme_id"), "theme_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def duplicate_titles(sources: DataFrame, title: str, key: str = "source_id") -> DataFrame:
    """(first, later): each later source of a title beside the first one."""
    h = F.substring(F.sha1(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\s+", " "))), 1, 16)
    rows = sources.select(F.col(key).alias("later"), h.alias("h"))
    firsts = rows.groupBy("h").agg(F.min("later").alias("first"))
    return rows.join(firsts, "h").where("later <> first").select("first", "later")


class KnowledgeStore(VersionedTables):
    """The tables of a knowledge base below one folder, Parquet by theme."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, TABLES)

    def upsert(self, table: str, new: DataFrame, keys: tuple[str, ...] = ("source_id", "source_hash", "source_name"), together: bool = False, batch: tuple[str, int] | None = None) -> None:
        super().upsert(table, new, keys, together, batch)

    def export(self, out: str, fmt: str = "parquet") -> dict[str, int]:
        """Copies of the tables there are with a manifest of how many rows each has, which it gives too."""
        counts = {}
        for table in TABLES:
            if self.exists(table):
                df = self.read(table)
                df.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}/{table}")
                counts[table] = df.count()
        rows = self.spark.createDataFrame(list(counts.items()) or [("", 0)], "table string, rows long").where("table <> ''")
        rows.coalesce(1).write.mode("overwrite").json(f"{out.rstrip('/')}/manifest")
        return counts
