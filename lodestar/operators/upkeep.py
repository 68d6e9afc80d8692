"""Themes and documents over time: selectors, profiles and their vectors, reports, statuses of queued work, imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import alnum_key, normalize
from ..sources.readers import embed
from .search import budgeted
from .store import readiness_rank

_FIELDS = ("theme_id", "theme_name", "collection", "source_name", "relative_path")


def select_themes(themes: DataFrame, selectors: list[str]) -> DataFrame:
    """The themes that a selector names: by id, by an equal key, or as part of one of their fields; each theme once."""
    if not selectors:
        return themes
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _FIELDS if c in themes.columns]
    test = F.lit(False)
    for s in selectors:
        key = "".join(c for c in s.lower().replace("ё", "е") if c.isalnum())
        test = test | (F.col("theme_id") == s)
        if key:
            for f in fields:
                test = test | (alnum_key(f) == key) | normalize(f).contains(s.lower())
    return themes.where(test).dropDuplicates(["theme_id"])


def profile_texts(themes: DataFrame, chunks: DataFrame, most_chunks: int = 24, most_chars: int = 24_000) -> DataFrame:
    """(theme_id, profile, content_hash): names and the most telling chunks of each theme, within a budget of characters.

    Chunks with more tags come first, then those with a digit, then longer ones.
    """
    order = [F.desc(F.size("domain_tags")), F.desc(F.col("text").rlike(r"\d").cast("int")), F.desc(F.least(F.length("text"), F.lit(8000))), F.col("chunk_id")]
    ranked = chunks.withColumn("_rank", F.row_number().over(Window.partitionBy("theme_id").orderBy(*order))).where(F.col("_rank") <= most_chunks)
    kept = budgeted(ranked.withColumn("_chars", F.length("text")), ["_rank"], "_chars", most_chars, group="theme_id", truncate=True)
    texts = kept.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("_rank", F.expr("substr(text, 1, used)").alias("t")))).alias("s"))
    rows = themes.select("theme_id", "theme_name", "collection").join(texts, "theme_id", "left")
    body = F.array_join(F.transform(F.coalesce("s", F.array().cast("array<struct<_rank:int,t:string>>")), lambda s: s["t"]), "\n")
    rows = rows.select("theme_id", F.concat_ws("\n", "theme_name", "collection", body).alias("profile"))
    return rows.withColumn("content_hash", F.substring(F.sha1("profile"), 1, 16))


def theme_embeddings(profiles: DataFrame, stored: DataFrame | None = None, service: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(theme_id, content_hash, embedding): stored vectors of unchanged profiles, new ones for the rest only."""
    if stored is None:
        return embed(profiles, "profile", service).select("theme_id", "content_hash", "embedding")
    old = stored.select("theme_id", "content_hash", "embedding").dropDuplicates(["theme_id", "content_hash"])
    same = profiles.join(old, ["theme_id", "content_hash"]).select("theme_id", "content_hash", "embedding")
    fresh = embed(profiles.join(old, ["theme_id", "content_hash"], "left_anti"), "profile", service)
    return same.unionByName(fresh.select("theme_id", "content_hash", "embedding"))


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, embedding): the mean of each key's vectors, which must be of one length."""
    at = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def quality_report(sources: DataFrame, facts: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """(theme_id, sources, numeric_facts, graph_health, facts_without_unit, facts_without_chunk, issues) of each theme; ``health``: theme_id, graph_health."""
    s = sources.groupBy("theme_id").agg(F.count("*").alias("sources"))
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    no_unit = blank("unit") & F.col("value").isNotNull() if "value" in facts.columns else blank("unit")
    f = facts.groupBy("theme_id").agg(F.count("*").alias("numeric_facts"), F.count_if(no_unit).alias("facts_without_unit"), F.count_if(blank("chunk_id")).alias("facts_without_chunk"))
    rows = s.join(f, "theme_id", "full").na.fill(0, ["sources", "numeric_facts", "facts_without_unit", "facts_without_chunk"])
    rows = rows.join(health, "theme_id", "left") if health is not None else rows.withColumn("graph_health", F.lit(None).cast("string"))
    c = F.col
    issues = F.array(
        F.when(c("sources") == 0, "empty_theme"), F.when(c("graph_health").isin("weak_graph", "split_needed"), c("graph_health")),
        F.when(c("facts_without_unit") > 0, "numeric_facts_without_unit"), F.when(c("facts_without_chunk") > 0, "numeric_facts_without_chunk"),
    )
    return rows.withColumn("issues", F.array_compact(issues))


def list_documents(sources: DataFrame, chunks: DataFrame, themes: DataFrame, limit: int = 500) -> DataFrame:
    """(id, filename, status, theme_id, collection, theme_name, chars, chunks, updated_at) of stored sources, newest first.

    A source of a theme that can be searched is processed, others have the theme's status.
    """
    n = chunks.where("coalesce(source_id, '') <> ''").groupBy("source_id").agg(F.count("*").alias("n"))
    t = themes.select("theme_id", "collection", "theme_name", F.coalesce("status", F.lit("search_ready")).alias("theme_status"))
    own = sources.drop("collection", "theme_name").join(t, "theme_id").join(n, "source_id", "left")
    ready = readiness_rank(F.col("theme_status")) >= V.READINESS["search_ready"]
    rows = own.select(
        F.col("source_id").alias("id"), F.coalesce("original_path", "source_name", "source_id").alias("filename"), F.when(ready, "processed").otherwise(F.col("theme_status")).alias("status"),
        "theme_id", "collection", "theme_name", F.coalesce("total_chars", F.lit(0)).alias("chars"), F.coalesce("n", "objects_count", F.lit(0)).alias("chunks"), "updated_at",
    )
    return rows.orderBy(F.desc("updated_at"), F.desc("filename")).limit(limit)


def recent_runs(runs: DataFrame, most: int = 50) -> DataFrame:
    """The newest ``most`` runs (run_id, created_at, others), newest first."""
    return runs.orderBy(F.desc("created_at"), "run_id").limit(most)


def catalog(themes: DataFrame) -> DataFrame:
    """Themes in the order in which they are listed."""
    return themes.orderBy(F.coalesce("collection", F.lit("")), F.coalesce("theme_name", F.lit("")), "theme_id")


def recovered_themes(themes: DataFrame, sources: DataFrame) -> DataFrame:
    """``themes`` and those that sources have and the catalog lacks, as parsed, with what their first source says."""
    lost = sources.join(themes.select("theme_id"), "theme_id", "left_anti").where("theme_id IS NOT NULL")
    first = lost.groupBy("theme_id").agg(F.min(F.struct("source_id", "collection", "theme_name", "year", "source_type")).alias("f"))
    found = first.select(
        "theme_id", F.coalesce("f.collection", F.lit("unknown")).alias("collection"), F.coalesce("f.theme_name", "theme_id").alias("theme_name"), "f.year",
        F.coalesce("f.source_type", F.lit("unknown")).alias("source_type"), F.lit("parsed_ready").alias("status"),
    )
    return themes.unionByName(found, allowMissingColumns=True)


def below_target(themes: DataFrame, target: str, force: bool = False, selectors: list[str] = (), limit: int | None = None) -> DataFrame:
    """Themes that a build towards ``target`` takes: those selected, below it unless forced, in the catalog's order."""
    rows = select_themes(themes, list(selectors))
    rows = rows if force else rows.where(readiness_rank(F.col("status")) < V.READINESS[target])
    rows = catalog(rows)
    return rows.limit(limit) if limit else rows


def latest_documents(rows: DataFrame, name: str = "file_name", at: str = "updated_at", limit: int | None = None) -> DataFrame:
    """The newest row of each name, newest first; ties by id."""
    w = Window.partitionBy(name).orderBy(F.desc(at), "doc_id")
    out = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").orderBy(F.desc(at), name)
    return out.limit(limit) if limit else out


def queued_outcomes(queued: DataFrame, statuses: DataFrame) -> DataFrame:
    """(file_name, status) of queued files: of several statuses a duplicate's first, then a processed one's, else the last; queued where there is none."""
    rank = F.when(F.col("status") == "duplicate", 0).when(F.col("status") == "processed", 1).otherwise(2)
    best = Window.partitionBy("file_name").orderBy(rank, F.desc("updated_at"))
    picked = statuses.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("file_name", "status")
    return queued.select("file_name").join(picked, "file_name", "left").select("file_name", F.coalesce("status", F.lit("queued")).alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """One row: total, processed, failed, in_flight and done."""
    s = F.col("status")
    counts = statuses.agg(F.count("*").alias("total"), F.count_if(s.isin("processed", "duplicate")).alias("processed"), F.count_if(s == "failed").alias("failed"))
    rows = counts.withColumn("in_flight", F.col("total") - F.col("processed") - F.col("failed"))
    return rows.withColumn("done", F.col("in_flight") == 0)


def import_facts(legacy: DataFrame, stored: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Facts to be stored: those of an older store unless there are facts already, or in any case with ``overwrite``."""
    if stored is not None and not overwrite and stored.limit(1).count():
        return stored
    known = F.col("fact_id").startswith("fact:")
    return legacy.withColumn("fact_id", F.when(known, F.col("fact_id")).otherwise(F.concat(F.lit("fact:"), F.col("fact_id")))).dropDuplicates(["fact_id"])


def route_reason(tokens: list[str], text: Column, most: int = 8) -> Column:
    """The question's tokens that a theme's text holds, sorted."""
    found = F.filter(F.array(*map(F.lit, sorted(set(tokens)))), lambda t: text.contains(t))
    return F.array_join(F.slice(found, 1, most), ", ")
