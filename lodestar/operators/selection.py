"""Chunk scores and the choice of chunks for a compressed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import bind, contained, count_contained, fingerprint, line_stats, normalize, scoring_tokens, selection_document_type
from ..session import ship_package


def _hits(text: Column, terms: list[str]) -> Column:
    return count_contained(normalize(text), terms)


def _has(test: Column, gain: float) -> Column:
    return F.when(test, gain).otherwise(0.0)


def rough_score(text: Column, n_tags: Column, section_type: Column) -> Column:
    """What candidates are ranked by before the full scores."""
    words = _hits(text, V.PROCESS_TERMS) + _hits(text, V.PROPERTY_TERMS)
    return (
        _has(text.rlike(V.SCORING_NUMERIC), 0.42)
        + F.least(F.lit(0.22), n_tags * 0.025)
        + F.least(F.lit(0.24), words * 0.035)
        + F.least(F.lit(0.08), F.length(text) / 12000.0)
        + _has(F.coalesce(section_type.isin("methods", "results", "requirements", "table"), F.lit(False)), 0.10)
    )


def kg_score(text: Column, n_tags: Column, has_fact: Column, citation: Column) -> Column:
    """Usefulness of a chunk for a graph: struct of score, to 4 digits, and reasons."""
    section = F.concat(F.coalesce(citation, F.lit("")), F.lit("\n"), F.substring(text, 1, 500)).rlike(V.SECTION_WORD)
    counts = bind(
        normalize(text),
        lambda low: F.struct(
            (has_fact | text.rlike(V.SCORING_NUMERIC)).alias("numeric"),
            F.least(n_tags, F.lit(12)).alias("ontology_terms"),
            F.least(contained(low, V.PROCESS_TERMS), F.lit(8)).alias("process_terms"),
            F.least(contained(low, V.MATERIAL_TERMS), F.lit(8)).alias("material_terms"),
            F.least(contained(low, V.PROPERTY_TERMS), F.lit(8)).alias("property_terms"),
            text.rlike(V.TABLE_LIKE).alias("table"),
            section.alias("section"),
        ),
    )

    def scored(c: Column) -> Column:
        part = lambda n, of: F.least(c[n] / of, F.lit(1.0))
        score = (
            _has(c["numeric"], 0.35) + 0.20 * part("ontology_terms", 6.0) + 0.15 * part("process_terms", 3.0) + 0.10 * part("material_terms", 3.0)
            + 0.10 * part("property_terms", 3.0) + _has(c["table"], 0.07) + _has(c["section"], 0.03)
        )
        names = ("ontology_terms", "process_terms", "material_terms", "property_terms")
        named = [F.when(c["numeric"], F.lit("numeric_fact_or_unit")), *[F.when(c[n] > 0, F.concat(F.lit(f"{n}:"), c[n])) for n in names]]
        reasons = F.array_compact(F.array(*named, F.when(c["table"], F.lit("table_like")), F.when(c["section"], F.lit("section_boost"))))
        return F.struct(F.bround(score, 4).alias("score"), F.when(F.size(reasons) == 0, F.array(F.lit("weak_context"))).otherwise(reasons).alias("reasons"))

    return bind(counts, scored)


def chunk_quality(rows: DataFrame, kg: Column | None = None, doc_type: Column | None = None) -> DataFrame:
    """``rows`` (source_name, text) with doc_type, numeric_hits, domain_hits, chunk_quality and is_informative.

    ``doc_type``: what type the rows are taken for; else it is told from name and text.
    """
    text = F.coalesce("text", F.lit(""))
    low = normalize(text)
    doc_type = selection_document_type(F.col("source_name"), text) if doc_type is None else doc_type
    d = rows.withColumn("doc_type", doc_type).withColumn("_tokens", scoring_tokens(text)).withColumn("_lines", line_stats(text))
    d = d.withColumn("numeric_hits", F.regexp_count(text, F.lit(V.SCORING_NUMERIC)))
    d = d.withColumn("domain_hits", _hits(text, V.PROCESS_TERMS) + _hits(text, V.MATERIAL_TERMS) + _hits(text, V.PROPERTY_TERMS))
    n, numeric, domain = F.size("_tokens"), F.col("numeric_hits"), F.col("domain_hits")
    unique = F.size(F.array_distinct("_tokens")) / F.greatest(n, F.lit(1))
    alpha = F.length(F.regexp_replace(text, r"\P{L}", "")) / F.greatest(F.length(text), F.lit(1))
    table, contacts, normative = text.rlike(V.TABLE_LIKE), text.rlike(V.CONTACTS), text.rlike(V.NORMATIVE)
    title = (n <= 16) & (numeric == 0) & (domain <= 1) & (F.col("_lines.uppercase_ratio") > 0.35)
    noise = low.rlike(V.ARTICLE_NOISE)
    slide = low.rlike(V.SLIDE_BOILERPLATE) | contacts | title
    of = lambda kind, test, gain: _has((F.col("doc_type") == kind) & test, gain)
    score = (
        F.lit(0.10)
        + F.when(n >= 45, 0.18).when(n < 12, -0.18).otherwise(0.0)
        + F.when(alpha >= 0.45, 0.08).otherwise(-0.12)
        + _has((unique < 0.28) & (n > 25), -0.10)
        + F.least(F.lit(0.28), numeric * 0.07)
        + F.least(F.lit(0.28), domain * 0.06)
        + _has(F.regexp_count(text, F.lit(r"[.!?…]\s+")) >= 2, 0.08)
        + _has(table & (numeric > 0), 0.08)
        + _has((F.col("_lines.table_separator_ratio") > 0.2) & (numeric == 0), -0.22)
        + of("presentation", slide, -0.25)
        + of("presentation", (numeric > 0) | (domain >= 2), 0.10)
        + of("presentation", (F.col("_lines.short_line_ratio") > 0.75) & (numeric == 0), -0.10)
        + of("article", noise & (numeric == 0), -0.24)
        + of("article", low.rlike(V.SECTION_WORD) & ~noise, 0.10)
        + of("standard", normative, 0.18)
        + of("standard", contacts & ~normative, -0.16)
        + of("spreadsheet", table & (numeric > 0), 0.18)
        + of("spreadsheet", table & (numeric == 0), -0.08)
        + (_has(kg >= 0.30, 0.10) if kg is not None else F.lit(0.0))
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    boilerplate = ((F.col("doc_type") == "presentation") & slide) | ((F.col("doc_type") == "article") & noise & (numeric == 0))
    informative = (score >= 0.20) & ~(boilerplate & (numeric == 0) & (domain < 2))
    return d.withColumn("chunk_quality", F.bround(score, 4)).withColumn("is_informative", informative).drop("_tokens", "_lines")


def top_candidates(rows: DataFrame, cap: int, group: str = "theme_id") -> DataFrame:
    """The ``cap`` best rows (text, n_tags, section_type, chunk_id) of each group by rough score, then length, then id."""
    text = F.coalesce("text", F.lit(""))
    scored = rows.withColumn("rough_score", F.round(rough_score(text, F.col("n_tags"), F.col("section_type")), 6))
    order = Window.partitionBy(group).orderBy(F.desc("rough_score"), F.desc(F.length(text)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def document_limit(n_chunks: Column, n_chars: Column, base: int) -> Column:
    """How many chunks a document may give: fewer for short documents, which is tested first, more for long ones."""
    return (
        F.when((n_chunks <= 5) | (n_chars <= 12_000), max(1, min(base, 3)))
        .when((n_chunks >= 24) | (n_chars >= 50_000), max(base, 6))
        .otherwise(max(1, base))
    )


def combined_score(kg: Column, quality: Column) -> Column:
    """What chunks are chosen by: mostly their use for a graph, partly their quality; to 4 digits."""
    return F.bround(0.72 * kg + 0.28 * quality, 4)


def with_selection_scores(rows: DataFrame, has_fact: Column, n_tags: Column, citation: Column, doc_type: Column | None = None) -> DataFrame:
    """``rows`` (source_name, text) with kg_score_raw, kg_reasons, chunk_quality, doc_type, is_informative and kg_score, the combined one."""
    scored = rows.withColumn("_s", kg_score(F.coalesce("text", F.lit("")), n_tags, has_fact, citation))
    scored = scored.withColumns({"kg_score_raw": F.col("_s.score"), "kg_reasons": F.col("_s.reasons")}).drop("_s")
    scored = chunk_quality(scored, F.col("kg_score_raw"), doc_type)
    return scored.withColumn("kg_score", combined_score(F.col("kg_score_raw"), F.col("chunk_quality")))


def select_chunks(scored: DataFrame, base_limit: int = 4, min_score: float = 0.18, min_quality: float = 0.20, theme_cap: int = 48, group: str = "theme_id") -> DataFrame:
    """The chosen rows of ``scored`` (theme_id, source_id, source_name, chunk_id, text, kg_score, kg_reasons, chunk_quality, is_informative).

    Document by document, in the order of each one's first row by (source_name,
    citation_name, chunk_id), its rows by (informative, score, quality, length):
    a row is passed over if neither informative nor a hard signal (a number, or
    quality of 0.34 and up), or below ``min_quality`` without one, or below
    ``min_score`` once the document has given a row, or if a chosen row of the
    theme has its fingerprint. Then the ``theme_cap`` best of the theme stay.

    The choice depends on what was chosen before, so a theme is gone through in
    order by one task; its input is the theme's candidates, which
    ``top_candidates`` bounds, without their texts.
    """
    ship_package(scored.sparkSession)
    size = Window.partitionBy(group, "source_id")
    citation = F.coalesce("citation_name", F.lit("")) if "citation_name" in scored.columns else F.lit("")
    place = F.struct(F.coalesce("source_name", F.lit("")), citation, "chunk_id")
    rows = scored.withColumn("_limit", document_limit(F.count("*").over(size), F.sum(F.length("text")).over(size), base_limit))
    rows = rows.withColumn("_hard", F.array_contains("kg_reasons", "numeric_fact_or_unit") | (F.col("chunk_quality") >= max(min_quality, 0.34)))
    rows = rows.withColumn("_print", fingerprint(F.col("text"))).withColumn("_chars", F.length("text"))
    rows = rows.withColumn("_document", F.to_json(F.min(place).over(size))).withColumn("_own", F.to_json(place))

    def choose(pdf):
        pdf = pdf.sort_values(["document", "is_informative", "kg_score", "chunk_quality", "chars", "own"], ascending=[True, False, False, False, False, True])
        seen, taken, keep = set(), {}, []
        for r in pdf.itertuples():
            have = taken.get(r.source_id, 0)
            ok = (r.is_informative or r.hard) and (r.chunk_quality >= min_quality or r.hard) and not (have and r.kg_score < min_score)
            ok = ok and have < r.limit and r.print not in seen
            keep.append(ok)
            if ok:
                seen.add(r.print)
                taken[r.source_id] = have + 1
        return pdf[keep]

    small = rows.select(
        group, "source_id", "chunk_id", "kg_score", "chunk_quality", "is_informative", F.col("_hard").alias("hard"), F.col("_limit").alias("limit"),
        F.col("_print").alias("print"), F.col("_chars").alias("chars"), F.col("_document").alias("document"), F.col("_own").alias("own"),
    )
    picked = small.groupBy(group).applyInPandas(choose, small.schema).select(group, "chunk_id")
    best = Window.partitionBy(group).orderBy(F.desc("kg_score"), "chunk_id")
    out = scored.join(picked, [group, "chunk_id"], "left_semi").withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= theme_cap)
    return out.select(*scored.columns)


def selection_report(total: DataFrame, candidates: DataFrame, selected: DataFrame, base_limit: int = 4, min_quality: float = 0.20, group: str = "theme_id") -> DataFrame:
    """(theme_id, total_chunks, candidate_chunks, selected_chunks, selection_ratio, selected_types, rejected_types, document_limits).

    The last three are maps of counts by document type, and by limit. ``total``
    (theme_id), ``candidates`` and ``selected`` as for ``select_chunks`` with doc_type.
    """

    def histogram(rows: DataFrame, key: Column, name: str) -> DataFrame:
        counted = rows.groupBy(group, key.cast("string").alias("k")).agg(F.count("*").alias("n"))
        return counted.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    hard = F.array_contains("kg_reasons", "numeric_fact_or_unit") | (F.col("chunk_quality") >= max(min_quality, 0.34))
    rejected = candidates.where(~hard & (~F.col("is_informative") | (F.col("chunk_quality") < min_quality)))
    limits = candidates.groupBy(group, "source_id").agg(document_limit(F.count("*"), F.sum(F.length("text")), base_limit).alias("l"))
    out = total.groupBy(group).agg(F.count("*").alias("total_chunks"))
    for rows, name in ((candidates, "candidate_chunks"), (selected, "selected_chunks")):
        out = out.join(rows.groupBy(group).agg(F.count("*").alias(name)), group, "left").na.fill(0, [name])
    out = out.withColumn("selection_ratio", F.bround(F.col("selected_chunks") / F.col("total_chunks"), 4))
    for part in (histogram(selected, F.col("doc_type"), "selected_types"), histogram(rejected, F.col("doc_type"), "rejected_types"), histogram(limits, F.col("l"), "document_limits")):
        out = out.join(part, group, "left")
    return out


def source_order(rows: DataFrame) -> list[Column]:
    """Order of a source's chunks: by an index or page where there is one, else by a number in the id, else by id."""
    given = [F.col(c).cast("string") for c in ("chunk_index", "chunk_no", "page") if c in rows.columns]
    whole = [F.when(x.rlike(r"^\d+$"), x.cast("long")) for x in given]
    in_id = F.nullif(F.regexp_extract("chunk_id", r"(?i)(?:chunk|page|slide|p)[_: -]?(\d+)", 1), F.lit("")).cast("long")
    return [F.coalesce("source_name", F.lit("")), F.coalesce(*whole, in_id), F.col("chunk_id")]
