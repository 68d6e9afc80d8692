r"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, blanks collapsed) and hashed. For each host
(``source``) the distinct documents are counted that hold a line, and so are
their distinct texts. A line is boilerplate if it stands in more than
``MIN_DOCS`` documents of the host, in more than ``MAX_SHARE`` of them, and in
``MIN_TEXTS`` texts at least: what stands in fewer is repeated because whole
texts are, which deduplication deals with. Boilerplate lines are removed, and a
document that loses more than half of its words is depleted and rejected, as
are documents that fail the base rules (under 50 words, or over half of the
words within repeated 3-word windows).

Everything about a single text is computed in its row, without exploding words.
Counts are combined before they are shuffled, and lines meet the counts of
their host salted, so no host or line is one task. Documents meet the verdict
on their text in a sort-merge join whose large partitions, those of large
groups of copies, adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, spread

MIN_DOCS, MAX_SHARE, MIN_TEXTS = 20, 0.05, 3
#: Hash of the window of three words that begins at i.
_WINDOW = "xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2])"
SALTS = 16
_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _trim(text: str) -> Column:
    """Without blanks (\\x20, \\x09-\\x0D) at both ends."""
    return F.expr(rf"trim(BOTH ' \u0009\u000A\u000B\u000C\u000D' FROM {text})")


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(line, f"^{_BLANKS}|{_BLANKS}$", ""), _BLANKS, " "))


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long.

    Null texts measure as the empty text. Windows that may stand twice meet by
    sorting their hashes, cut so that the place fits beside them in a long;
    equal windows have equal hashes, so none is left out. The windows found are
    then sorted by their words, and those that do stand twice cover the words
    that count. So the numbers are exact for texts of any length.
    """
    d = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_bare", _trim("_text"))
    d = d.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", _BLANKS)))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_bits", F.length(F.bin("n_words")))
    packed = f"transform(sequence(0, CAST(n_words AS int) - 3), i -> shiftleft({_WINDOW}, _bits) + i)"
    d = d.withColumn("_packed", F.expr(f"sort_array(CASE WHEN n_words >= 3 THEN {packed} ELSE CAST(array() AS array<bigint>) END)"))
    d = d.withColumn("_keys", F.expr("transform(_packed, x -> shiftright(x, _bits))"))
    # places of windows whose hash is found again
    twice = "_keys[i] = get(_keys, i - 1) OR _keys[i] = get(_keys, i + 1)"
    maybe = F.expr(f"filter(transform(_packed, (x, i) -> CASE WHEN {twice} THEN x - shiftleft(_keys[i], _bits) ELSE -1L END), x -> x >= 0)")
    d = d.withColumn("_maybe", F.when(F.size(F.array_distinct("_keys")) == F.size("_keys"), F.array().cast("array<bigint>")).otherwise(maybe))
    d = d.withColumn("_named", F.expr("sort_array(transform(_maybe, x -> named_struct('w', array_join(slice(_words, CAST(x AS int) + 1, 3), ' '), 'i', x)))"))
    # and of those whose words are, in order
    again = "transform(_named, (x, i) -> CASE WHEN x.w = get(_named, i - 1).w OR x.w = get(_named, i + 1).w THEN x.i ELSE -1L END)"
    d = d.withColumn("_again", F.expr(f"sort_array(filter({again}, x -> x >= 0))"))
    covered = F.expr("aggregate(transform(_again, (x, i) -> least(3L, x - coalesce(get(_again, i - 1), -3L))), 0L, (a, x) -> a + x)")
    symbols = F.col("_text")
    for c in _SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    d = d.withColumn("_lines", F.expr(rf"filter(split(_text, '\n'), x -> trim(BOTH ' \u0009\u000A\u000B\u000C\u000D' FROM x) <> '')"))
    return d.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(symbols)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def line_structs() -> Column:
    """Distinct normalised lines of ``text`` that hold a word: hash h, and w, the words in all its occurrences."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), normal_line), lambda x: x != "")
    words = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))
    return words


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_keys() -> list[Column]:
    """host and digest: what a document is judged by."""
    return [F.coalesce("source", F.lit("")).alias("host"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")]


def judge_texts(docs: DataFrame, ws: Workspace, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """A row for each host and text of ``docs`` (doc_id, source, text): host, digest, the measures, base_failed, kept, removed.

    Documents are told apart by id and text; rows equal in both, null ids too,
    are one. ``removed`` has the hashes of the lines that the text loses, or is
    null. The table is written: filters on it don't reach back into the measuring.
    """
    measured = with_measures(docs.select(*text_keys(), "text")).select("host", "digest", *MEASURES, line_structs().alias("lines"))
    firsts = [F.first(c).alias(c) for c in (*MEASURES, "lines")]
    texts = ws.save(measured.groupBy("host", "digest").agg(*firsts), "texts")
    copies = ws.save(docs.select("doc_id", *text_keys()).distinct().groupBy("host", "digest").agg(F.count("*").alias("copies")), "copies")

    sizes = copies.groupBy("host").agg(F.sum("copies").alias("docs")).select("host", "docs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    seen = texts.join(copies, ["host", "digest"]).select("host", "copies", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = seen.groupBy("host", "h").agg(F.sum("copies").alias("n"), F.count("*").alias("texts")).where((F.col("n") > min_docs) & (F.col("texts") >= min_texts))
    counts = counts.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    frequent = counts.join(sizes, ["host", "salt"]).where(F.col("n") > max_share * F.col("docs")).select("host", "h", "n")
    frequent = ws.save(frequent, "frequent")  # for each host no more than its lines per document / max_share

    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    lines = texts.select("host", "digest", F.inline("lines")).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)))
    hit = lines.join(frequent.select("host", "h", salts), ["host", "h", "salt"])
    lost = hit.groupBy("host", "digest").agg(F.sum("w").alias("lost_words"), F.collect_set("h").alias("removed"))
    out = texts.drop("lines").join(lost, ["host", "digest"], "left").withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & (2 * F.coalesce("lost_words", F.lit(0)) <= F.col("n_words"))
    return ws.save(out.withColumn("kept", kept).drop("lost_words"), "verdicts")


def apply_rules(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, others) that are kept, without their boilerplate lines.

    n_chars, where there is one, is as the text then is; other columns stay,
    whatever their names. Null sources are one host, with the empty name; null
    and empty texts fail the base rules. Copies and repeated rows are judged alike.
    An empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "lines")
    verdicts = judge_texts(docs, ws).where("kept").select("host", "digest", "removed")
    nested = docs.select(*text_keys(), F.struct(*docs.columns).alias("doc"))
    joined = nested.join(verdicts, ["host", "digest"]).select("doc.*", F.col("removed").alias("lodestar removed"))
    removed = F.col("lodestar removed")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x))))
    out = joined.withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each row of ``documents``.

    Null and empty texts measure zero and fail the base rules, null sources are
    one host, repeated rows come back as often, further columns are ignored, and
    an empty table gives an empty result.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    verdicts = judge_texts(docs, Workspace(spark, "lines"))
    rows = docs.select("doc_id", *text_keys()).join(verdicts, ["host", "digest"])
    return rows.select("doc_id", *MEASURES, "base_failed", "kept")
