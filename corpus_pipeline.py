"""The corpus pipeline: quality rules, near-dedup, decontamination, secret removal and encoding of ``documents``.

Each stage works on all rows that the one before it kept. All but the last
return the columns of ``documents``; the last returns the encoded texts.
Empty tables, nulls, repeated rows and further columns are dealt with as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.bpe import bpe_encode, digests
from lodestar.llm.decontaminate import drop_contaminated
from lodestar.llm.line_rules import apply_rules
from lodestar.llm.secret_scan import redact_secrets
from lodestar.llm.simhash import near_dedup
from lodestar.session import ship_package
from lodestar.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines and the documents that fail the rules."""
    return apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold benchmark passages."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; all documents stay."""
    return redact_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to, as digests beside the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(bpe_encode(docs, path, public_tokenizers.PATTERN, decode=True), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("byte-level bpe", bpe_encoding),
]

#: No SQL can express fingerprints, tilings and merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again before the next."""
    ship_package(spark)
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
