"""Importance resampling of documents towards a target text collection, by hashed features.

Features are runs of 1 to ``runs`` words, each in a bucket. A bucket's gain is
the logarithm of how much likelier the target has it than the documents; a
document's weight is the sum over its features. Scores add noise of the Gumbel
distribution, seeded by the document's id, so that the highest scores are a
sample without replacement in proportion to exp(weight).

External sort-count. Texts are read once: their buckets are written as packed
uint16 streams, with the offset at which each document begins. Counting sorts
each stream and run-length encodes it; a task adds up the runs of its streams,
and Spark those of the tasks. Weights are gathered from the same streams: the
gain of each bucket, summed between offsets by ``np.add.reduceat``.

The drawn documents are ranked by a range partitioning of (score, doc_id), in
which a row's rank is its place within the partition and the sizes of those
before. No task and no window sees more than a partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, spread

BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Features in one stream; a longer text has a stream of its own.
PACKET = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes, A-Z lower-cased


def buckets_of(text: bytes | None, runs: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words the text has, and the bucket of each feature."""
    words = _WORD.findall((text or b"").lower())
    crcs = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for n in range(2, min(runs, len(words)) + 1):
        joined = map(b" ".join, zip(*(words[i:] for i in range(n))))
        crcs.append(np.fromiter(map(zlib.crc32, joined), np.uint32, len(words) - n + 1))
    return len(words), (np.concatenate(crcs) % np.uint32(buckets)).astype("<u2")


def streams(docs: DataFrame, runs: int, buckets: int) -> DataFrame:
    """Packets (doc_ids, n_words, offsets, buckets) of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, parts, size = [], [], [], 0

        def packet() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, parts)])
            columns = [
                pa.array([ids], pa.list_(id_type)), pa.array([np.array(words, "<i8").tobytes()]),
                pa.array([ends[:-1].astype("<i8").tobytes()]), pa.array([np.concatenate(parts).tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "n_words", "offsets", "buckets"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                n, found = buckets_of(text, runs, buckets)
                if ids and (size + len(found) > PACKET or len(ids) >= PACKET):
                    yield packet()
                    ids, words, parts, size = [], [], [], 0
                ids.append(doc_id)
                words.append(n)
                parts.append(found)
                size += len(found)
        if ids:
            yield packet()

    return docs.mapInArrow(pack, f"doc_ids array<{kind}>, n_words binary, offsets binary, buckets binary")


def bucket_counts(packets: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket. The driver gets one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                run = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.concatenate([run[:1] >= 0, run[1:] != run[:-1]]))
                total[run[starts]] += np.diff(np.append(starts, len(run)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = packets.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    s, t = own.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(packets: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document in ``packets``."""
    kind = dict(packets.dtypes)["doc_ids"][len("array<") : -1]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, offsets, stream = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in ((1, "<i8"), (2, "<i8"), (3, "<u2")))
                size = np.diff(np.append(offsets, len(stream)))
                weight, full = np.zeros(len(offsets), np.int64), size > 0
                if full.any():
                    weight[full] = np.add.reduceat(gain[stream], offsets[full])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(words), pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return packets.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """``rank`` for the first ``percent`` of the rows that are ``fit``, by score and then doc_id; null for all others."""
    rows = ws.save(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # settles the order of rows that tie in all else
    by = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ws.save(placed.withColumns({"part": F.spark_partition_id(), "place": place}), "placed")
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.sum(F.col("fit").cast("long")).alias("n")).collect()}
    total, before = 0, []
    for part in sorted(counts):  # a number for each partition
        before.append((part, total))
        total += counts[part]
    drawn = percent * total // 100
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(offsets), "part", "left")
    return ranked.withColumn("rank", F.when(F.col("fit") & (rank <= drawn), rank))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, ws: Workspace | None = None
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text) towards ``target`` (text).

    ``percent`` of the rows with ``least_words`` words or more are drawn, the rank
    of all others is null. Null and empty texts have no features, the weight 0 and a
    score by noise alone, and are not drawn. A null doc_id has the noise of an empty id
    and comes last of those that tie. Repeated rows are drawn one by one. Empty
    tables count no features. Other columns are ignored. ``buckets`` is 65,536 at most.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in 16 bits")
    ws = ws or Workspace(docs.sparkSession, "resample")
    packets = ws.save(streams(docs.select("doc_id", "text"), runs, buckets), "streams")
    aimed = ws.save(streams(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets), "target")
    found = weights(packets, gains(bucket_counts(packets, buckets), bucket_counts(aimed, buckets)))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = found.withColumns({"score": F.col("weight") + noise, "fit": F.col("n_words") >= least_words})
    return _ranked(found, ws, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``importance_resample`` of all documents towards all benchmark texts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = importance_resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
