"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of a size that fits in
memory, by a seeded hash of the whole record. Pass two shuffles each bucket
(Fisher-Yates, seeded by bucket) and writes it. The buckets one after the
other are a uniform permutation of all records; it is dealt into shards whose
row counts are at most one apart (law ``rows``), each a range of positions, so
a bucket touches few shards and a slot is a position within its range.

Records that are equal in all columns have one hash. Those that stand more than
``HOT_ROWS`` times are scattered by their place in the input besides, so no
bucket has to hold all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace, spread

#: Least and greatest bytes of a bucket; between them there are ``BUCKETS``.
BUCKET_BYTES, MOST_BYTES, BUCKETS = 32 << 20, 512 << 20, 50_000
#: Bytes counted for a record besides its text.
OVERHEAD = 16
#: Equal records from which on they are scattered one by one, at least; never more than ``HOT_KEYS`` of them are told apart.
HOT_ROWS, HOT_KEYS = 10_000, 10_000
#: Bytes of a partition, at least.
LEAST_PARTITION = 8 << 20
#: Rows of a batch that a task gives back.
OUT_ROWS = 4096
_BUCKET, _HASH, _SECOND = "lodestar bucket", "lodestar hash", "lodestar second hash"


def bucket_size(n_bytes: int) -> int:
    return min(MOST_BYTES, max(BUCKET_BYTES, n_bytes // BUCKETS))


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 0, bucket_bytes: int | None = None, text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """All rows of ``df``, with all columns, and shard (0 to n_shards - 1) and slot (0, 1, ... within the shard).

    Counts of shards differ by one at most. The result depends on the rows, the
    seed and the number of buckets, not on how the input is partitioned; rows
    that are equal in all columns are interchangeable, and where one stands more
    than ``hot_rows`` times, the places of other rows depend on the input's
    layout too. Columns of any type take part, nulls are values like any other.
    Columns named shard or slot are replaced. An empty table gives an empty result.

    To the driver go a number for each bucket, 200,000 for 100 TB, and up to
    ``HOT_KEYS`` hashes.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    whole = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    hashed = df.withColumn(_HASH, F.xxhash64(F.lit(seed), *whole))
    sizes = hashed.groupBy(_HASH).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).alias("bytes"))
    n_bytes, n_rows, most = sizes.agg(F.sum("bytes"), F.sum("n"), F.max("n")).first()
    n_buckets = max(1, -(-(n_bytes or 0) // (bucket_bytes or bucket_size(n_bytes or 0))))
    hot_rows = max(hot_rows, (n_rows or 0) // HOT_KEYS)
    key = F.col(_HASH)
    if (most or 0) > hot_rows:
        hot = [r[0] for r in sizes.where(F.col("n") > hot_rows).select(_HASH).collect()]
        key = F.when(key.isin(hot), F.xxhash64(key, F.monotonically_increasing_id())).otherwise(key)
    keyed = hashed.withColumn(_BUCKET, F.pmod(key, F.lit(n_buckets)).cast("int")).withColumn(_SECOND, F.xxhash64(F.lit(seed + 1), *whole))

    counts = np.zeros(n_buckets + 1, np.int64)
    for r in keyed.groupBy(_BUCKET).count().collect():
        counts[r[0] + 1] = r[1]
    starts = spark.sparkContext.broadcast(np.cumsum(counts))
    base, more = divmod(int(counts.sum()), n_shards)
    columns = df.columns

    names = [*columns, _HASH, _SECOND]

    def deal(bucket: int, batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches)
        by_hash = np.lexsort((table[_SECOND].to_numpy(), table[_HASH].to_numpy()))  # how rows arrive must not matter
        order = np.arange(len(table))
        np.random.Generator(np.random.Philox([seed, bucket])).shuffle(order)  # Fisher-Yates
        at = starts.value[bucket] + np.arange(len(table))
        cut = more * (base + 1)
        shard = np.where(at < cut, at // (base + 1), more + (at - cut) // max(base, 1))
        slot = at - np.where(shard <= more, shard * (base + 1), cut + (shard - more) * base)
        table = table.select(columns).take(pa.array(by_hash[order]))
        return table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket after the other; they come sorted."""
        held, bucket = [], None
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(ids))[0] + 1).tolist(), len(ids)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and ids[start] != bucket:
                    yield from deal(bucket, held).to_batches(max_chunksize=OUT_ROWS)
                    held = []
                bucket = int(ids[start])
                held.append(batch.slice(start, end - start).select(names))
        if held:
            yield from deal(bucket, held).to_batches(max_chunksize=OUT_ROWS)

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # a bucket is a partition, by its number and not by a hash of it, so none has two; only buckets of less than usual size share one
    n_parts = min(n_buckets, max(1, -(-(n_bytes or 0) // LEAST_PARTITION)))
    placed = keyed.select(*columns, _HASH, _SECOND, _BUCKET).repartitionById(n_parts, F.col(_BUCKET) % n_parts).sortWithinPartitions(_BUCKET)
    return placed.mapInArrow(run, schema)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; the files' rows carry their slot. No further shuffle: buckets write where their ranges lie."""
    placed.write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of ``documents`` stands in the shards, as read from the shards that were written.

    Whole records are shuffled and written. Null texts have no bytes; null ids,
    repeated rows and further columns are dealt like any other, and an empty
    table gives an empty result.
    """
    placed = shuffle_into_shards(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), 40, seed=42)
    path = Workspace(spark, "shards").path("written")
    write_shards(placed, path)
    written = spark.read.schema(placed.schema).parquet(path)
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
