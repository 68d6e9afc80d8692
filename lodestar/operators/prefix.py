"""Running sums and maxima over groups of any size, in two levels.

Rows are range partitioned by group and order, so a large group lies in several
partitions. Each partition is summed up, the sums of those before are carried
over, and a window runs within a partition only: no task has more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Workspace

_HOW = {"sum": F.sum, "max": F.max}


def running_before(rows: DataFrame, group: list[str], order: list[Column], value: str, how: str = "sum", parts: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum or maximum of ``value`` over those of its group that come before it, null for the first.

    ``order`` should tell rows apart, as rows that tie stay in one partition. Null groups are groups like others. ``parts`` is the number of partitions.
    """
    ws = ws or Workspace(rows.sparkSession, "running")
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group]
    placed = ws.save(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "placed")
    # a partition's edge cuts one group, so no more rows than partitions are carried
    totals = placed.groupBy("_part", *group).agg(_HOW[how](value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", _HOW[how]("_total").over(earlier)).where("_carried IS NOT NULL")
    carried = ws.save(carried.select(F.col("_part").alias("_at"), *[F.col(c).alias(f"_of_{c}") for c in group], "_carried"), "carried")
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_within", _HOW[how](value).over(within))
    on = F.col("_part") == F.col("_at")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = summed.join(F.broadcast(carried), on, "left")
    if how == "sum":
        before = F.when(F.col("_carried").isNotNull() | F.col("_within").isNotNull(), F.coalesce("_carried", F.lit(0)) + F.coalesce("_within", F.lit(0)))
    else:
        before = F.greatest("_carried", "_within")
    return out.select(*rows.columns, before.alias("before"))
