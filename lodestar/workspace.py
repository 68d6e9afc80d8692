"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage, survives lost executors and is computed once,
whereas ``checkpoint()`` computes the last stage of its plan twice.
"""

from __future__ import annotations

import atexit
import contextlib
import copy
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship_package


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where that is unset and the session is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where it has fewer, as of one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Workspace:
    """Tables of one operator call. They go when dropped, or else when the driver ends."""

    def __init__(self, spark: SparkSession, label: str = "op") -> None:
        ship_package(spark)  # operators with intermediate tables may run Python on the executors
        self.spark = spark
        self.root = f"{shared_root(spark)}/lodestar-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[str, str] = {}
        atexit.register(self.clear)

    def part(self, label: str) -> Workspace:
        """A workspace within this one, with names of its own: what is saved there drops no table that was saved here."""
        inner = copy.copy(self)
        inner.root, inner._n, inner._paths = self.path(label), 0, {}
        return inner

    def path(self, name: str) -> str:
        """A new folder's path, for what the caller writes."""
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from there; a table saved before under this name is dropped."""
        path = self.path(name)
        df.write.parquet(path)
        old, self._paths[name] = self._paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self._paths.pop(name, None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
