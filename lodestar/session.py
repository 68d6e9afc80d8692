"""SparkSession factory with the settings that the engine is tested under, and shipping of the package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "lodestar") -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitter's settings hold instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def submitted_session(app: str = "lodestar") -> SparkSession:
    """The session that the submitter's settings describe; local where nothing names a master."""
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lodestar-ship-")) / "lodestar.zip"
    with zipfile.ZipFile(to, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
