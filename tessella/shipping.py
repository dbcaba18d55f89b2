"""Gives the executors' Python workers this package, for clusters where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Bytes and rows of an Arrow batch of files: what a worker holds at once, unless one file is larger.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def ship_package(spark: SparkSession) -> None:
    """Adds the package's source to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Ships the package and bounds Arrow batches, so that a worker's memory doesn't follow the number and size of a task's files.

    Plans read these settings when they run, so they stay lowered in the session; values that are lower already are kept.
    """
    ship_package(spark)
    for key, default, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "2147483647", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, default).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def task_number(spark: SparkSession) -> int:
    """Four tasks for each core, and no fewer than the session's shuffle partitions."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, key: str = "path") -> DataFrame:
    """The rows dealt over four tasks for each core, by a key.

    For work in Python that costs far more than its rows' bytes: by bytes alone, a table of one small file is one task, and adaptive plans join small partitions.
    The number is named, so that they don't join these, and the hash keeps the planner from taking an earlier shuffle by the same key in place of this one.
    Where executors come and go, the cores of the moment say little, and the session's shuffle partitions are the least number.
    """
    spark = rows.sparkSession
    dynamic = spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    return rows.repartition(task_number(spark) if dynamic else 4 * spark.sparkContext.defaultParallelism, F.xxhash64(key))
