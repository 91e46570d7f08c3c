"""Getting the package to Python workers, and small tables to all cores."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A table of at most so many bytes a core, by Spark's estimate, may be dealt out anew (a split of a file has as many); bytes that are worth a task of their own, and bytes of a task at most.
SPREAD_BYTES, TASK_BYTES, MOST_BYTES = 128 << 20, 32 << 10, 32 << 20
#: Packed bytes of a task of a table that is dealt by key, up to eight tasks a core; sizes from UNKNOWN on are no estimates.
KEYED_BYTES, UNKNOWN = 1 << 20, 1 << 60

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexigrove-")) / "lexigrove.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(application)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table over the cores. Its file may be one row group, and so one task, however hard the work on each row.

    Tables beyond the bound, or of unknown size, have splits enough and stay where they are.
    """
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution().optimizedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if re.search(r"RepartitionByExpression|Repartition \d+, true", str(plan.toString())):  # dealt out before
        return df
    size = int(str(plan.stats().sizeInBytes()))
    tasks = max(min(cores, -(-size // TASK_BYTES)), size // MOST_BYTES)
    return df.repartition(tasks) if size <= SPREAD_BYTES * cores and tasks > 1 else df


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table over the cores by a hash of its key, so that whatever is made of its rows and grouped or joined by the key stays where it is."""
    if df.isStreaming or f"hashpartitioning({key}#" in str(df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()):  # dealt out before
        return df
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(min(cores, -(-size // TASK_BYTES)), min(8 * cores, size // KEYED_BYTES), size // MOST_BYTES) if size < UNKNOWN else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key)
