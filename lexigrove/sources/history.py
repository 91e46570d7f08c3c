"""History files: a JSON document with entries and max_size, one user a file; or, for many users, a document a line with user_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.schema import HISTORY_FILE, HISTORY_LINE


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(user_id, seq, query, ts, results_count, context, duration_ms), only a user's last max_size entries; no file, no rows.

    One document a file, whose user is its folder ``user_id=...`` or else the file's name;
    with ``lines`` one document a line, with its user_id.
    """
    try:
        if lines:
            files = spark.read.schema(HISTORY_LINE).json(path)
        else:
            files = spark.read.schema(HISTORY_FILE).json(path, multiLine=True)
            own = F.col("user_id").cast("string") if "user_id" in files.columns else F.col("_metadata.file_name")
            files = files.select("entries", "max_size", own.alias("user_id"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], HISTORY_FILE).withColumn("user_id", F.lit(""))
    rows = files.select("user_id", "max_size", F.size("entries").alias("n"), F.posexplode("entries").alias("seq", "e"))
    rows = rows.filter(F.col("max_size").isNull() | (F.col("max_size") <= 0) | (F.col("seq") >= F.col("n") - F.col("max_size")))
    return rows.select("user_id", "seq", "e.query", F.col("e.timestamp").alias("ts"), "e.results_count", "e.context", F.col("e.duration").alias("duration_ms"))


def write_history(log: DataFrame, path: str, max_size: int = 100, lines: bool = False) -> None:
    """One document a user, overwriting what is there: each in a folder of its own or, with ``lines``, a line each."""
    entry = F.struct("seq", "query", F.col("ts").alias("timestamp"), "results_count", "context", F.col("duration_ms").alias("duration"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("seq"))
    users = log.groupBy("user_id").agg(ordered.alias("entries")).withColumn("max_size", F.lit(max_size).cast("long"))
    if lines:
        users.withColumn("user_id", F.col("user_id").cast("string")).write.mode("overwrite").json(path)
    else:
        users.write.mode("overwrite").partitionBy("user_id").json(path)
