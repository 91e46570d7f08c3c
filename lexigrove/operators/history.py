"""Search history analytics. A log has user_id, query, ts and seq (its order within a user), results_count, duration_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, DEFAULT = 100, 10


def collapsed(log: DataFrame) -> DataFrame:
    """K4: of a user's adjacent equal queries the last stays."""
    w = Window.partitionBy("user_id").orderBy("seq")
    following = F.lead("query").over(w)
    return log.withColumn("following", following).filter(F.col("following").isNull() | (F.col("following") != F.col("query"))).drop("following")


def kept(log: DataFrame, size: int = SIZE) -> DataFrame:
    """K4: a user's last ``size`` entries after collapsing."""
    w = Window.partitionBy("user_id").orderBy(F.col("seq").desc())
    return collapsed(log).withColumn("age", F.row_number().over(w)).filter(F.col("age") <= size).drop("age")


def recent_queries(log: DataFrame, limit: int = DEFAULT) -> DataFrame:
    """K3: (user_id, rank, query): a user's different queries, the newest first."""
    last = log.groupBy("user_id", "query").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("user_id").orderBy(F.col("seq").desc())
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (limit if limit > 0 else DEFAULT)).select("user_id", "rank", "query")


def top_queries(log: DataFrame, limit: int = DEFAULT) -> DataFrame:
    """(query, count, last_used) by count, then last use, over the whole log."""
    return log.groupBy("query").agg(F.count("*").alias("count"), F.max("ts").alias("last_used")).orderBy(F.col("count").desc(), F.col("last_used").desc(), "query").limit(limit if limit > 0 else DEFAULT)


def matching(log: DataFrame, pattern: str) -> DataFrame:
    """P10: entries whose query has the pattern, case ignored; order by ts descending to see the newest first."""
    return log.filter(F.contains(F.lower("query"), F.lit(pattern.lower())))


def stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, different queries (exact), means and the first and last entry by position."""
    duration = F.coalesce(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), F.lit(0.0))
    return log.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_distinct("query").alias("different"), F.coalesce(F.avg("results_count"), F.lit(0.0)).alias("avg_results"), duration.alias("avg_duration_ms"),
        F.min_by("ts", "seq").alias("oldest"), F.max_by("ts", "seq").alias("newest"),
    )


def time_ago(ts, now):
    """Words for the time between two timestamps: minutes, hours, days, weeks, months of 30 days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    whole = lambda k: F.floor(s / k)
    return F.when(s < 60, "just now").when(s < 3600, many(whole(60), "minute")).when(s < 86400, many(whole(3600), "hour")).when(s < 604800, many(whole(86400), "day")).when(s < 2592000, many(whole(604800), "week")).otherwise(many(whole(2592000), "month"))
