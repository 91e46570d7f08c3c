"""Metric analytics: counters, gauges, histograms and their percentiles. Rows have name, tags (map), value, ts."""

from __future__ import annotations

import gc
import time
import tracemalloc
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Upper bounds of the histogram buckets.
BOUNDS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0]


def tag_key(tags: Column) -> Column:
    """A map as a grouping key: its entries in order."""
    return F.to_json(F.array_sort(F.map_entries(tags)))


def counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """Running totals."""
    return rows.groupBy(*by).agg(F.sum("value").alias("value"))


def gauges(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last value, kept in whole thousandths (truncated towards zero)."""
    last = F.max_by("value", F.struct("ts", "value"))
    return rows.groupBy(*by).agg((F.when(last < 0, F.ceil(last * 1000)).otherwise(F.floor(last * 1000)) / 1000.0).alias("value"))


def bucket_of(value: Column, bounds: list[float] | None = None) -> Column:
    """Index of the first bound that the value does not exceed; their number for what exceeds all."""
    bounds = bounds or BOUNDS
    out = F.when(value <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], start=1):
        out = out.when(value <= b, i)
    return out.otherwise(len(bounds))


def histogram(rows: DataFrame, by: list[str], bounds: list[float] | None = None) -> DataFrame:
    """(by..., bucket, n, total): counts and sums by bucket."""
    return rows.groupBy(*by, bucket_of(F.col("value"), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def percentiles(buckets: DataFrame, by: list[str], points: list[int], bounds: list[float] | None = None) -> DataFrame:
    """(by..., p, value): the bound of the first bucket whose running count reaches floor(count p / 100); the last bound for overflow."""
    bounds = bounds or BOUNDS
    upper = F.try_element_at(F.array(*[F.lit(b) for b in bounds]), F.least(F.col("bucket") + 1, F.lit(len(bounds))))
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    rows = buckets.withColumn("upto", running).withColumn("all", F.sum("n").over(Window.partitionBy(*by))).withColumn("upper", upper)
    rows = rows.withColumn("p", F.explode(F.array(*[F.lit(p) for p in points])))
    target = F.floor(F.col("all") * F.col("p") / 100)
    lowest = F.when(target == 0, F.lit(bounds[0]))
    return rows.groupBy(*by, "p").agg(F.coalesce(F.max(lowest), F.min(F.when(F.col("upto") >= target, F.col("upper")))).alias("value"))


def summary(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Count, sum and mean (0 for none)."""
    return buckets.groupBy(*by).agg(F.sum("n").alias("count"), F.sum("total").alias("sum")).withColumn("mean", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0))


def exported(counted: DataFrame, gauged: DataFrame, buckets: DataFrame) -> DataFrame:
    """(name, value) of all metrics: counters and gauges as they are, histograms as _count, _sum, _mean, _p50, _p90, _p95, _p99. Timers are histograms and are exported."""
    s = summary(buckets, ["name"])
    parts = F.explode(F.array(*[F.struct(F.concat("name", F.lit(f"_{k}")).alias("name"), F.col(k).cast("double").alias("value")) for k in ("count", "sum", "mean")]))
    p = percentiles(buckets, ["name"], [50, 90, 95, 99]).select(F.concat("name", F.lit("_p"), F.col("p").cast("string")).alias("name"), "value")
    plain = counted.select("name", F.col("value").cast("double").alias("value")).unionByName(gauged.select("name", "value"))
    return plain.unionByName(s.select(parts.alias("x")).select("x.*")).unionByName(p)


def latency(rows: DataFrame) -> DataFrame:
    """Per query the mean, least and greatest duration and the share of hits over the repeats after the first."""
    n = F.count("*")
    return rows.groupBy("query").agg(n.alias("iterations"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.when(n > 1, F.sum(F.col("hit").cast("int")) / (n - 1)).alias("hit_ratio"))


def derived(export: DataFrame) -> DataFrame:
    """Cache hit ratio, searches a second of uptime and mean search time in ms, of exported() rows named as Monitor names them; tagged series are summed by name. 0 where there is nothing to divide by."""
    v = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hits, misses = v("cache_hits_total"), v("cache_misses_total")
    return export.agg(
        share(hits, hits + misses).alias("hit_ratio"), share(v("searches_total"), v("system_uptime")).alias("searches_per_second"), share(v("search_duration_sum"), v("search_duration_count")).alias("mean_search_ms")
    )


class Monitor:
    """Metrics of searches on the driver: totals, last values and buckets, whose number does not grow with the searches."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.enabled, self._clock, self._began = True, clock, clock()
        self.counters: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self.buckets: dict[tuple[str, int], list[float]] = {}

    def count(self, name: str, by: float = 1.0) -> None:
        self.counters[name] = self.counters.get(name, 0.0) + by

    def observe(self, name: str, value: float) -> None:
        held = self.buckets.setdefault((name, bisect_left(BOUNDS, value)), [0, 0.0])
        held[0] += 1
        held[1] += value

    def searched(self, seconds: float, results: int, hit: bool, query: str) -> None:
        """One search: its time in ms, results, length of the query in bytes, and whether the cache had it."""
        if self.enabled:
            self.observe("search_duration", seconds * 1000.0)
            self.observe("query_length", float(len(query.encode())))
            self.gauges["search_results"] = float(results)
            self.count("searches_total")
            self.count("cache_hits_total" if hit else "cache_misses_total")

    def operated(self, operation: str, seconds: float) -> None:
        """Another operation, such as the loading of a corpus."""
        if self.enabled:
            self.observe(f"database_operation_duration_{operation}", seconds * 1000.0)
            self.count("database_operations_total")

    def exported(self, spark: SparkSession) -> DataFrame:
        """(name, value) of everything so far, and ``system_uptime`` in seconds."""
        plain = lambda rows: spark.createDataFrame(list(rows.items()), "name string, value double")
        held = spark.createDataFrame([(name, i, int(n), total) for (name, i), (n, total) in self.buckets.items()], "name string, bucket int, n long, total double")
        return exported(plain(self.counters), plain({**self.gauges, "system_uptime": self._clock() - self._began}), held)


def benchmark(name: str, run: Callable[[], object], iterations: int, clock: Callable[[], float] = time.perf_counter) -> dict:
    """Name, iterations, seconds, ns_per_op, bytes_per_op of calls of ``run``, after a collection of garbage.

    bytes_per_op is what Python on the driver holds more after the calls than before, by call;
    executors' memory is not in it. No calls: zeros.
    """
    gc.collect()
    traced = tracemalloc.is_tracing()
    if not traced:
        tracemalloc.start()
    before, began = tracemalloc.get_traced_memory()[0], clock()
    try:
        for _ in range(iterations):
            run()
        seconds, held = clock() - began, tracemalloc.get_traced_memory()[0] - before
    finally:
        if not traced:
            tracemalloc.stop()
    n = max(iterations, 1)
    return {"name": name, "iterations": max(iterations, 0), "seconds": seconds if iterations > 0 else 0.0, "ns_per_op": int(seconds * 1e9 / n) if iterations > 0 else 0, "bytes_per_op": held // n if iterations > 0 else 0}
