"""Windowed metrics and histories over event streams, and searches of streamed queries. Extensions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrove.operators.search import search


def windowed_metrics(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and means by name and tumbling window; events (ts, name, value). Later events than ``late`` are left out by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "name")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "name", "n", "total", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users, by gaps in their events (user_id, ts)."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def collapsed_history(log: DataFrame) -> DataFrame:
    """K4 over a stream: (user_id, query, repeats) whenever a user's query changes; state is one row a user."""

    def run(key: tuple, frames, state: GroupState):
        query, n = state.get if state.exists else (None, 0)
        out = []
        for f in frames:
            for q in f.sort_values("ts")["query"]:
                if q == query:
                    n += 1
                    continue
                if query is not None:
                    out.append((key[0], query, n))
                query, n = q, 1
        state.update((query, n))
        yield pd.DataFrame(out, columns=["user_id", "query", "repeats"])

    return log.groupBy("user_id").applyInPandasWithState(run, "user_id long, query string, repeats long", "query string, n long", "append", GroupStateTimeout.NoTimeout)


def search_stream(corpus, queries: DataFrame, sink: Callable[[DataFrame, int], None], options=None, checkpoint: str | None = None):
    """Answer streamed queries (qid, text): each micro-batch is a query set against the corpus's tables, handed to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(search(corpus, rows, options), number)

    writer = queries.writeStream.foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
