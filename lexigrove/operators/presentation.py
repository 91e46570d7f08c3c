"""Results for display: rows of a list, table or JSON, and the steps of pipeline commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords that a saved pipeline gets for the tools in it.
AUTO_KEYWORDS = {"grep": ["search", "filter"], "sort": ["sort", "order"], "awk": ["process", "text"], "sed": ["replace", "edit"], "find": ["find", "search"], "xargs": ["batch", "execute"]}


def pipeline_steps(command: Column) -> Column:
    """The steps of a pipeline, trimmed."""
    return F.transform(F.split(command, r"\|"), lambda x: F.trim(x))


def pretty_pipeline(command: Column) -> Column:
    return F.replace(command, F.lit("|"), F.lit(" │ "))


def auto_keywords(command: Column) -> Column:
    """The words for the tools that occur in a command."""
    none = F.array().cast("array<string>")
    parts = [F.when(F.contains(command, F.lit(t)), F.array(*[F.lit(w) for w in words])).otherwise(none) for t, words in AUTO_KEYWORDS.items()]
    return F.array_distinct(F.concat(F.array(F.lit("pipeline")), *parts))


def as_table(results: DataFrame) -> DataFrame:
    """Fixed-width columns: commands at 48 and categories at 24 characters."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(F.col(c))
    return results.select("qid", "rank", cut("command", 48).alias("command"), cut("niche", 24).alias("category"), F.round("score", 2).alias("score"))


def as_json(results: DataFrame) -> DataFrame:
    """One JSON object a result; niche is called category."""
    return results.select("qid", "rank", F.to_json(F.struct("command", "description", "keywords", F.col("niche").alias("category"), "platform", "pipeline", "score")).alias("json"))
