"""Schemas, and the normal form of records: no nulls, arrays for lists, lower-case helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("command", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("niche", T.StringType()),
    T.StructField("platform", T.ArrayType(T.StringType())),
    T.StructField("pipeline", T.BooleanType()),
])

HISTORY = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("results_count", T.LongType()),
    T.StructField("context", T.StringType()),
    T.StructField("duration", T.LongType()),
])
HISTORY_FILE = T.StructType([T.StructField("entries", T.ArrayType(HISTORY)), T.StructField("max_size", T.LongType())])
HISTORY_LINE = T.StructType([*HISTORY_FILE, T.StructField("user_id", T.StringType())])

METRIC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def _array(df: DataFrame, name: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(F.col(name), empty), lambda x: x.isNotNull()) if name in df.columns else empty


def records(df: DataFrame) -> DataFrame:
    """The record schema in its normal form, whatever of its columns ``df`` has (doc_id at least); others are left out."""
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in df.columns else F.lit("")
    flag = F.coalesce(F.col("pipeline"), F.lit(False)) if "pipeline" in df.columns else F.lit(False)
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), text("command").alias("command"), text("description").alias("description"), _array(df, "keywords").alias("keywords"), _array(df, "tags").alias("tags"),
        text("niche").alias("niche"), _array(df, "platform").alias("platform"), flag.alias("pipeline"),
    )


def lowered(df: DataFrame) -> DataFrame:
    """Records with command_lower, description_lower, keywords_lower and tags_lower."""
    low = lambda n: F.transform(n, lambda x: F.lower(x))
    return df.select("*", F.lower("command").alias("command_lower"), F.lower("description").alias("description_lower"), low("keywords").alias("keywords_lower"), low("tags").alias("tags_lower"))
