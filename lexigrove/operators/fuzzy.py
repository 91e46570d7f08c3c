"""Fuzzy matching: a query matches a text that has its characters in order.

The score is our own: a match starts at 0; every run of adjacent characters and every
match at the start of a word earns, every gap and every unmatched character costs. Higher is better; a text equal to the query scores best.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.cluster import ship
from lexigrove.operators.channels import blocks

FIRST, AFTER_BREAK, ADJACENT, LEADING_GAP, UNMATCHED = 10, 10, 15, -5, -1
_BREAKS = " -_/.\\"


def fuzzy_score(pattern: str, text: str) -> int | None:
    """Best-effort greedy score of one pattern in one text, or None if the characters are not there in order."""
    low_p, low_t = pattern.lower(), text.lower()
    if not low_p:
        return None
    score, at, last = 0, -1, -2
    for c in low_p:
        at = low_t.find(c, at + 1)
        if at < 0:
            return None
        if at == 0:
            score += FIRST
        elif low_t[at - 1] in _BREAKS:
            score += AFTER_BREAK
        if at == last + 1:
            score += ADJACENT
        if last < 0:
            score += max(LEADING_GAP * at, 3 * LEADING_GAP)
        last = at
    return score + UNMATCHED * (len(low_t) - len(low_p))


def _scores(pattern: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None else fuzzy_score(p, t) for p, t in zip(pattern, text)], dtype="Int32")


def _matched(texts: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    """Every query against every text: ``queries`` is a stated set, sent to each block of texts, a block of queries at a time. Texts without the first letters' characters never reach Python."""
    ship(queries.sparkSession)
    asked = queries.select("qid", "text", F.array_distinct(F.split(F.lower("text"), "")).alias("letters"))
    texts = texts.withColumn("low", F.lower(column))
    has_letters = F.forall("letters", lambda c: F.contains(F.col("low"), c))
    pairs = reduce(DataFrame.unionByName, [texts.join(F.broadcast(block), has_letters) for block in blocks(asked)])
    return pairs.withColumn("fuzzy", F.pandas_udf(_scores, "int")("text", column)).filter(F.col("fuzzy").isNotNull())


def _top(df: DataFrame, k: int | Column, key: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("fuzzy").desc(), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuzzy_search(docs: DataFrame, queries: DataFrame, limit: int = 10, threshold: int = -30) -> DataFrame:
    """The first 2 L matches in command and description; platforms and pipelines do not matter. Threshold only if above 0. (qid, rank, doc_id, score, command, description)."""
    texts = docs.select("doc_id", "command", "description", F.concat_ws(" ", "command", "description").alias("target"))
    best = _top(_matched(texts, queries, "target"), 2 * limit, "doc_id")
    if threshold > 0:
        best = best.filter(F.col("fuzzy") >= threshold)
    score = F.least(F.greatest((F.col("fuzzy") + 100) / 100.0, F.lit(0.0)), F.lit(1.0))
    return best.select("qid", "rank", "doc_id", score.alias("score"), "command", "description")


def suggestion_words(docs: DataFrame) -> DataFrame:
    """The different words of commands and descriptions that may be suggested."""
    trim = lambda chars: lambda w: F.lower(F.btrim(w, F.lit(chars)))
    cmd = F.transform(F.split("command", r"\s+"), trim("-_.[]{}()"))
    desc = F.filter(F.transform(F.split("description", r"\s+"), trim(".,!?;:()[]{}\"'")), lambda w: ~w.isin(*lexicon.COMMON_WORDS))
    return docs.select(F.explode(F.array_distinct(F.concat(cmd, desc))).alias("word")).filter(F.octet_length("word") > 2).distinct()


def suggestions(docs: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """(qid, rank, word) of matches that score at least -20."""
    best = _top(_matched(suggestion_words(docs), queries, "word"), most if most > 0 else 5, "word")
    return best.filter(F.col("fuzzy") >= -20).select("qid", "rank", "word")
