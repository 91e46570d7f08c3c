"""Chat formatting by perspective rotation.

Every participant of a dialogue is the assistant once: their turns are rendered as the
assistant's and trained on, the others' as those of named users, and what belongs to no
participant (system turns) as it is. A rendering holds at most ``TURNS`` turns; longer
dialogues go on in further parts, so that no task gathers a dialogue of any length. The
places of the turns come from a distributed scan: rows are range-partitioned by dialogue
and turn, numbered inside partitions, and shifted by what earlier partitions hold of the
same dialogue.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm.common import materialize, small_side

TURNS = 64
CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN = "unknown"


def _number(frames):
    """Adds the partition and each row's place among the rows of its dialogue in it; frames come sorted."""
    pid, last, n = TaskContext.get().partitionId(), None, 0
    for frame in frames:
        if not len(frame):
            continue
        conv = [None if v is None or v != v else v for v in frame["conv_id"].astype(object)]
        places = np.empty(len(conv), np.int64)
        for i, c in enumerate(conv):
            n = n + 1 if (c,) == last else 0
            last = (c,)
            places[i] = n
        yield frame.assign(pid=np.int32(pid), place=places)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, index): turns in the order of turn (null first), speaker and text, counted from 0."""
    ship(conversations.sparkSession)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    speaker = safe(F.regexp_replace(F.coalesce(F.col("role"), F.lit(UNKNOWN)), r"\s+", "_"))
    rows = conversations.select("conv_id", "turn", speaker.alias("speaker"), safe(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "speaker", "text", "tie"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    laid = laid.select("conv_id", "speaker", "text").mapInPandas(_number, f"conv_id {kind}, speaker string, text string, pid int, place long")
    laid = materialize(laid, "turns")
    held = laid.groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.withColumn("shift", F.sum("n").over(before)).filter("shift > 0").select(F.col("conv_id").alias("shift_conv"), F.col("pid").alias("shift_pid"), "shift")
    shifts = materialize(shifts, "turn-shifts")  # fewer rows than there are partitions
    s = small_side(shifts, shifts.count())
    moved = laid.join(s, laid["conv_id"].eqNullSafe(s["shift_conv"]) & (laid["pid"] == s["shift_pid"]), "left")
    return moved.select("conv_id", "speaker", "text", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("index"))


def rotate(conversations: DataFrame, turns: int = TURNS, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row for each dialogue, participant and part: conv_id, assistant, part, n_turns, rendered, mask.

    ``mask`` lists the trained spans of ``rendered`` (start, end in characters): the
    assistant's texts, each with its end mark. ``conversations`` needs conv_id, turn, role
    and text; other columns are not looked at. A null role is the participant "unknown", a
    null text is empty, null conv_ids are one dialogue; turns alike in number are ordered by
    speaker and text, and repeated rows are turns of their own. Markers in texts and white
    space in names are changed so that they cannot be taken for the format's. A dialogue
    without participants has no rendering; an empty table gives no rows.
    """
    rows = numbered_turns(conversations)
    part = F.floor(F.col("index") / turns).cast("long")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("index", "speaker", "text"))).alias("turns"))
    parts = materialize(parts, "parts")
    cast = materialize(rows.filter(~F.col("speaker").isin(*context_roles)).select(F.col("conv_id").alias("cast_conv"), F.col("speaker").alias("assistant")).distinct(), "participants")
    c = small_side(cast, cast.count())
    views = parts.join(c, parts["conv_id"].eqNullSafe(c["cast_conv"]))

    def segment(t: Column) -> Column:
        mine, context = t["speaker"] == F.col("assistant"), t["speaker"].isin(*context_roles)
        head = F.concat(F.lit(START), F.when(context, t["speaker"]).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["speaker"])), F.lit("\n"))
        return F.struct(head.alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (mine & ~context).alias("trained"))

    views = views.withColumn("segments", F.transform("turns", segment))
    size = lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + 1
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + F.char_length(s["head"])).alias("start"), (acc["at"] + size(s) - 1).alias("end"))
        return F.struct((acc["at"] + size(s)).alias("at"), F.when(s["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    return views.select("conv_id", "assistant", "part", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), F.aggregate("segments", start, step)["spans"].alias("mask"))


def rotation_report(conversations: DataFrame) -> DataFrame:
    """rotate() with the mask as text, ``start-end`` joined by spaces."""
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return rotate(conversations).withColumn("mask", F.array_join(spans, " "))


#: DuckDB form of rotation_report().
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(regexp_replace(coalesce(role, 'unknown'), '\s+', '_', 'g'), '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS index FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
s AS (
  SELECT n.conv_id, p.assistant, n.index // 64 AS part, n.index, speaker = assistant AS trained,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN speaker WHEN speaker = assistant THEN 'assistant'
                                ELSE 'user name=' || speaker END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, assistant, part ORDER BY index))::BIGINT AS upto FROM s)
SELECT conv_id, assistant, part::BIGINT AS part, count(*)::BIGINT AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY index) AS rendered,
       coalesce(string_agg((upto - 1 - length(body)) || '-' || (upto - 1), ' ' ORDER BY index) FILTER (WHERE trained), '') AS mask
FROM o GROUP BY conv_id, assistant, part
"""
