"""Scoring documents by cross-entropy difference.

A target and a background model are counted over all rows of their corpora. They are
matched: the same tokens (visible characters, and the ends of the runs between white
space), the same order and smoothing, and one shared set of grams, those of the
background. A document's score is the mean over its tokens of its loss under the target
less its loss under the background; lower is closer to the target.

Every gram is kept, whatever its count. The grams lie in a table partitioned by gram; the
rows are dealt into blocks of bounded bytes, a block's different grams are joined with the
table, and a block is scored with the grams that came back. No task and no machine holds
the table of the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm import char_lm
from lexigrove.llm.bytes_kernel import chunks
from lexigrove.llm.common import materialize, small_side

#: Bytes of text in a block, besides its last row, and what a row counts beyond its text.
BLOCK, ROW = 4 << 20, 64
#: Values of ``part``: a row is only scored; it is of the background; it is of the target as well.
SCORED, BACKGROUND, TARGET = 0, 1, 2
MODELS = ("target", "background")

_tables: dict[str, np.ndarray] = {}


def _visible() -> np.ndarray:
    if "visible" not in _tables:
        _tables["visible"] = char_lm.visible_table()
    return _tables["visible"]


def _dealt(batches):
    """A task's rows, the text last, with the block of each before it."""
    first, done = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        upto = done + np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64) + ROW)
        block = first + np.concatenate([[done], upto[:-1]])[: len(upto)] // BLOCK
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block.astype(np.int64)), text], names=[*batch.schema.names[:-1], "block", "text"])
        done = int(upto[-1]) if len(upto) else done


def _count(batches):
    """(block, gram, target, background) of (part, block, text) batches; a block may come in several portions."""
    for batch in batches:
        block = np.asarray(batch.column(1))
        cuts = np.flatnonzero(np.diff(block)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(block)]):
            own, counted = np.asarray(batch.column(0))[start:end], []
            for chunk, starts, rows in chunks(batch.column(2).slice(start, end - start)):
                s, index = char_lm.symbols(chunk, starts, _visible())
                keys = char_lm.gram_keys(s)
                part = np.repeat(own[rows], np.diff(np.append(index, len(s))))
                for p in (SCORED, BACKGROUND, TARGET):
                    different, n = np.unique(keys[part == p], return_counts=True)
                    counted.append((different, np.stack([n * (p == TARGET), n * (p != SCORED)], axis=1)))
            if counted:
                keys, counts = char_lm._summed(np.concatenate([c[0] for c in counted]), np.concatenate([c[1] for c in counted]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block[start])), pa.array(keys.view(np.int64)), *[pa.array(counts[:, i].astype(np.int64)) for i in (0, 1)]], names=["block", "gram", *MODELS])


def _short(order: int) -> Column:
    """The last ``order`` symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << char_lm.BITS * order) - 1))


def model(counts: DataFrame) -> DataFrame:
    """(gram, target, background): the log-probability of each different gram of order 4, as ``char_lm.build`` defines it.

    ``counts``: rows (gram, target, background), several a gram. Grams without a count get what their back-off gives.
    """
    level = materialize(counts.groupBy("gram").agg(*[F.sum(m).alias(m) for m in MODELS]), "lm-grams")
    levels = [level]
    for order in range(char_lm.ORDER - 1, 0, -1):  # a lower gram counts the different grams that it ends
        level = materialize(level.groupBy(_short(order).alias("gram")).agg(*[F.count_if(F.col(m) > 0).alias(m) for m in MODELS]), f"lm-grams{order}")
        levels.insert(0, level)
    below = None
    for order, level in enumerate(levels, start=1):
        facts = level.agg(*[f(F.col(m)).alias(f"{m}_{k}") for m in MODELS for k, f in (("ones", lambda n: F.count_if(n == 1)), ("twos", lambda n: F.count_if(n == 2)), ("total", lambda n: F.coalesce(F.sum(n), F.lit(0))), ("kinds", lambda n: F.count_if(n > 0)))]).first()
        context = Window.partitionBy(F.shiftrightunsigned("gram", char_lm.BITS))
        columns = []
        for m in MODELS:
            discount = min(max((facts[f"{m}_ones"] + 0.5) / (facts[f"{m}_ones"] + 2.0 * facts[f"{m}_twos"] + 1.0), 0.05), 0.95)
            if order == 1:  # its one context is empty
                total, kinds, lower = F.lit(facts[f"{m}_total"]), F.lit(facts[f"{m}_kinds"]), F.lit(1.0 / (max(1, facts["background_kinds"]) + 1.0))
            else:
                total, kinds, lower = F.sum(m).over(context), F.count_if(F.col(m) > 0).over(context), F.col(f"{m}_below")
            columns += [total.alias(f"{m}_total"), kinds.alias(f"{m}_kinds"), F.lit(discount).alias(f"{m}_discount"), *([lower.alias(f"{m}_below")] if order == 1 else [])]
        known = level.select("gram", *MODELS, *columns)
        if below is not None:
            known = known.withColumn("short", _short(order - 1)).join(below, "short")
        below = known.select("gram", *[_mixed(m).alias(m) for m in MODELS])
        if order < char_lm.ORDER:
            below = below.select(F.col("gram").alias("short"), *[F.col(m).alias(f"{m}_below") for m in MODELS])
    return below.select("gram", *[F.log(m).alias(m) for m in MODELS])


def _mixed(m: str) -> Column:
    """The probability of a gram: its discounted share of its context, and what the discounts leave to the order below."""
    n, total, kinds, discount, below = (F.col(f"{m}{x}") for x in ("", "_total", "_kinds", "_discount", "_below"))
    some = F.greatest(total, F.lit(1))
    return F.when(total > 0, F.greatest(n - discount, F.lit(0.0)) / some + discount * kinds / some * below).otherwise(below)


def cross_entropy_difference(rows: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., n_tokens, loss_target, loss_background, score) of each row's whole text, under models of the rows (text, part).

    Null, empty and blank texts have no tokens, and null losses and score.
    """
    ship(rows.sparkSession)
    own = rows.select(*carry, F.col("part").cast("int").alias("part"), "text")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    dealt = materialize(own.mapInArrow(_dealt, f"{kept}, part int, block long, text string"), "lm-rows")
    counts = materialize(dealt.select("part", "block", "text").mapInArrow(_count, "block long, gram long, target long, background long"), "lm-counts")
    asked = counts.select("block", "gram").join(model(counts), "gram")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = left.column("text").combine_chunks()
        total, n = np.zeros((left.num_rows, 2)), np.zeros(left.num_rows, dtype=np.int64)
        if right.num_rows:
            grams, at = np.unique(right.column("gram").to_numpy().view(np.uint64), return_index=True)
            table = char_lm.HashArray(grams, np.stack([right.column(m).to_numpy()[at] for m in MODELS], axis=1))
            for chunk, starts, rows in chunks(text):
                s, index = char_lm.symbols(chunk, starts, _visible())
                place, there = table.find(char_lm.gram_keys(s))
                if not there.all():
                    raise ValueError("a gram of the block did not come back")
                upto = np.concatenate([np.zeros((1, 2)), np.cumsum(table.values[place], axis=0, dtype=np.float64)])
                ends = np.append(index[1:], len(s))
                np.add.at(total, rows, upto[index] - upto[ends])
                np.add.at(n, rows, ends - index)
        none = n == 0
        mean = total / np.maximum(n, 1)[:, None]
        values = [mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1]]
        return pa.Table.from_arrays([left.column(c) for c in carry] + [pa.array(n)] + [pa.array(v, mask=none) for v in values], names=carry + ["n_tokens", "loss_target", "loss_background", "score"])

    scored = dealt.select(*carry, "block", "text").groupBy("block").cogroup(asked.groupBy("block"))
    return scored.applyInArrow(run, f"{kept}, n_tokens long, loss_target double, loss_background double, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of all ``docs``; the target are those that ``labels`` gives quality 1.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns, whatever
    their names, are not looked at. Null, empty and blank texts have no tokens, and null
    losses and score. Repeated rows count each and score alike; an id with several labels is
    of the target if one is 1; a null id is of the background. Without a label of 1 the
    target's losses are those of a model without counts. Whole texts of any length count; no
    rows give no rows.
    """
    own = docs.select("doc_id", "text")
    good = labels.groupBy(F.col("doc_id").alias("target_id")).agg(F.max("quality").alias("q")).filter("q = 1 and target_id is not null").select("target_id")
    good = small_side(good, good.count())
    marked = own.join(good, own["doc_id"] == good["target_id"], "left").select("doc_id", F.when(F.col("target_id").isNotNull(), TARGET).otherwise(BACKGROUND).alias("part"), "text")
    return cross_entropy_difference(marked, ["doc_id"])
