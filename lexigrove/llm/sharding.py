"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, hash of id and text, number), so that equal texts lie
side by side. Keys are drawn with a chance in proportion to a row's cost; quantiles of the
draw split the order into many more ranges than shards, between texts. Ranges that turn out
overfull are drawn from again, more densely, and split; a group of equal texts is cut only
where it exceeds a shard (its parts then fill shard after shard) or, for the numbering, into
parts that stay together. The ranges go to the shards largest first, each to the shard
with the fewest bytes, and a row's slot is its place in its range after the ranges before it.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm.common import materialize

ROW_BYTES = 16
#: Ranges for each shard at least; drawn keys for each range on the average; rows in a range at most, more or less.
RANGES, DRAWS, RANGE_ROWS = 32, 12, 2_000_000
#: Largest difference of two shards, as a part of the mean, for which the rest of a cut group stays together.
UNEQUAL = 0.02
LOWEST = int(np.iinfo(np.int64).min)
KEY = ["major", "minor", "number"]


def _range_of(splitters: list[tuple[int, int, int]]):
    """Vectorised: how many splitters (sorted triples) are at or below (major, minor, number)."""
    keys = np.array(splitters, dtype=np.int64).reshape(-1, 3)

    def place(low: int, high: int, rows: np.ndarray, columns: list[np.ndarray], depth: int, out: np.ndarray) -> None:
        own, own_keys = columns[depth][rows], keys[low:high, depth]
        first, last = low + np.searchsorted(own_keys, own, "left"), low + np.searchsorted(own_keys, own, "right")
        out[rows] = last if depth == 2 else first
        if depth < 2:
            for at in np.unique(first[first < last]):  # splitters that share the row's key so far
                same = (first == at) & (first < last)
                place(int(at), int(last[same][0]), rows[same], columns, depth + 1, out)

    @F.pandas_udf("int")
    def range_of(major: pd.Series, minor: pd.Series, number: pd.Series) -> pd.Series:
        columns = [c.to_numpy(np.int64) for c in (major, minor, number)]
        out = np.zeros(len(major), np.int64)
        if len(major) and len(keys):
            place(0, len(keys), np.arange(len(major)), columns, 0, out)
        return pd.Series(out.astype(np.int32))

    return range_of


def _draw(rows: DataFrame, rate: Column, by: list[str]) -> list[tuple]:
    """(key, weight) drawn with chance ``rate`` (their weight, where over 1), sorted; ``by`` are the leading columns of the key, the others LOWEST."""
    chance = F.pmod(F.xxhash64(F.lit("draw"), *KEY), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(chance < rate).groupBy(*by).agg(F.sum(F.greatest(rate, F.lit(1.0))).alias("weight"))
    return sorted((tuple(r[: len(by)]) + (LOWEST,) * (3 - len(by)), r["weight"]) for r in drawn.collect())


def _quantiles(drawn: list[tuple], pieces: int) -> set[tuple[int, int, int]]:
    total, upto, given, out = sum(w for _, w in drawn), 0.0, 0, set()
    for key, weight in drawn:
        reached = min(pieces - 1, int(upto * pieces / total))
        if reached > given:
            out.add(key)
            given = reached
        upto += weight
    return out


def shard_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, crc, major, minor, number) of each row; the number tells rows alike in id and text apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), *_key())


def _key() -> list[Column]:
    major = F.xxhash64(F.col("text"))
    return [major.alias("major"), F.xxhash64(F.col("doc_id"), major).alias("minor"), F.xxhash64(F.monotonically_increasing_id()).alias("number")]


def splitters(rows: DataFrame, shards: int, ranges_per_shard: int = RANGES, range_rows: int = RANGE_ROWS) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(splitters, shard of each range, first slot of each range) for materialized shard_keys().

    What reaches the driver is bounded by the number of ranges: the drawn keys and one row a range.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return [], [0], [0]
    wanted = shards * max(ranges_per_shard, math.ceil(n / shards / range_rows))
    cost = F.col("size") + F.lit(total / n)
    rate = cost * (wanted * DRAWS / (2.0 * total))
    cuts = sorted(_quantiles(_draw(rows, rate, ["major"]), wanted))
    while True:
        ranged = rows.withColumn("range", _range_of(cuts)(*KEY))
        sums = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
        table = {r["range"]: r for r in sums.collect()}
        groups = _one_text(table)
        texts, parts = {}, {}  # overfull ranges, split between texts or inside one
        for k, r in table.items():
            full = max(r["bytes"] * wanted / total, r["rows"] * wanted / n)
            if full <= 3 or tuple(r["first"]) == tuple(r["last"]):
                continue
            if r["first"]["major"] != r["last"]["major"]:
                texts[k] = math.ceil(full)
            elif groups[r["first"]["major"]][0] * shards > total or r["rows"] > 3 * range_rows:
                parts[k] = math.ceil(full)
        if not texts and not parts:
            break
        new = set()
        for over, by in ((texts, KEY[:1]), (parts, KEY)):
            if not over:
                continue
            drawn = _draw(ranged.filter(F.col("range").isin(list(over))), rate, by)
            keys = [key for key, _ in drawn]
            for k, pieces in over.items():
                low, high = tuple(table[k]["first"]), tuple(table[k]["last"])
                inside = drawn[bisect.bisect_right(keys, low) : bisect.bisect_right(keys, high)]
                new |= _quantiles(inside, 2 * pieces) or {(high[0], LOWEST, LOWEST) if by == KEY[:1] else high}
        cuts = sorted(set(cuts) | new)
    return cuts, *_placement(table, groups, len(cuts) + 1, shards, total)


def _one_text(table: dict) -> dict[int, tuple[int, list[int]]]:
    """Of each major that fills ranges of its own: its bytes, and those ranges in order."""
    out = {}
    for k in sorted(table):
        r = table[k]
        if r["first"]["major"] == r["last"]["major"]:
            size, ranges = out.get(r["first"]["major"], (0, []))
            out[r["first"]["major"]] = (size + r["bytes"], ranges + [k])
    return out


def _placement(table: dict, groups: dict, n_ranges: int, shards: int, total: int) -> tuple[list[int], list[int]]:
    """(shard, first slot) of each range.

    A group larger than a shard fills whole shards; what is left of it, like the groups and
    ranges that stay whole, goes to the emptiest shard, the largest first. Should that leave
    the shards unequal, what is left of the cut groups evens them out instead.
    """
    mean = total / shards
    taken, whole, rests = [], {}, []
    for _, ranges in sorted(((size, ranges) for size, ranges in groups.values() if size > mean), key=lambda g: g[1]):
        rest, left = list(ranges), sum(table[k]["bytes"] for k in ranges)
        while left >= mean and len(taken) < shards:
            load = 0
            while rest and (not load or load + table[rest[0]]["bytes"] / 2 < mean):
                k = rest.pop(0)
                load += table[k]["bytes"]
                whole[k] = len(taken)
            left -= load
            taken.append(load)
        rests.append(rest)
    cut = {k for size, ranges in groups.values() if size > mean for k in ranges}
    in_group = {k for _, ranges in groups.values() for k in ranges}
    units = [(size, ranges) for size, ranges in groups.values() if size <= mean] + [(r["bytes"], [k]) for k, r in table.items() if k not in in_group]
    size_of = lambda ranges: sum(table[k]["bytes"] for k in ranges)

    def place(even_out: bool) -> tuple[list[int], float]:
        shard_of, load = [0] * n_ranges, taken + [0] * (shards - len(taken))
        for k, shard in whole.items():
            shard_of[k] = shard
        heap = [(size, shard) for shard, size in enumerate(load)]
        heapq.heapify(heap)
        some = units + [(size_of(rest), rest) for rest in rests if rest and not even_out]
        for size, ranges in sorted(some, key=lambda u: (-u[0], u[1])):
            least, shard = heapq.heappop(heap)
            for k in ranges:
                shard_of[k] = shard
            heapq.heappush(heap, (least + size, shard))
        for rest in rests if even_out else []:
            least, shard = heapq.heappop(heap)
            for k in rest:
                if least + table[k]["bytes"] / 2 > mean:
                    heapq.heappush(heap, (least, shard))
                    least, shard = heapq.heappop(heap)
                shard_of[k] = shard
                least += table[k]["bytes"]
            heapq.heappush(heap, (least, shard))
        return shard_of, (max(heap)[0] - heap[0][0]) / mean

    shard_of, spread = place(False)
    if cut and spread > UNEQUAL:
        other, less = place(True)
        shard_of = other if less < spread else shard_of
    slots, slot_of = [0] * shards, [0] * n_ranges
    for k in sorted(table):
        slot_of[k] = slots[shard_of[k]]
        slots[shard_of[k]] += table[k]["rows"]
    return shard_of, slot_of


def shards(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sizes are near equal, to a fraction of a range (1/32 of
    a shard) unless single documents or groups of equal texts are larger than what is left to
    place. Rows with equal texts share a shard; only a group of more bytes than the mean
    shard is cut, and fills as few shards as it can. Null and empty text has size 16 and
    null texts are one group; a null id is an id; rows alike in id and text are told apart
    by a number, so that however many there are they can be split; whole texts of any length
    count; ``docs`` needs doc_id and text, and other columns, whatever their names, are not
    looked at; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = materialize(shard_keys(docs), "shard-keys")
    cuts, shard_of, slot_of = splitters(rows, n_shards, ranges_per_shard, range_rows)
    ranged = rows.withColumn("range", _range_of(cuts)(*KEY))
    order = Window.partitionBy("range").orderBy("major", "minor", "doc_id", "number")
    numbered = ranged.withColumn("place", F.row_number().over(order) - 1)
    return _placed(numbered, shard_of, slot_of).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(ranged: DataFrame, shard_of: list[int], slot_of: list[int]) -> DataFrame:
    """With the shard and the first slot of each row's range, looked up by position."""

    @F.pandas_udf("shard int, slot long")
    def place(r: pd.Series) -> pd.DataFrame:
        at = r.to_numpy(np.int64)
        return pd.DataFrame({"shard": np.array(shard_of, dtype=np.int32)[at], "slot": np.array(slot_of, dtype=np.int64)[at]})

    return ranged.withColumn("put", place("range")).select("*", "put.shard", "put.slot")


def assign_shards(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = RANGES, column: str = "shard") -> DataFrame:
    """``docs`` with its columns and the shard each row belongs to, as shards() has it; a column of that name is replaced."""
    ship(docs.sparkSession)
    rows = materialize(shard_keys(docs), "shard-keys")
    cuts, shard_of, _ = splitters(rows, n_shards, ranges_per_shard)
    at = _range_of(cuts)(*_key())

    @F.pandas_udf("int")
    def shard(r: pd.Series) -> pd.Series:
        return pd.Series(np.array(shard_of, dtype=np.int32)[r.to_numpy(np.int64)])

    return docs.withColumn(column, shard(at))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write ``docs`` as Parquet with one folder a shard."""
    assign_shards(docs, n_shards).repartition(n_shards, "shard").write.partitionBy("shard").parquet(path)
