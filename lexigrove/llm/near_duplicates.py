"""Near-duplicate documents by DartMinHash, banding and connected components.

A text is the multiset of its five-word shingles; a shingle's weight is how often it occurs.
Darts fall on (shingle, weight, time) with constant density, the same for every text. A text
catches the darts inside its weights, and keeps in each of ``BANDS * ROWS`` coordinates the
earliest; two texts agree in a coordinate with a chance equal to their weighted Jaccard
similarity. Texts that agree in all rows of a band meet; their similarity is then counted
exactly, and links of at least ``SIMILARITY`` join texts into classes.

In a band's bucket all texts are first compared with the bucket's hub only. Where that
leaves several classes in a bucket, an exact prefix filter finds the further pairs of
different classes that can be similar enough. So no link between texts that met is lost,
and no group of copies is ever paired out.

No row holds more than a slice of a text's shingles: long texts are compared slice by
slice, and the texts that meet one hub are dealt over many groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm.bytes_kernel import chunks, mix64, word_hashes
from lexigrove.llm.common import materialize, release, small_side, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands with a chance of (1 - 0.8^5)^30 = 7e-6.
BANDS, ROWS = 30, 5
#: Units of a text in one row, more or less; texts compared with a hub in one group; rows of a side that is broadcast.
SLICE, GROUP, BOUND = 4096, 128, 200_000
_CELL = 8.0  # expected darts in a cell of a region
_DOCS = 256  # texts in one call of the kernel
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _whole_texts(column: pa.Array):
    """(first row, rows, word hashes, row of each word) for runs of whole texts, some hundred at a time."""
    hashes, owners, done = [], [], 0

    def cut(upto: int):
        nonlocal hashes, owners, done
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        split = np.searchsorted(o, upto)
        hashes, owners = [h[split:]], [o[split:]]
        h, o = h[:split], o[:split]
        for first in range(done, upto, _DOCS):
            last = min(first + _DOCS, upto)
            a, b = np.searchsorted(o, [first, last])
            yield first, last - first, h[a:b], o[a:b] - first
        done = upto

    for chunk, starts, rows in chunks(column):
        h, at = word_hashes(chunk)
        hashes.append(h)
        owners.append(rows[np.searchsorted(starts, at, "right") - 1])
        yield from cut(int(rows[-1]))  # the last text may go on in the next chunk
    yield from cut(len(column))


def shingles(words: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, count) sorted by owner. A text of fewer words, but not none, is one shingle."""
    n = np.bincount(owner, minlength=texts)
    parts, owners = [], []
    if len(words) >= SHINGLE:
        rolled = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _GOLD + words[k : len(words) - SHINGLE + 1 + k]
        whole = owner[: len(rolled)] == owner[SHINGLE - 1 :]
        parts.append(mix64(rolled[whole]))
        owners.append(owner[: len(rolled)][whole])
    ends = np.cumsum(n)
    for t in np.flatnonzero((n > 0) & (n < SHINGLE)):
        value = np.array([n[t]], np.uint64)
        for w in words[ends[t] - n[t] : ends[t]]:
            value = value * _ODD + w
        parts.append(mix64(value))
        owners.append(np.array([t]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], s[at], np.diff(np.append(at, len(s)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _repeat(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each copy, number of the copy)."""
    index = np.repeat(np.arange(len(values)), times)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int = BANDS * ROWS) -> np.ndarray:
    """(sets, k) darts: of each coordinate the earliest dart that falls inside the set's weights.

    The weight axis of an element is cut at 1, 2, 4, ...; in each part darts come at a rate
    of its width, drawn in cells of equal area from hashes of element, part and cell. A set
    of total weight W throws about k ln k + 3 k darts, up to the time (k ln k + 3 k) / W,
    however many elements it has; the few sets with an empty coordinate go on to later times.
    """
    out = np.zeros((sets, k), np.uint64)
    weight = weight.astype(np.float64)
    todo = np.unique(owner)
    darts = k * np.log(k) + 3 * k
    while len(todo):
        mine = np.isin(owner, todo)
        o, e, x = owner[mine], element[mine], weight[mine]
        until = darts / np.maximum(np.bincount(o, weights=x, minlength=sets), 1e-300)
        parts = 1 + np.ceil(np.log2(np.maximum(x, 1.0))).astype(np.int64)
        at, part = _repeat(x, parts)
        o, e, x = o[at], e[at], x[at]
        low = np.where(part == 0, 0.0, 2.0 ** (part - 1))
        width = np.where(part == 0, 1.0, low)
        cells = np.maximum(1, np.ceil(until[o] * width / _CELL)).astype(np.int64)
        at, cell = _repeat(o, cells)
        o, x, low, width = o[at], x[at], low[at], width[at]
        seed = mix64(e[at] + _GOLD * (part[at].astype(np.uint64) + np.uint64(1)) + _ODD * cell.astype(np.uint64))
        r = cell * _CELL / width
        stop = np.minimum(until[o], (cell + 1) * _CELL / width)
        best = np.full(sets * k, np.inf)
        flat = out.reshape(-1)
        while len(o):
            seed = seed + _GOLD
            key = mix64(seed)
            r = r - np.log(_uniform(key)) / width
            on = r < stop
            o, x, low, width, seed, r, stop, key = o[on], x[on], low[on], width[on], seed[on], r[on], stop[on], key[on]
            second = mix64(key ^ _ODD)
            caught = low + width * _uniform(second) < x
            place = o[caught] * k + (mix64(second + _ODD)[caught] % np.uint64(k)).astype(np.int64)
            when = r[caught]
            np.minimum.at(best, place, when)
            won = when == best[place]
            flat[place[won]] = key[caught][won]
        empty = np.isinf(best.reshape(sets, k)).any(axis=1)
        todo = todo[empty[todo]]
        darts *= 2.0
    return out


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mix64(keys * _GOLD + signatures[:, row::ROWS])
    return mix64(keys + np.arange(BANDS, dtype=np.uint64))


def _sign(batches):
    """(doc_id, key, text) -> (doc_id, key, weight, bands); no bands for texts without words."""
    for batch in batches:
        for first, count, words, owner in _whole_texts(batch.column(2)):
            o, s, n = shingles(words, owner, count)
            weight = np.bincount(o, weights=n, minlength=count).astype(np.int64)
            keys = _band_keys(dart_signatures(o, s, n, count)).view(np.int64)
            some = weight > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), batch.column(1).slice(first, count), pa.array(weight), bands], names=["doc_id", "key", "weight", "bands"])


def _level(weight: np.ndarray, slice_units: int) -> np.ndarray:
    """A text of this weight is cut into 2 ** level slices by the leading bits of its units."""
    return np.frexp(np.maximum(-(-weight // slice_units) - 1, 0))[1].astype(np.int64)


def _level_of(weight: Column, slice_units: int) -> Column:
    pieces = F.ceil(weight / F.lit(slice_units))
    return F.when(pieces > 1, F.length(F.bin(pieces - 1))).otherwise(0).cast("int")


def _units(similarity: float, slice_units: int = SLICE):
    """mapInArrow: (key, text) -> (key, level, part, own, units), sorted 64-bit units: one for each occurrence of each shingle, the same in every text.

    Two texts are compared at the level of the larger one, so a text is also cut at the
    levels of the texts that it may be similar to; ``own`` marks its own level.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for first, count, words, owner in _whole_texts(batch.column(1)):
                o, s, n = shingles(words, owner, count)
                at, occurrence = _repeat(s, n)
                unit, of = mix64(s[at] + _ODD * occurrence.astype(np.uint64)), o[at]
                weight = np.bincount(of, minlength=count)
                level, last = _level(weight, slice_units), _level(np.ceil(weight / similarity).astype(np.int64) + 1, slice_units)
                up = 0
                while (mine := (level + up <= last)[of] if up else np.ones(len(of), bool)).any():
                    x, z = of[mine], unit[mine]
                    bits = (level[x] + up).astype(np.uint64)
                    y = np.where(bits > 0, z >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0)).astype(np.int64)
                    z = z.view(np.int64)
                    order = np.lexsort((z, y, x))
                    x, y, z = x[order], y[order], z[order]
                    starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), pa.array(z))
                    row = x[starts]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(first + row)), pa.array((level[row] + up).astype(np.int32)), pa.array(y[starts].astype(np.int32)), pa.array(np.full(len(row), up == 0)), lists], names=["key", "level", "part", "own", "units"])
                    up += 1

    return run


def text_key(text: Column) -> Column:
    """16 bytes that equal texts share; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _common(batches):
    """Rows (a, level, part, deal, b, weight_a, weight_b, units), sorted so that the units of a (b is null) come before those it is compared with."""
    hub, hub_units, last = None, None, None
    for batch in batches:
        group = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
        others, units = batch.column(4).to_pylist(), batch.column(7)
        flat, offsets = units.values.to_numpy(zero_copy_only=False), units.offsets.to_numpy()
        kept, common = [], []
        for i, (which, b) in enumerate(zip(group, others)):
            mine = flat[offsets[i] : offsets[i + 1]]
            if b is None:
                hub, hub_units, last = which, mine.copy(), None
            elif which == hub and b != last:
                place = np.searchsorted(hub_units, mine)
                kept.append(i)
                common.append(int((hub_units[np.minimum(place, len(hub_units) - 1)] == mine).sum()))
                last = b
        if kept:
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 4, 5, 6)] + [pa.array(common, pa.int64())], names=["a", "b", "weight_a", "weight_b", "common"])


def _linked(pairs: DataFrame, units: DataFrame, similarity: float, slice_units: int = SLICE, group_size: int = GROUP) -> DataFrame:
    """Those of the materialized (a, b, weight_a, weight_b) whose weighted Jaccard similarity, counted exactly, is at least ``similarity``.

    The pairs of one ``a`` are dealt into groups of about ``group_size``, each with a copy of a's
    units; a task reads its groups as a stream and holds one slice of units at a time.
    """
    n = pairs.count()
    level = _level_of(F.greatest("weight_a", "weight_b"), slice_units)
    busy = materialize(pairs.groupBy("a").count().filter(F.col("count") > group_size).select(F.col("a").alias("busy"), F.ceil(F.col("count") / group_size).cast("int").alias("deals")), "busy")
    dealt = pairs.join(small_side(busy, busy.count(), BOUND), F.col("a") == F.col("busy"), "left")
    dealt = materialize(dealt.select("a", "b", "weight_a", "weight_b", level.alias("level"), F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal")), "dealt")
    asked = units.join(small_side(dealt.withColumnRenamed("level", "at"), n, BOUND), (F.col("key") == F.col("b")) & (F.col("level") == F.col("at")))
    hubs = materialize(dealt.select("a", "level", "deal").distinct(), "hubs")
    own = units.join(small_side(hubs.withColumnRenamed("level", "at"), hubs.count(), BOUND), (F.col("key") == F.col("a")) & (F.col("level") == F.col("at")))
    none = F.lit(None).cast("long")
    rows = own.select("a", "level", "part", "deal", F.lit(None).cast("binary").alias("b"), none.alias("weight_a"), none.alias("weight_b"), "units")
    rows = rows.union(asked.select("a", "level", "part", "deal", "b", "weight_a", "weight_b", "units"))
    group = ["a", "level", "part", "deal"]
    met = rows.repartition(*group).sortWithinPartitions(*group, F.col("b").asc_nulls_first())
    common = met.mapInArrow(_common, "a binary, b binary, weight_a long, weight_b long, common long")
    summed = common.groupBy("a", "b", "weight_a", "weight_b").agg(F.sum("common").alias("common"))
    return summed.filter(F.col("common") >= similarity * (F.col("weight_a") + F.col("weight_b") - F.col("common")) - 1e-9).select("a", "b")


#: A label with so many texts is not compared with itself even by way of a shared shingle.
_LARGE = 64


def _across(rest: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b, weight_a, weight_b) of texts with different labels: no pair of at least ``similarity`` is missing.

    Prefix filtering: if every text lists its units from the rarest on, two texts of n <= m
    units that similar share one among the first n - ceil(2 s / (1 + s) n) + 1 of the shorter
    and the first m - ceil(s m) + 1 of the longer. What a copy has of its own comes
    first, so copies that differ too much from their group do not meet it at all. A pair
    passes only if what follows the shared unit can still make up the similarity.
    """
    chosen = units.filter("own").join(small_side(rest.select(F.col("key").alias("wanted"), "label", F.col("weight").alias("size")), rest.count(), BOUND), F.col("key") == F.col("wanted"))
    rows = materialize(chosen.select("key", "label", "size", F.explode("units").alias("unit")), "rest-units")
    common = materialize(rows.groupBy("unit").agg(F.count("*").alias("df")).filter("df > 1"), "common-units")
    each = rows.join(small_side(common, common.count(), BOUND), "unit")
    # places are counted from the end, so that a text's list need not be gathered, and what is its own need not be looked at
    behind = F.row_number().over(Window.partitionBy("key").orderBy(F.col("df").desc(), F.col("unit").desc()))
    placed = each.select("key", "label", "size", "unit", (F.col("size") - behind).alias("place"))
    placed = placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9))
    large = materialize(rest.groupBy("label").count().filter(F.col("count") >= _LARGE).select(F.col("label").alias("large_label")), "large")
    placed = placed.join(small_side(large, large.count(), BOUND), F.col("label") == F.col("large_label"), "left")
    placed = materialize(placed.select("key", "label", "size", "place", "unit", F.col("large_label").isNotNull().alias("large")), "prefixes")
    both = 2 * similarity / (1 + similarity)
    short = placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * both - 1e-9))
    left = lambda df: df.select("unit", F.col("key").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    right = lambda df: df.select("unit", F.col("key").alias("b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    need = F.ceil((F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-9)
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") != F.col("b")))
    ok = ordered & (F.col("label_a") != F.col("label_b")) & (F.col("size_a") >= similarity * F.col("size_b") - 1e-9)
    ok = ok & (F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= need)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = left(a).join(right(b), "unit").filter(ok)
        first = F.col("a") < F.col("b")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pick("size_a", "size_b").alias("weight_a"), pick("size_b", "size_a").alias("weight_b"))

    # texts of one large label meet nobody of their own: only units that hold two large labels join large with large
    several = placed.filter("large").groupBy("unit").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("unit")
    several = materialize(several, "several")
    apart = small_side(several, several.count(), BOUND)
    pairs = met(short.filter("not large"), placed).union(met(short.filter("large"), placed.filter("not large")))
    pairs = pairs.union(met(short.filter("large").join(apart, "unit", "left_semi"), placed.filter("large")))
    return materialize(pairs.distinct(), "pairs")


def components(links: DataFrame, label: str = "components") -> tuple[DataFrame, int]:
    """((node, label), number of nodes) for links (a, b): the smallest node of each component is its label.

    In each round every node points at the smallest of itself and its neighbours, the
    pointers are followed until they end (the distance doubles each time), and the links are
    drawn again between the ends. A round leaves at most half of the nodes that still have
    links, so the rounds end; tables stay distributed, and every round's are written.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), label)
    labels, n_labels = None, 0
    while edges.limit(1).count():
        start = written()
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), label)
        n, moved = up.count(), True
        while moved:
            far = lambda name: small_side(up.select(F.col("node").alias(f"{name}_at"), F.col("root").alias(name)), n, BOUND)  # noqa: B023, E731
            jumped = up.join(far("second"), F.col("root") == F.col("second_at")).join(far("third"), F.col("second") == F.col("third_at"))
            up = materialize(jumped.select("node", F.col("third").alias("root"), (F.col("third") != F.col("root")).alias("moved")), label)
            moved = bool(up.filter("moved").limit(1).count())
            up = up.select("node", "root")
        end = lambda name: small_side(up.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}")), n, BOUND)  # noqa: B023, E731
        drawn = edges.join(end("a"), "a").join(end("b"), "b")
        edges = materialize(drawn.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).filter("a <> b").distinct(), label)
        if labels is None:
            labels, n_labels = up.select("node", F.col("root").alias("label")), n
        else:
            ends = small_side(up.select(F.col("node").alias("old"), "root"), n, BOUND)
            labels = labels.join(ends, F.col("label") == F.col("old"), "left").select(labels["node"], F.coalesce("root", "label").alias("label"))
        labels = materialize(labels, label)
        release(start, (labels, edges))
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels, n_labels


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (doc_id, key, label) of every row, and (label, class_id, members) of each label with several rows."""
    ship(docs.sparkSession)
    start = written()
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    signed = materialize(own.mapInArrow(_sign, f"doc_id {kind}, key binary, weight long, bands array<long>"), "signatures")
    opened = signed.filter("weight > 0").select("key", "weight", F.explode("bands").alias("band"))
    held = materialize(opened.groupBy("band", "key").agg(F.min("weight").alias("weight")), "bands")
    buckets = materialize(held.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = materialize(held.join(small_side(buckets, buckets.count(), BOUND), "band"), "shared-bands")
    # a bucket's hub is its text that meets most others anywhere: the original rather than one of its copies
    degrees = materialize(shared.groupBy("key").agg(F.sum("n").alias("degree")), "degrees")
    n_shared = degrees.count()
    ranked = shared.join(small_side(degrees, n_shared, BOUND), "key")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", "key", "weight")).alias("hub"))
    hubs = materialize(hubs.select("band", F.col("hub.key").alias("hub"), F.col("hub.weight").alias("hub_weight")), "hubs")
    met = materialize(shared.join(small_side(hubs, hubs.count(), BOUND), "band"), "met")
    alike = F.least("weight", "hub_weight") >= similarity * F.greatest("weight", "hub_weight") - 1e-9  # sizes alone rule a pair out
    pairs = met.filter((F.col("key") != F.col("hub")) & alike).select(F.col("hub").alias("a"), F.col("key").alias("b"), F.col("hub_weight").alias("weight_a"), F.col("weight").alias("weight_b"))
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = degrees.select(F.col("key").alias("wanted"))
    chosen = own.join(small_side(wanted, n_shared, BOUND), own["key"] == F.col("wanted"), "left_semi").select("key", "text")
    units = chosen.mapInArrow(_units(similarity), "key binary, level int, part int, own boolean, units array<long>")
    units = materialize(units.groupBy("key", "level", "part").agg(F.first("own").alias("own"), F.first("units").alias("units")), "units")
    links = materialize(_linked(pairs, units, similarity), "links")
    labels, n = components(links)
    marked = met.filter("n > 2").join(small_side(labels, n, BOUND), F.col("key") == F.col("node"), "left")
    marked = materialize(marked.select("band", "key", "weight", F.coalesce("label", "key").alias("label")), "marked")
    mixed = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    mixed = materialize(mixed, "mixed")
    if n_mixed := mixed.count():
        rest = marked.join(small_side(mixed, n_mixed, BOUND), "band", "left_semi").groupBy("key").agg(F.min("label").alias("label"), F.min("weight").alias("weight"))
        more = _across(materialize(rest, "rest"), units, similarity)
        if more.limit(1).count():
            found = materialize(_linked(more, units, similarity), "links")
            if found.limit(1).count():
                labels, n = components(links.union(found))
    rows = signed.select("doc_id", "key").join(small_side(labels, n, BOUND), F.col("key") == F.col("node"), "left")
    rows = materialize(rows.select("doc_id", "key", F.coalesce("label", "key").alias("label")), "rows")
    groups = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("class_key"), F.count("*").alias("members")).filter("members > 1")
    groups = materialize(groups, "classes")
    release(start, (rows, groups))
    return rows, groups


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), members, kept.

    Texts are one class if links of weighted Jaccard similarity ``similarity`` or more between
    their five-word shingles join them, or if they are equal, words or not. A null text is a
    class of its own. Repeated rows are members of one class; only the row of the smallest
    doc_id is kept (rows alike in id and text count as one document); ids that are all null
    give a null class_id. Texts of fewer than five words are one shingle; texts without words
    are alike only if equal. ``docs`` needs doc_id and text; other columns, whatever their
    names, are not looked at; whole texts of any length count; no rows give no rows.
    """
    rows, groups = near_duplicate_classes(docs, similarity)
    g = small_side(groups.withColumnRenamed("label", "group"), groups.count(), BOUND)
    joined = rows.join(g, F.col("label") == F.col("group"), "left")
    single = F.col("group").isNull()
    kept = single | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    return joined.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("members", F.lit(1).cast("long")).alias("members"), kept.alias("kept"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; columns as they are, whatever their names.

    Null texts all stay; of rows alike in id and text one stays; no rows give no rows.
    """
    rows, groups = near_duplicate_classes(docs, similarity)
    g = small_side(groups.select(F.col("label").alias("group"), "class_id", "class_key"), groups.count(), BOUND)
    joined = rows.join(g, F.col("label") == F.col("group"), "inner")
    dropped = joined.filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))))
    dropped = materialize(dropped.select(F.col("doc_id").alias("dropped_id"), F.col("key").alias("dropped_key")).distinct(), "dropped")
    out = small_side(dropped, dropped.count(), BOUND)
    key = text_key(docs["text"])
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["dropped_id"]) & (key == out["dropped_key"]), "left_anti")
    same = materialize(rows.filter(F.col("key").isNotNull()).groupBy("doc_id", "key").count().filter("count > 1").select(F.col("doc_id").alias("same_id"), F.col("key").alias("same_key")), "same")
    n_same = same.count()
    if not n_same:
        return kept
    once = small_side(same, n_same, BOUND)
    alike = kept["doc_id"].eqNullSafe(once["same_id"]) & (text_key(kept["text"]) == once["same_key"])
    whole = F.struct(*[kept[f"`{c}`"] for c in kept.columns])
    repeated = kept.join(once, alike).groupBy("same_id", "same_key").agg(F.first(whole).alias("row")).select("row.*")
    return kept.join(once, alike, "left_anti").unionByName(repeated)
