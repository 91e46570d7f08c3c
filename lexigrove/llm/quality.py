"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, ``PASSAGE`` bytes each, and only the bag has a label. A
passage is encoded by its words and pairs of neighbouring words, hashed with signs into
``HASHED`` places each, by the shares of byte classes and of their neighbouring pairs, and of
repeated and long words; one dense layer embeds it. Gated attention,
``w . (tanh(V h) * sigmoid(U h))`` with a softmax over the document's passages, weighs the
passages, and the weighted mean of their embeddings gives the score. All weights are
learned from the document labels, by Adam on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm.bytes_kernel import chunks, mix64, word_hashes
from lexigrove.llm.common import fold

PASSAGE = 600
#: Labelled documents in the sample, on the average of a draw by hash. All passages of each are learned from.
TRAIN_DOCS = 6000
HASHED = 128
EMBED, GATE, EPOCHS, SEED = 32, 16, 40, 7
THRESHOLD = 0.3

#: Byte classes: 0 other control, 1 space, 2 line end, 3 digit, 4 upper, 5 lower, 6 beyond ASCII,
#: 7 full stop and comma, 8 other sentence marks, 9 brackets, 10 | and slashes, 11 * # % & $ @ and the rest.
BYTE_CLASS = np.full(256, 11, dtype=np.int64)
BYTE_CLASS[:32] = 0
BYTE_CLASS[[9, 32]] = 1
BYTE_CLASS[[10, 13]] = 2
BYTE_CLASS[48:58] = 3
BYTE_CLASS[65:91] = 4
BYTE_CLASS[97:123] = 5
BYTE_CLASS[128:] = 6
BYTE_CLASS[[44, 46]] = 7
BYTE_CLASS[[33, 39, 34, 45, 58, 59, 63]] = 8
BYTE_CLASS[[40, 41, 60, 62, 91, 93, 123, 125]] = 9
BYTE_CLASS[[47, 92, 124]] = 10
CLASSES = 12
FEATURES = CLASSES + CLASSES * CLASSES + 6 + 2 * HASHED


def passages(column: pa.Array):
    """(row of each passage, passages x FEATURES) for some texts at a time; a text without bytes is one passage of zeros."""
    whole = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.float64)
    for chunk, starts, rows in chunks(column):
        raw = BYTE_CLASS[np.frombuffer(chunk, dtype=np.uint8)]
        ends = np.append(starts[1:], len(chunk)) - 1
        length = ends - starts
        count = np.maximum(1, -(-length // PASSAGE))
        first = np.cumsum(count) - count
        piece = np.repeat(np.arange(len(rows)), length + 1)
        inside = np.arange(len(chunk)) - starts[piece]
        passage = first[piece] + np.minimum(inside // PASSAGE, count[piece] - 1)
        total = int(count.sum())
        real = inside < length[piece]
        one = np.bincount((passage * CLASSES + raw)[real], minlength=total * CLASSES).reshape(total, CLASSES)
        pair_ok = real[1:] & real[:-1] & (passage[1:] == passage[:-1])
        two = np.bincount((passage[1:] * CLASSES * CLASSES + raw[:-1] * CLASSES + raw[1:])[pair_ok], minlength=total * CLASSES * CLASSES).reshape(total, -1)
        size = np.maximum(one.sum(axis=1, keepdims=True), 1)
        words, at = word_hashes(chunk)
        of = passage[at]
        n = np.bincount(of, minlength=total)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((words, of))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order][new], minlength=total)
        some = np.maximum(n, 1)
        letters = one[:, [4, 5, 6]].sum(axis=1)
        extra = np.stack([np.bincount(of[again], minlength=total) / some, distinct / some, np.minimum(letters / some, 30.0) / 10.0, np.log1p(n) / 5.0, np.log1p(whole[np.repeat(rows, count)]) / 10.0, (n == 0).astype(float)], axis=1)
        root = np.sqrt(some)[:, None]
        pairs = mix64(words[:-1] * _PAIR + words[1:])
        joined = of[1:] == of[:-1]
        hashed = [_hashed(words, of, total) / root, _hashed(pairs[joined], of[1:][joined], total) / root]
        yield rows[np.repeat(np.arange(len(rows)), count)], np.concatenate([one / size, two / size * 2.0, extra, *hashed], axis=1).astype(np.float32)


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _hashed(hashes: np.ndarray, of: np.ndarray, total: int) -> np.ndarray:
    """(passages x HASHED) sums of signs; place and sign come from the hash."""
    place = (hashes >> np.uint64(32)) % np.uint64(HASHED)
    sign = np.where((hashes >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    return np.bincount(of * HASHED + place.astype(np.int64), weights=sign, minlength=total * HASHED).reshape(total, HASHED)


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, attention before the softmax) of passages."""
        w = self.w
        h = np.tanh(((x - self.mean) / self.scale) @ w["E"] + w["e"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]

    def score(self, weighted: np.ndarray) -> np.ndarray:
        return _sigmoid(weighted @ self.w["c"] + self.w["b"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(bag: np.ndarray, x: np.ndarray, label: np.ndarray) -> AttentionModel:
    """Train on passages ``x`` of bags ``bag`` (0, 1, ..., sorted) with a label each."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-2
    w = {
        "E": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, EMBED)), "e": np.zeros(EMBED), "V": rng.normal(0, 0.2, (EMBED, GATE)), "U": rng.normal(0, 0.2, (EMBED, GATE)),
        "a": rng.normal(0, 0.2, GATE), "c": np.zeros(EMBED), "b": np.zeros(1),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    starts = np.searchsorted(bag, np.arange(len(label) + 1))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            bags = np.sort(order[at : at + 64])
            rows = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in bags])
            owner = np.repeat(np.arange(len(bags)), starts[bags + 1] - starts[bags])
            first = np.searchsorted(owner, np.arange(len(bags)))
            zi, y = (x[rows] - mean) / scale, label[bags]
            h = np.tanh(zi @ w["E"] + w["e"])
            t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
            s = (t * g) @ w["a"]
            s = np.exp(s - np.maximum.reduceat(s, first)[owner])
            alpha = s / np.add.reduceat(s, first)[owner]
            m = np.add.reduceat(alpha[:, None] * h, first, axis=0)
            d = (_sigmoid(m @ w["c"] + w["b"]) - y) / len(bags)
            dm = d[:, None] * w["c"]
            dalpha = (dm[owner] * h).sum(axis=1)
            ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[owner])
            dt, dg = ds[:, None] * w["a"] * g * (1 - t**2), ds[:, None] * w["a"] * t * g * (1 - g)
            dh = (alpha[:, None] * dm[owner] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
            grad = {"E": zi.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": ((t * g) * ds[:, None]).sum(0), "c": m.T @ d, "b": np.array([d.sum()])}
            step += 1
            rate = 0.01 * (0.5 if epoch > EPOCHS // 2 else 1.0) * (0.3 if epoch > 3 * EPOCHS // 4 else 1.0)
            for k, v in grad.items():
                v = v + 1e-4 * w[k]
                m1, m2 = moment[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                w[k] = w[k] - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(mean.astype(np.float32), scale.astype(np.float32), {k: v.astype(np.float32) for k, v in w.items()})


def train(docs: DataFrame, labels: DataFrame, eligible: Column, train_docs: int = TRAIN_DOCS) -> AttentionModel | None:
    """Learn from ``docs`` (doc_id, text) that are ``eligible`` and that ``labels`` (doc_id, quality) knows; None if there are none.

    The passages of about ``train_docs`` labelled rows at most, drawn by a hash of the id,
    reach the driver, as half-precision numbers. An id with several labels has the larger
    one; labels other than 0 and 1 do not count; rows alike in id and passages are one.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    if not n:
        return None
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("quality"), "labelled"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, train_docs / n))))
    some = docs.select("doc_id", "text").filter(eligible).join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "quality")

    def features(batches):
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            rows, parts = zip(*passages(batch.column(1)))
            row, x = np.concatenate(rows), np.concatenate(parts).astype(np.float16)
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())], names=["doc_id", "quality", "x"])

    got = some.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "x"], kind="stable").drop_duplicates()  # the same order whatever the partitions
    sizes, label = [len(b) // (2 * FEATURES) for b in got["x"]], got["quality"].to_numpy(np.float64)
    x = np.frombuffer(b"".join(got.pop("x")), np.float16).reshape(-1, FEATURES)
    return fit(np.repeat(np.arange(len(sizes)), sizes), x, label)


def _pieces(batch: pa.RecordBatch, rows: int = 256):
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def score_texts(model: AttentionModel | None, column: pa.Array) -> np.ndarray:
    """Scores of whole texts, passage by passage with a running softmax; 0.5 if nothing was learned."""
    if model is None:
        return np.full(len(column), 0.5)
    top = np.full(len(column), -np.inf, np.float64)
    mass, total = np.zeros(len(column)), np.zeros((len(column), EMBED))
    for row, x in passages(column):
        h, s = model.embed(x)
        s = s.astype(np.float64)
        high = top.copy()
        np.maximum.at(high, row, s)
        old = np.zeros(len(column))  # what the earlier passages' sums are worth now
        seen = np.isfinite(top)
        old[seen] = np.exp(top[seen] - high[seen])
        e = np.exp(s - high[row])
        mass *= old
        total *= old[:, None]
        np.add.at(mass, row, e)
        np.add.at(total, row, e[:, None] * h)
        top = high
    return model.score(total / np.maximum(mass, 1e-300)[:, None]).astype(np.float64)


def score(docs: DataFrame, model: AttentionModel | None, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text as its last column; null and empty texts have one, too."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([score_texts(held.value, texts.slice(at, 1024)) for at in range(0, max(len(texts), 1), 1024)]))

    return docs.withColumn(column, scored(F.col("text")))


def quality_report(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Other columns, whatever their names, are not looked at. Null texts score as empty ones,
    null ids are ids without a label; repeated rows score alike; without labelled rows the
    score is 0.5; whole texts of any length count; an empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    out = score(own, train(own, labels, fold(F.col("doc_id"), folds) != held_out))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns, whatever their names.

    Null texts are scored as empty ones; repeated rows are kept or rejected alike; without
    labelled rows all are kept; whole texts of any length count; no rows give no rows.
    """
    model = train(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), folds) != held_out)
    mark = "quality_score"
    while mark in map(str.lower, docs.columns):
        mark += "_"
    return score(docs, model, mark).filter(F.col(mark) >= THRESHOLD).drop(mark)
