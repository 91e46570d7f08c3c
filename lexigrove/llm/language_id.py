"""Language identification by interpolated Kneser-Ney character models.

A bounded sample of labelled rows trains one model a language; a second one, disjoint from
it, calibrates the confidence and the rejection. Every whole text is then scored under all
languages; the lowest cross-entropy by character names the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm import char_lm
from lexigrove.llm.bytes_kernel import chunks
from lexigrove.llm.common import fold

#: Rows of a language that train its model, and that calibrate, on the average. The draw is by a hash of the id and the text.
#: A language of no more than TRAIN_ROWS rows trains with all of them, and only what is left over calibrates.
TRAIN_ROWS, CALIBRATION_ROWS = 600, 300
UNDETERMINED = "und"
#: Accepted share of right calibration texts: what is worse than these is rejected.
ACCEPTED = 0.995

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = char_lm.letters_table()
    return _tables["letters"]


@dataclass
class Identifier:
    """The models, the slope of the confidence, and per language the highest accepted cross-entropy."""

    model: char_lm.KneserNey
    slope: float
    ceiling: np.ndarray
    least_score: float


def _gram_counts(batches):
    """(name, gram, n) of the letters' grams of (name, text) batches, summed within a batch."""
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for chunk, starts, rows in chunks(batch.column(1)):
            s, index = char_lm.symbols(chunk, starts, _letters())
            keys = char_lm.gram_keys(s)
            piece = np.searchsorted(index, np.arange(len(s)), "right") - 1
            for name in set(names[rows]):
                mine = (names[rows] == name)[piece] if len(s) else np.zeros(0, bool)
                different, n = np.unique(keys[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(different), pa.string()), pa.array(different.view(np.int64)), pa.array(n, pa.int64())], names=["name", "gram", "n"])


def losses(model: char_lm.KneserNey, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(summed negative log-probabilities, texts x languages; symbols scored, 0 where there is no letter)."""
    total, n = np.zeros((len(texts), len(model.names))), np.zeros(len(texts), dtype=np.int64)
    for chunk, starts, rows in chunks(texts):
        s, index = char_lm.symbols(chunk, starts, _letters())
        upto = np.concatenate([np.zeros((1, len(model.names))), np.cumsum(model.log_prob(char_lm.gram_keys(s)), axis=0, dtype=np.float64)])
        ends = np.append(index[1:], len(s))
        np.add.at(total, rows, upto[index] - upto[ends])
        np.add.at(n, rows, ends - index)
    return total, n


def _margin(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its cross-entropy, evidence: lead over the second in nats times the root of the length)."""
    ce = total / np.maximum(n, 1)[:, None]
    best = ce.argmin(axis=1)
    least = ce[np.arange(len(ce)), best]
    second = np.partition(ce, 1, axis=1)[:, 1] if ce.shape[1] > 1 else least + 1.0
    return best, least, (second - least) * np.sqrt(np.maximum(n, 1))


def _confidence(slope: float, evidence: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.minimum(slope * evidence, 40.0)))


def _fit_slope(evidence: np.ndarray, right: np.ndarray) -> float:
    """Slope of P(right) = sigmoid(slope * evidence), with a weak pull to 1, by Newton's method."""
    slope = 1.0
    for _ in range(50):
        p = _confidence(slope, evidence)
        gradient = ((right - p) * evidence).sum() - 0.1 * (slope - 1.0)
        curvature = (p * (1 - p) * evidence**2).sum() + 0.1
        slope = float(np.clip(slope + gradient / curvature, 0.05, 20.0))
    return slope


def train(docs: DataFrame, eligible: Column, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Identifier | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are ``eligible`` and have text and lang; None if there are none.

    What reaches the driver: one row a language, the different grams of the sample, and one
    row for each calibration text. All are bounded by the two sample sizes.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not found:
        return None
    per_language = lambda value: F.create_map(*[F.lit(x) for r in found for x in (r["lang"], value(r))])[F.col("lang")]
    # all rows of a language that has no more than train_rows; of others at least the rows with the lowest draw
    share = per_language(lambda r: max(min(1.0, train_rows / r["n"]), r["least"] + 2.0**-41))
    both = per_language(lambda r: min(1.0, (train_rows + calibration_rows) / r["n"]))
    trained = rows.filter(draw < share)
    counted = trained.select("lang", "text").mapInArrow(_gram_counts, "name string, gram long, n long").groupBy("name", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    keys, which = np.unique(counted["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    names = sorted(set(counted["name"]))
    counts = np.zeros((len(keys), len(names)))
    np.add.at(counts, (which, np.searchsorted(np.array(names, dtype=object), counted["name"].to_numpy())), counted["n"].to_numpy(np.float64))
    model = char_lm.build(names, keys, counts)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            total, n = losses(held.value, batch.column(1))
            best, least, evidence = _margin(total, n)
            right = [model_name == name for model_name, name in zip(np.array(held.value.names, dtype=object)[best], batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"best": best, "least": least, "evidence": evidence, "right": right, "n": n}), preserve_index=False)

    calibrating = rows.filter((draw >= share) & (draw < both))
    seen = calibrating.select("lang", "text").mapInArrow(measure, "best long, least double, evidence double, right boolean, n long").toPandas()
    seen = seen[seen["n"] > 0]
    if not len(seen):
        return Identifier(model, 1.0, np.full(len(names), np.inf), 0.5)
    slope = _fit_slope(seen["evidence"].to_numpy(), seen["right"].to_numpy(float))
    good = seen[seen["right"]]
    ceiling = np.array([good.loc[good["best"] == k, "least"].quantile(ACCEPTED) if (good["best"] == k).any() else np.inf for k in range(len(names))])
    score = _confidence(slope, good["evidence"].to_numpy())
    return Identifier(model, slope, ceiling, float(np.quantile(score, 1 - ACCEPTED)) if len(score) else 0.5)


def identify(docs: DataFrame, identifier: Identifier | None, carry: list[str]) -> DataFrame:
    """(carry..., lang_pred, score, rejected) of each row's whole text.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learned).
    ``rejected``: the cross-entropy is above what right calibration texts of that language
    have, or the lead over the next language is too small; the caller may then drop the
    prediction. Repeated rows are scored each; columns other than text are handed on.
    """
    ship(docs.sparkSession)
    columns = docs.select(*carry, F.col("text"))
    held = docs.sparkSession.sparkContext.broadcast(identifier)
    schema = ", ".join([f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in carry] + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches):
        known = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if known is None:
                    names, score, rejected = np.full(part.num_rows, UNDETERMINED, dtype=object), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                else:
                    total, n = losses(known.model, part.column(len(carry)))
                    best, least, evidence = _margin(total, n)
                    score = _confidence(known.slope, evidence)
                    rejected = (n == 0) | (least > known.ceiling[best]) | (score < known.least_score)
                    names = np.array(known.model.names, dtype=object)[best]
                    names[n == 0] = UNDETERMINED
                    score[n == 0] = 0.0
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(carry))] + [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=carry + ["lang_pred", "score", "rejected"])

    return columns.mapInArrow(run, schema)


def language_report(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs`` (doc_id, text, lang).

    Other columns, whatever their names, are not looked at. A null id is an id whose text is
    empty; a null language is not learned from. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text where nothing could be learned. Repeated rows
    are predicted alike, a tie goes to the first language in code-point order; whole texts of
    any length count; no rows give no rows.
    """
    own = docs.select("doc_id", "text", "lang")
    out = identify(own, train(own, fold(F.col("doc_id"), folds) != held_out), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
