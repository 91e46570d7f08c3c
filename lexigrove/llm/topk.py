"""Exact top-k search by aggregation over sorted lists without random access.

The candidates are cut into blocks. In a block every dimension has a sorted list of its
components; a query reads it from the end that suits the sign of its own component. The
lists are read in parallel, stretch by stretch. After each stretch a candidate's score lies
between what was read and, for each list that it was not met in, the list's last
value (below) and the value at which reading stands (above). Reading stops for a query once
few candidates can still be among the best k, and their final scores are resolved. The
bounds of all queries of a block are sums of products, so NumPy takes them as matrix
products; a block's k + 1 best meet the other blocks' in one aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.llm.common import materialize

#: Different vectors in a block of candidates; queries that meet it in one task, and that are bounded together. A block
#: of candidates is sent once for each QUERY_BLOCK queries.
BLOCK, QUERY_BLOCK, TOGETHER = 8192, 32768, 512
#: Shares of the lists that have been read after each stretch.
STRETCHES = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0)


def nra_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, resolve: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row of integers): positions and scores of the k best vectors, ties to the smaller id.

    ``resolve``: reading stops once at most so many candidates, k at least, can still be among the best.
    """
    n, dims = vectors.shape
    k = min(k, n)
    x, q_all = vectors.astype(np.float64), queries.astype(np.float64)
    best: list = [None] * len(queries)
    if dims == 0 or n == 0:
        return [(np.argsort(ids, kind="stable")[:k], np.zeros(k, np.int64)) for _ in best]
    order = np.argsort(x, axis=0, kind="stable")  # the sorted lists: one column a dimension
    listed = np.take_along_axis(x, order, axis=0)
    rank = np.empty((n, dims), np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    least, most = listed[0], listed[-1]
    active = np.arange(len(queries))
    for share in STRETCHES:
        if not len(active):
            break
        read = n if share >= 1 else max(k, int(n * share))
        up, down = np.maximum(q_all[active], 0), np.minimum(q_all[active], 0)
        met_down = rank < read  # met when reading from the small end
        met_up = rank >= n - read
        known = np.where(met_up, x, 0.0) @ up.T + np.where(met_down, x, 0.0) @ down.T
        if read < n:
            stands_up, stands_down = listed[n - read], listed[read - 1]
            unmet_up, unmet_down = (~met_up).astype(np.float64), (~met_down).astype(np.float64)
            upper = known + unmet_up @ (up * stands_up).T + unmet_down @ (down * stands_down).T
            lower = known + unmet_up @ (up * least).T + unmet_down @ (down * most).T
        else:
            upper = lower = known
        floor = np.partition(lower, n - k, axis=0)[n - k]
        may = upper >= floor
        count = may.sum(axis=0)
        done = (count <= max(resolve, k)) | (read == n)
        for j in np.flatnonzero(done):
            at = np.flatnonzero(may[:, j])
            score = vectors[at] @ queries[active[j]] if read < n else known[at, j].astype(np.int64)
            first = np.lexsort((ids[at], -score))[:k]
            best[active[j]] = (at[first], score[first])
        active = active[~done]
    return best


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x); rows with null or non-finite components are left out."""
    v = F.col(vector_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _smallest_ids(keep: int):
    """mapInPandas: of each different vector of a task the ``keep`` smallest ids, so that no vector gathers all its rows."""

    def run(frames):
        held: dict[bytes, list[int]] = {}
        for frame in frames:
            for i, v in zip(frame["vec_id"].to_numpy(), frame["v"]):
                key = np.asarray(v, dtype=np.int64).tobytes()
                ids = held.setdefault(key, [])
                if i not in ids:
                    ids.append(int(i))
                    if len(ids) > 4 * keep:
                        ids.sort()
                        del ids[keep:]
            if len(held) > 50_000:
                yield pack(held)
                held = {}
        if held:
            yield pack(held)

    def pack(held):
        rows = [(key, i) for key, ids in held.items() for i in sorted(ids)[:keep]]
        return pd.DataFrame(rows, columns=["key", "vec_id"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK) -> DataFrame:
    """For each scaled() row whose vec_id is divisible by ``every``: its k highest inner products.

    ``vectors``: (vec_id, v). Returns query_id, rank, vec_id, score; a row is not its own
    candidate, ties go to the smaller vec_id, and fewer candidates give fewer rows.
    Rows alike in id and vector are one; only vectors of the same length have a score;
    an id with several different vectors asks with the smallest and is no candidate of itself.
    Scores are exact while they stay below 2^53. No rows give no rows.

    Equal vectors are one candidate until the end: of each, the k + 1 smallest ids suffice
    to fill any answer. Block sizes are fixed, so a task's memory does not grow with the tables.
    """
    ship(vectors.sparkSession)
    few = vectors.mapInPandas(_smallest_ids(k + 1), "key binary, vec_id long").distinct()
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    classes = few.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.select("key", "ids", F.xxhash64("key").alias("h"), (F.octet_length("key") / 8).cast("int").alias("dims")), "topk-vectors")
    asking = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = materialize(asking.select("vec_id", "v", F.size("v").alias("dims"), F.xxhash64("vec_id").alias("h")), "topk-queries")
    n_blocks = max(1, -(-classes.count() // block))
    n_asking = max(1, -(-asking.count() // QUERY_BLOCK))
    blocks = classes.withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asking - 1))))
    asks = asking.withColumn("ask", F.pmod("h", F.lit(n_asking)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(candidates: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(questions):
            dims = int(candidates["dims"].iloc[0])
            x = np.frombuffer(b"".join(candidates["key"]), dtype=np.int64).reshape(len(candidates), dims)
            smallest = candidates["ids"].map(lambda a: a[0]).to_numpy(np.int64)
            q = np.array([np.asarray(v, dtype=np.int64) for v in questions["v"]], dtype=np.int64).reshape(len(questions), dims)
            lists = candidates["ids"].to_numpy()
            answers = (answer for first in range(0, len(q), TOGETHER) for answer in nra_block(smallest, x, q[first : first + TOGETHER], k + 1))
            for asker, (at, score) in zip(questions["vec_id"].to_numpy(), answers):
                rows = [(int(s), int(i)) for a, s in zip(at, score) for i in lists[a] if i != asker]
                rows.sort(key=lambda r: (-r[0], r[1]))
                out += [(int(asker), i, s) for s, i in rows[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = blocks.groupBy("block", "ask", "dims").cogroup(asks.groupBy("block", "ask", "dims")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB form of top_k() over scaled() for tables in which an id has one vector.
ORACLE_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
