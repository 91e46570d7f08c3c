"""Word vectors: embedding of queries and records, the dominant direction, cosine search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.functions import text as X
from lexigrove.functions import vectors as V

ROUNDS, LEAST_DOCS, A = 24, 16, 1e-3
#: Query vectors sent to the executors at once, and those compared with a batch at once.
QUERY_BLOCK, QUERY_ROWS = 8192, 256


def token_weight(token: Column, rank: Column, vocabulary: int) -> Column:
    """Rare words weigh more, words with a digit 1.2 times, words of two bytes or fewer 0.85 times."""
    share = (rank + 1) / F.lit(float(max(vocabulary, 1)))
    return A / (A + share) * F.when(token.rlike("[0-9]"), 1.2).otherwise(1.0) * F.when(F.octet_length(token) <= 2, 0.85).otherwise(1.0)


def _vectors_of(rows: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., vec, rank, word) of token rows: the first variant that has a vector."""
    n = F.posexplode(X.token_variants(F.col("token"))).alias("nth", "word")
    found = rows.select(*key, "at", "token", "share", n).join(words, "word")
    first = Window.partitionBy(*key, "at").orderBy("nth")
    return found.withColumn("r", F.row_number().over(first)).filter("r = 1")


def weighted_mean(rows: DataFrame, words: DataFrame, key: list[str], vocabulary: int) -> DataFrame:
    """(key..., vec) of token rows (key..., at, token, share): the mean of the tokens' vectors by share and token weight."""
    found = _vectors_of(rows, words, key).withColumn("w", F.col("share") * token_weight(F.col("word"), F.col("rank"), vocabulary))
    total = found.select(*key, "w", F.posexplode("vec").alias("i", "x")).groupBy(*key, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    return total.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("vec"))


def embed_queries(queries: DataFrame, words: DataFrame, direction: list[float] | None = None) -> DataFrame:
    """(qid, vec): unit mean vector of a query's words less the dominant direction; queries without known words have no row. ``words``: (word, rank, vec)."""
    rows = queries.select("qid", F.posexplode(X.vector_terms(F.col("text"))).alias("at", "token")).withColumn("share", F.lit(1.0))
    mean = weighted_mean(rows, words, ["qid"], words.count())
    vec = V.without(F.col("vec"), F.array(*[F.lit(float(x)) for x in direction])) if direction else F.col("vec")
    return mean.select("qid", V.normalized(vec).alias("vec"))


def embed_records(docs: DataFrame, words: DataFrame, dimension: int) -> DataFrame:
    """(doc_id, vec): fields weigh 3, 2 and 1 (command, keywords, description), each token 1 / root of its field's share; zeros if no word is known."""
    fields = [(X.vector_terms(X.clean(F.col("command"))), 3.0), (X.vector_terms(X.clean(F.array_join("keywords", " "))), 2.0), (X.vector_terms(X.clean(F.col("description"))), 1.0)]
    tag = lambda w: lambda x: F.struct(x.alias("token"), F.lit(w).alias("w"))
    every = F.concat(*[F.transform(t, tag(w)) for t, w in fields])
    rows = docs.select("doc_id", every.alias("t")).select("doc_id", F.col("t"), F.posexplode("t").alias("at", "one"))
    counts = F.size(F.filter("t", lambda x: x["token"] == F.col("one.token")))
    rows = rows.select("doc_id", "at", F.col("one.token").alias("token"), (F.col("one.w") / F.sqrt(counts.cast("double"))).alias("share"))
    mean = weighted_mean(rows, words, ["doc_id"], words.count())
    zero = F.array_repeat(F.lit(0.0), dimension)
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce(V.normalized(F.col("vec")), zero).alias("vec"))


def attached(docs: DataFrame, digest: str, words_path: str, records_path: str | None = None, dimension: int = 100) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
    """(word vectors, record vectors, what was wrong). What is missing, unreadable or of other records is None, and a search goes on without it."""
    from lexigrove.sources import embeddings

    spark, said = docs.sparkSession, []
    try:
        words = embeddings.read_word_vectors(spark, words_path, dimension)
        words.limit(1).count()
    except Exception as e:  # the vectors are optional, whatever keeps them from being read
        return None, None, [f"word vectors: {type(e).__name__}"]
    if records_path is None:
        return words, None, said
    try:
        found, head = embeddings.read_record_vectors(spark, records_path)
        records = embeddings.aligned(found, head, docs, digest)
    except Exception as e:
        return words, None, [f"record vectors: {type(e).__name__}"]
    if records is None:
        said.append("record vectors: they belong to other records")
    return words, records, said


def query_similarities(queries: DataFrame, words: DataFrame, records: DataFrame, k: int, direction: list[float] | None = None) -> DataFrame:
    """(qid, doc_id, sim) for ``search(vectors=...)``: the k records nearest to each query's vector."""
    asked = embed_queries(queries, words, direction)
    return cosine_top(asked, records, k).select("qid", "doc_id", "sim")


def dominant_direction(vectors: DataFrame, rounds: int = ROUNDS) -> list[float] | None:
    """24 power iterations on the Gram matrix, from the even vector; None for fewer than 16 vectors.

    The d x d matrix is one aggregation over the vectors; only it reaches the driver.
    """
    rows = vectors.select(V.doubles(F.col("vec")).alias("v"))
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if n < LEAST_DOCS:
        return None
    gram = rows.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first() if d <= 16 else None
    m = np.zeros((d, d))
    if gram is not None:
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = gram[f"g{i}_{j}"]
    else:  # wider vectors: one partial matrix a partition, summed by Spark
        def partial(frames):
            import pandas as pd

            total = np.zeros((d, d))
            for f in frames:
                if len(f):
                    x = np.stack(f["v"].to_numpy())
                    total += x.T @ x
            yield pd.DataFrame({"i": np.arange(d * d), "g": total.ravel()})

        ship(vectors.sparkSession)
        for r in rows.mapInPandas(partial, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
            m[r["i"] // d, r["i"] % d] = r["g"]
    u = np.full(d, 1 / np.sqrt(d))
    for _ in range(rounds):
        u = m @ u
        length = np.linalg.norm(u)
        if length == 0:
            return None
        u = u / length
    return [float(x) for x in u]


def without_dominant(vectors: DataFrame, direction: list[float] | None) -> DataFrame:
    """Vectors (doc_id, vec) less the direction, at unit length again."""
    if direction is None:
        return vectors
    return vectors.withColumn("vec", V.normalized(V.without(F.col("vec"), F.array(*[F.lit(x) for x in direction]))))


def _block_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, sim): of each task's portions of vectors, the k best for each of the collected query vectors of a block."""
    asked = queries.select("qid", "vec").toArrow().combine_chunks()
    kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "doc_id": vectors.schema["doc_id"].dataType.simpleString()}

    def matrix(vecs: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vecs), d)
        return rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))

    held = vectors.sparkSession.sparkContext.broadcast((asked.column("qid").combine_chunks(), asked.column("vec").combine_chunks()))

    def run(batches):
        qids, qvecs = held.value
        sizes = pc.list_value_length(qvecs)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))  # ties go to the smaller doc_id
            lengths = pc.list_value_length(batch.column(1))
            for d in pc.unique(lengths).to_pylist():
                some, own = batch.filter(pc.equal(lengths, d)), pc.equal(sizes, d)
                asked, (v, v_norm), (q, q_norm) = qids.filter(own), matrix(some.column(1), d), matrix(qvecs.filter(own), d)
                for at in range(0, len(asked), QUERY_ROWS):
                    norms = q_norm[at : at + QUERY_ROWS, None] * v_norm
                    sims = np.divide(q[at : at + QUERY_ROWS] @ v.T, norms, out=np.zeros_like(norms), where=~(norms <= 0))
                    n = sims.shape[1]
                    # rank by the rounded similarity, then by the place, in one integer
                    key = -np.where(np.isnan(sims), -2e6, np.rint(sims * 1e6)).astype(np.int64) * n + np.arange(n)
                    best = np.argpartition(key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), key.shape)
                    found = np.take_along_axis(sims, best, axis=1).ravel()
                    rows = np.repeat(np.arange(at, at + len(sims)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows)), some.column(0).take(pa.array(best.ravel())), pa.array(found, mask=np.isnan(found))], names=["qid", "doc_id", "sim"])

    return vectors.select("doc_id", "vec").filter("vec is not null").mapInArrow(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, sim double")


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, rank, doc_id, sim): a stated set of query vectors (qid, vec) against all vectors (doc_id, vec).

    The queries are sent in blocks of about ``block`` rows, whatever their number.
    """
    ship(vectors.sparkSession)
    asked = queries.filter("vec is not null").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // block)))))
    blocks = sorted(r["block"] for r in asked.select("block").distinct().collect()) or [0]
    sims = reduce(DataFrame.unionByName, [_block_top(asked.filter(F.col("block") == b), vectors, k) for b in blocks])
    w = Window.partitionBy("qid").orderBy(F.rint(F.col("sim") * 1e6).desc(), "doc_id")
    return sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
