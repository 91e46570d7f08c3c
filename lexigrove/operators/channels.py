"""Candidate channels: each gives (qid, doc_id, score) for a DataFrame of queries.

The query side is small and joined by broadcast once its size is known to be bounded
(``bounded``); the corpus side is never collected and moves at most once, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators.corpus import FIELDS, Corpus, idf
from lexigrove.operators.platforms import eligible
from lexigrove.options import Bm25, Options

#: Rows of the query side that may be broadcast.
QUERY_ROWS = 200_000
#: Terms or hashes that may stand in a plan as a constant set.
CONSTANTS = 20_000
GRAM_LEAST, VECTOR_LEAST, TFIDF_LEAST = 0.12, 0.1, 0.01


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a query side of ``rows`` rows, if that is within the bound."""
    return F.broadcast(df) if rows <= QUERY_ROWS else df


def blocks(queries: DataFrame) -> list[DataFrame]:
    """A stated query set in blocks that may be broadcast, dealt by a hash of qid and text; one block up to the bound."""
    n = queries.count()
    if n <= QUERY_ROWS:
        return [queries]
    parts = -(-2 * n // QUERY_ROWS)  # half full in the mean, so that none exceeds the bound
    dealt = F.pmod(F.xxhash64("qid", "text"), F.lit(parts))
    return [queries.filter(dealt == i) for i in range(parts)]


def top(df: DataFrame, by: str, k: int | Column, name: str = "rank", keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best rows of each query (or of each of ``keys``) by the rounded score, ties to the smaller doc_id."""
    w = Window.partitionBy(*keys).orderBy(F.round(by, 6).desc(), "doc_id")
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def field_bm25(tf: Column, length: Column, mean: float, weight: float, b: float, k1: float) -> Column:
    """The weight stands inside the saturation."""
    mean = mean if mean > 0 else 1.0
    return (F.lit(weight) * tf * (k1 + 1)) / (F.lit(weight) * tf + k1 * (1 - b + b * length / mean))


def bm25f(totals: dict, p: Bm25) -> Column:
    """The sum of four saturated fields, over the columns tf_* and len_*."""
    out = F.lit(0.0)
    for f, b, weight in zip(FIELDS, p.b, p.weight):
        tf = F.col(f"tf_{f}")
        out = out + F.when(tf > 0, field_bm25(tf, F.col(f"len_{f}"), totals[f"avg_{f}"], weight, b, p.k1)).otherwise(0.0)
    return out


def eligible_docs(corpus: Corpus, options: Options) -> DataFrame:
    return corpus.docs.filter(eligible(options)).select("doc_id")


def only_eligible(rows: DataFrame, corpus: Corpus, options: Options) -> DataFrame:
    """The rows of eligible records; no join where every record is one."""
    if options.all_platforms and not options.pipeline_only:
        return rows
    return rows.join(eligible_docs(corpus, options), "doc_id", "left_semi")


def bm25_scores(corpus: Corpus, terms: DataFrame, options: Options, n_terms: int, params: list[Bm25] | None = None) -> DataFrame:
    """A query's duplicate terms count each. ``terms``: weighted_query_terms() of ``n_terms`` rows.

    ``params``: parameter sets to score with in one pass, in place of the options': columns score_0, score_1 and so on;
    null where a record has none of the query's terms of the set's least idf.
    """
    sets = {"score": options.bm25} if params is None else {f"score_{i}": p for i, p in enumerate(params)}
    least = min(p.min_idf for p in sets.values())
    asked = terms.filter(F.col("df").isNotNull() & (F.col("idf") >= least)).select("qid", "term", "idf", (F.col("idf") * F.col("boost")).alias("factor"))
    counts = lambda p, gain: gain if p.min_idf == least else F.when(F.col("idf") >= p.min_idf, gain)
    hits = corpus.postings.join(bounded(asked, n_terms), "term").join(corpus.stats, "doc_id")
    return only_eligible(hits, corpus, options).groupBy("qid", "doc_id").agg(*[F.sum(counts(p, F.col("factor") * bm25f(corpus.totals, p))).alias(name) for name, p in sets.items()])


def text_bm25(docs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(qid, rank, doc_id, score): plain BM25 of queries (qid, text) over whole texts (doc_id, text), the ``most`` best of each query.

    A text moves once, as 64-bit hashes of those of its terms that are asked for, and lies
    with its doc_id from then on: terms are counted, scores summed and the best chosen where
    they are, and only the best of each part move again.
    """
    q = queries.select("qid", F.explode(X.terms(F.col("text"))).alias("term"))
    q = q.sparkSession.createDataFrame(q.toArrow(), q.schema) if queries.count() <= CONSTANTS else q.persist()
    asked = q.select("term").distinct().persist()
    n_asked, salt = asked.count(), 0
    hashed = lambda t: F.xxhash64(t, F.lit(salt))
    while asked.select(hashed(F.col("term"))).distinct().count() < n_asked:  # two terms with one hash
        salt += 1
    worded = docs.select("doc_id", X.terms(F.coalesce("text", F.lit(""))).alias("t"))
    if 0 < n_asked <= CONSTANTS:  # terms have letters and digits only
        listed = ", ".join(f"'{r[0]}'" for r in asked.collect())
        worded = worded.select("doc_id", F.size("t").alias("dl"), F.expr(f"filter(t, x -> x IN ({listed}))").alias("t"))
    else:
        worded = worded.select("doc_id", F.size("t").alias("dl"), "t")
    kept = worded.select("doc_id", "dl", F.transform("t", hashed).alias("h")).repartition("doc_id").persist()
    n, mean = kept.agg(F.count("*"), F.avg("dl")).first()
    known = q.select("qid", hashed(F.col("term")).alias("h"))
    rows = kept.select("doc_id", "dl", F.explode("h").alias("h"))
    if n_asked > CONSTANTS:
        rows = rows.join(bounded(known.select("h").distinct(), n_asked), "h", "left_semi")
    tf = rows.groupBy("doc_id", "dl", "h").agg(F.count("*").alias("tf"))
    df = tf.groupBy("h").agg(F.count("*").alias("df"))
    gain = idf(F.lit(n), F.col("df")) * field_bm25(F.col("tf"), F.col("dl"), mean, 1.0, 0.75, 1.2)
    factors = known.join(df, "h").persist()
    scores = tf.join(bounded(factors, factors.count()), "h").groupBy("qid", "doc_id").agg(F.sum(gain).alias("score"))
    return top(scores, "score", most).select("qid", "rank", "doc_id", "score")


def char_gram_scores(corpus: Corpus, queries: DataFrame, options: Options, n_queries: int) -> DataFrame:
    """Shared trigrams over the root of both counts; filtered, then capped at max(6 L, 12)."""
    grams = queries.select("qid", X.char_grams(F.col("text")).alias("g")).select("qid", F.size("g").alias("n_q"), F.explode("g").alias("gram"))
    shared = corpus.grams.join(bounded(grams, n_queries * 100), "gram").groupBy("qid", "n_q", "doc_id").agg(F.count("*").alias("common"))
    scored = shared.join(corpus.stats.select("doc_id", "n_grams"), "doc_id").filter("n_grams > 0")
    scored = scored.withColumn("sim", F.col("common") / (F.sqrt(F.col("n_q").cast("double")) * F.sqrt(F.col("n_grams").cast("double")))).filter(F.col("sim") >= GRAM_LEAST)
    scored = only_eligible(scored, corpus, options)
    return top(scored, "sim", max(6 * options.limit, 12)).select("qid", "doc_id", (F.col("sim") * 55.0).alias("score"))


def tfidf_query_vectors(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, term, q): tf over all of the query's terms, in or out of the vocabulary, times idf."""
    words = queries.select("qid", X.weighted_terms(F.coalesce("text", F.lit(""))).alias("w"))
    rows = words.select("qid", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("qid", "n", "term").agg(F.count("*").alias("c"))
    return rows.join(vocabulary.select("term", "idf"), "term").select("qid", "term", (F.col("c") / F.col("n") * F.col("idf")).alias("q"))


def tfidf_similarities(corpus: Corpus, queries: DataFrame, n_queries: int, most: int) -> DataFrame:
    """(qid, doc_id, sim, rank) of the ``most`` records of the highest cosine above 0.01, best first; the cap is a group limit before the shuffle."""
    vectors = tfidf_query_vectors(queries, corpus.vocabulary)
    norms = vectors.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = corpus.weights.join(bounded(vectors, n_queries * 100), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    sims = dots.join(bounded(norms, n_queries), "qid").join(corpus.norms, "doc_id").filter("q_norm > 0 and norm > 0")
    sims = sims.select("qid", "doc_id", (F.col("dot") / (F.col("q_norm") * F.col("norm"))).alias("sim")).filter(F.col("sim") > TFIDF_LEAST)
    return top(sims, "sim", most)


def nlp_search(corpus: Corpus, queries: DataFrame, n_queries: int, limit: int) -> DataFrame:
    """R34 over an index: (qid, rank, doc_id, score): the records of the highest TF-IDF cosine, at 100 times it."""
    best = tfidf_similarities(corpus, queries, n_queries, 2 * limit).filter(F.col("rank") <= limit)
    return best.select("qid", "rank", "doc_id", (F.col("sim") * 100.0).alias("score"))


def tfidf_scores(corpus: Corpus, sims: DataFrame, options: Options) -> DataFrame:
    """Capped at max(6 L, 15) first, filtered after."""
    capped = sims.filter(F.col("rank") <= max(6 * options.limit, 15))
    return only_eligible(capped, corpus, options).select("qid", "doc_id", (F.col("sim") * 100.0).alias("score"))


def vector_scores(corpus: Corpus, sims: DataFrame, options: Options) -> DataFrame:
    """Of cosine similarities (qid, doc_id, sim): at least 0.1, filtered, then capped at max(3 L, 10)."""
    kept = sims.filter(F.col("sim") >= VECTOR_LEAST).join(eligible_docs(corpus, options), "doc_id", "left_semi")
    return top(kept, "sim", max(3 * options.limit, 10)).select("qid", "doc_id", (F.col("sim") * 45.0).alias("score"))


def fused(bm25: DataFrame, chars: DataFrame | None, vectors: DataFrame | None, tfidf: DataFrame | None) -> DataFrame:
    """A channel adds less to a record that an earlier channel has found than to a new one.

    Each score column of ``bm25`` gives one of the same name; null where no channel has found the record with that column's parameters.
    """
    names = [c for c in bm25.columns if c not in ("qid", "doc_id")]
    others = {name: df for name, df in (("chars", chars), ("vectors", vectors), ("tfidf", tfidf)) if df is not None}
    columns = [*names, "chars", "vectors", "tfidf"]
    rows = bm25.select("qid", "doc_id", *names, *[F.lit(None).cast("double").alias(c) for c in columns[len(names) :]])
    for name, df in others.items():
        rows = rows.unionByName(df.select("qid", "doc_id", *[(F.col("score") if c == name else F.lit(None).cast("double")).alias(c) for c in columns]))
    wide = rows.groupBy("qid", "doc_id").agg(*[F.max(c).alias(c) for c in columns])
    worth = lambda c, found, again, new: F.coalesce(F.col(c) * F.when(found, again).otherwise(new), F.lit(0.0))

    def total(name: str) -> Column:
        has = {c: F.col(c).isNotNull() for c in columns}
        sum_ = F.coalesce(name, F.lit(0.0)) + worth("chars", has[name], 0.35, 0.80) + worth("vectors", has[name] | has["chars"], 0.35, 0.55) + worth("tfidf", has[name] | has["chars"] | has["vectors"], 0.45, 0.65)
        return F.when(has[name] | has["chars"] | has["vectors"] | has["tfidf"], sum_).alias(name)

    return wide.select("qid", "doc_id", *[total(name) for name in names])
