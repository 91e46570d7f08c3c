"""Universal search: a DataFrame of queries against a corpus, best records per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import text as X
from lexigrove.operators import analysis, channels, families, features
from lexigrove.operators.corpus import Corpus, doc_bases
from lexigrove.operators.platforms import is_pipeline
from lexigrove.options import Bm25, Options


#: A query-side table of so many rows at most is computed once and becomes a constant of the plans that follow.
CONSTANT_ROWS = 20_000


def settled(df: DataFrame, rows: int) -> DataFrame:
    """``df``, computed now: as a constant if ``rows``, its bound, is small, else kept by Spark."""
    if rows > CONSTANT_ROWS:
        return df.persist()
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)  # from Arrow it is a local relation: no Python worker runs


class Search:
    """The stages of one search, each a DataFrame that can be looked at by itself.

    ``vectors``: optional cosine similarities (qid, doc_id, sim) of the word-vector channel.
    Query-side tables are kept: they are small and used by several stages.
    """

    def __init__(self, corpus: Corpus, queries: DataFrame, options: Options | None = None, vectors: DataFrame | None = None):
        self.corpus, self.options = corpus, (options or Options()).normal()
        self.n_queries = queries.count()
        self.queries = settled(queries.select("qid", F.coalesce("text", F.lit("")).alias("text")), self.n_queries)
        self.analysed = settled(analysis.query_terms(self.queries, self.options), self.n_queries)
        self.n_terms = self.n_queries * max(self.options.top_terms, 10) * 3
        self.terms = settled(analysis.weighted_query_terms(self.analysed, corpus.df, corpus.totals["n"], self.options), self.n_terms)
        self._families: DataFrame | None = None
        self._sides: dict[bool, DataFrame] = {}
        # the vector channel belongs to language understanding, like the channel of weighted terms
        self.vectors = vectors if self.options.use_nlp else None

    def bm25(self, params: list[Bm25] | None = None) -> DataFrame:
        return channels.bm25_scores(self.corpus, self.terms, self.options, self.n_terms, params)

    def first_scores(self, params: list[Bm25] | None = None) -> DataFrame:
        """R2 and, if asked for, R14."""
        scores = self.bm25(params)
        if not self.options.family_expansion:
            return scores
        names = [c for c in scores.columns if c not in ("qid", "doc_id")]
        bonus = families.expansion_scores(self.corpus, self.families(), self.options).select("qid", "doc_id", *[F.col("bonus").alias(n) for n in names])
        return scores.unionByName(bonus).groupBy("qid", "doc_id").agg(*[F.sum(n).alias(n) for n in names])

    def families(self) -> DataFrame:
        if self._families is None:
            self._families = settled(families.family_scores(self.corpus, self.terms, self.n_terms), self.n_queries * families.TOP_BASES)
        return self._families

    def similarities(self) -> DataFrame:
        o = self.options  # as many as the channel takes, or the reranking looks at
        return channels.tfidf_similarities(self.corpus, self.queries, self.n_queries, max(6 * o.limit, 15))

    def candidates(self, sims: DataFrame | None = None, params: list[Bm25] | None = None) -> DataFrame:
        """R20; with ``params``, a column score_0, score_1 and so on for each of these parameter sets."""
        o = self.options
        chars = channels.char_gram_scores(self.corpus, self.queries, o, self.n_queries) if o.char_grams else None
        vectors = channels.vector_scores(self.corpus, self.vectors, o) if self.vectors is not None else None
        tfidf = channels.tfidf_scores(self.corpus, sims if sims is not None else self.similarities(), o) if o.use_nlp else None
        answered = self.analysed.filter(F.size("terms") > 0).select("qid")  # a query without terms has no candidates
        return channels.fused(self.first_scores(params), chars, vectors, tfidf).join(channels.bounded(answered, self.n_queries), "qid", "left_semi")

    def query_side(self, contexts: bool = True) -> DataFrame:
        """One row per query: its analysis and weighted terms; ``contexts``: with the command families that it names, which takes a pass over the records."""
        if contexts in self._sides or True in self._sides:
            return self._sides.get(contexts, self._sides.get(True))
        tw = self.terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "weight", "anchor"))).alias("tw"))
        q = self.analysed.select("qid", "actions", "targets", "keywords", "intent").join(tw, "qid", "left")
        none = F.array().cast("array<struct<pos:int,term:string,weight:double,anchor:boolean>>")
        q = q.withColumn("tw", F.coalesce("tw", none))
        if contexts:
            bases = doc_bases(self.corpus.docs).select("base").distinct()
            said = q.select("qid", F.explode("keywords").alias("w")).select("qid", F.lower("w").alias("base")).distinct().join(bases, "base", "left_semi")
            known = said.groupBy("qid").agg(F.collect_list("base").alias("contexts"))
            q = q.join(known, "qid", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        wide = features.with_synonyms
        q = q.withColumnRenamed("keywords", "asked_keywords")  # records have keywords, too
        q = settled(q, self.n_queries)
        self._sides[contexts] = q.select("*", wide(F.col("actions")).alias("action_words"), wide(F.col("targets")).alias("target_words"), wide(F.col("asked_keywords")).alias("keyword_words"))
        return self._sides[contexts]

    def featured(self, candidates: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
        """(qid, doc_id, score, and the features) of candidates (qid, doc_id, score); with score_0, score_1 and so on in place of score, one product for each.

        ``names``: the features that are asked for, with what goes into them; none: all.
        Families and contexts take passes over the records, and are left out with the
        columns that need them where nobody asks.
        """
        o = self.options
        asked = lambda *some: not names or any(n in names for n in some)
        cascading, scored = asked("cascade"), asked("score", "family")
        raws = {c: c.replace("score", "raw") for c in candidates.columns if c not in ("qid", "doc_id")}
        rows = candidates.withColumnsRenamed(raws).join(self.corpus.docs.withColumn("base", X.base_of(F.lower("command"))), "doc_id")
        rows = rows.join(channels.bounded(self.query_side(cascading and o.use_nlp), self.n_queries), "qid")
        if scored:
            rows = rows.join(channels.bounded(families.family_boosts(self.families()), self.n_queries * 5), ["qid", "base"], "left")
        one = F.lit(1.0)
        piped = F.when(is_pipeline(F.col("command"), F.col("pipeline")), o.pipeline_boost).otherwise(1.0) if o.pipeline_boost > 0 else one
        rows = rows.select(
            "qid", "doc_id", *raws.values(), features.proximity_boost().alias("proximity") if o.proximity else one.alias("proximity"), features.coverage_boost().alias("coverage"), *([F.coalesce("family_boost", one).alias("family")] if scored else []),
            features.long_intent_boost().alias("long_intent"), (features.intent_boost() if o.use_nlp else one).alias("intent_boost"), (features.together_boost() if o.use_nlp else one).alias("together"),
            piped.alias("piped"), *([(features.cascading_boost() if o.use_nlp else one).alias("cascade")] if cascading else []),
        )
        if not scored:
            return rows
        for score, raw in raws.items():
            product = F.col(raw)
            for f in ("proximity", "coverage", "family", "long_intent", "intent_boost", "together", "piped"):
                product = product * F.col(f)
            rows = rows.withColumn(score, product)
        return rows

    def cascaded(self, rows: DataFrame, n: int) -> DataFrame:
        """F24 of ``n`` rows at most that were kept: with the column cascade."""
        with_record = self.corpus.docs.join(channels.bounded(rows, n), "doc_id").join(channels.bounded(self.query_side(), self.n_queries), "qid")
        return with_record.select(*rows.columns, features.cascading_boost().alias("cascade"))

    def reranked(self, rows: DataFrame, sims: DataFrame, keys: tuple[str, ...] = ("qid",), sets: int = 1) -> DataFrame:
        """the best max(5 L, 10) by feature score, plus 35 times their cosine if among as many best of the corpus, times the boosts.

        ``rows``: (keys, doc_id, score), of ``sets`` parameter sets; only those that are kept get their cascade (F24).
        """
        most = max(5 * self.options.limit, 10)
        kept = channels.top(rows.select(*keys, "doc_id", "score"), "score", most, "place", keys)
        n_kept = F.count("*").over(Window.partitionBy(*keys))
        near = sims.select("qid", "doc_id", "sim", F.col("rank").alias("near"))
        kept = self.cascaded(kept.withColumn("n_kept", n_kept).join(near, ["qid", "doc_id"], "left"), sets * self.n_queries * most)
        blended = F.col("score") + F.when(F.col("near") <= F.col("n_kept"), F.col("sim") * 35.0).otherwise(0.0)
        final = blended * F.col("cascade")
        if self.vectors is None:
            return kept.select(*keys, "doc_id", final.alias("score"))
        v = kept.select(*keys, "doc_id", final.alias("score")).join(self.vectors.select("qid", "doc_id", F.col("sim").alias("vector")), ["qid", "doc_id"], "left")
        return v.select(*keys, "doc_id", (F.col("score") * F.when(F.col("vector") >= 0.1, 1 + 0.3 * F.col("vector")).otherwise(1.0)).alias("score"))

    def results(self) -> DataFrame:
        """(qid, rank, doc_id, score)."""
        return self._ranked(None).select("qid", "rank", "doc_id", "score")

    def alternatives(self, params: dict[int, Bm25]) -> DataFrame:
        """R1 with each of these parameter sets in place of the options': (config, qid, rank, doc_id, score).

        One pass over the records: terms, families, similarities and features do not depend
        on the parameters, and each set has a column of scores.
        """
        return self._ranked(params)

    def _ranked(self, params: dict[int, Bm25] | None) -> DataFrame:
        o, sets = self.options, 1 if params is None else len(params)
        sims = self.similarities().persist() if o.use_nlp else None
        if o.use_nlp:
            self.query_side()  # with contexts, so that it is made once
        rows, keys = self.featured(self.candidates(sims, None if params is None else list(params.values())), ("score",)), ("qid",)
        if params is not None:
            of_set = [F.struct(F.lit(config).alias("config"), F.col(f"score_{i}").alias("score")) for i, config in enumerate(params)]
            rows, keys = rows.select("qid", "doc_id", F.inline(F.array(*of_set))).filter(F.col("score").isNotNull()), ("config", "qid")
        final = self.reranked(rows, sims, keys, sets) if o.use_nlp else rows
        w = Window.partitionBy(*keys).orderBy(F.round("score", 4).desc(), "doc_id")
        ranked = final.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= o.limit)
        return ranked.select(*keys, "rank", "doc_id", "score")


def search(corpus: Corpus, queries: DataFrame, options: Options | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """R1 for a set of queries (qid, text): (qid, rank, doc_id, score). With use_fuzzy, queries without results fall back to fuzzy matching."""
    from lexigrove.operators.fuzzy import fuzzy_search

    s = Search(corpus, queries, options, vectors)
    found = s.results()
    if not s.options.use_fuzzy:
        return found
    missed = s.queries.join(found.select("qid").distinct(), "qid", "left_anti")
    return found.unionByName(fuzzy_search(corpus.docs, missed, s.options.limit, s.options.fuzzy_threshold).select("qid", "rank", "doc_id", "score"))
