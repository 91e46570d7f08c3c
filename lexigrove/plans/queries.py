"""The registered queries: every operator over the tables of a directory, and its SQL for DuckDB.

``part`` serves as a corpus of records: its name is the command, type and brand the
description, the words of the name the keywords. Query sets are literal, as a user's would be.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove import schema
from lexigrove.cluster import dealt_by, spread
from lexigrove.functions import sanitize
from lexigrove.functions import text as X
from lexigrove.functions import vectors as V
from lexigrove.operators import analysis, channels, evaluate, families, features, fuzzy, history, legacy, metrics, platforms, presentation, projects, vectors
from lexigrove.operators import corpus as C
from lexigrove.operators.search import Search
from lexigrove.options import Options
from lexigrove.plans import sql as S
from lexigrove.sources import pages, records

FLAGSHIP = "universal_search"
LIMIT = 5
OPEN = Options(limit=LIMIT, all_platforms=True)

QUERY_SET = [
    (1, "small ring"),
    (2, "find the red widget"),
    (3, "create new bolt directory"),
    (4, "blue gera"),
    (5, "show me the contents of a large plate without opening"),
    (6, "economy brand hot anvil"),
    (7, "zzqx"),
    (8, "please find every old cold rod under the standard brand sorted by disk usage on port 8080 for the windows process list"),
    (9, "download url of medium widget files"),
    (10, "installing gear and deleting archives"),
]
DOC_QUERIES = [(1, "the thing with other"), (2, "les des eau"), (3, "und der schreiben"), (4, "que ciones"), (5, "erhe anwh thti")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """documents, for queries that work hard on each text."""
    return spread(_t(spark, d, "documents"))


def _queries(spark: SparkSession, rows=None) -> DataFrame:
    qid, text = zip(*(rows or QUERY_SET))
    return spark.createDataFrame(pa.table({"qid": pa.array(qid, pa.int64()), "text": pa.array(text, pa.string())}))


def part_records(spark: SparkSession, d: str, keyed: bool = False) -> DataFrame:
    """part as records; ``keyed``: dealt out by key, for a corpus."""
    k = F.col("p_size") % 4
    platform = F.when(k == 0, "linux").when(k == 1, "macos").when(k == 2, "windows").otherwise("cross-platform")
    part = _t(spark, d, "part")
    df = (dealt_by(part, "p_partkey") if keyed else spread(part)).select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("command"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.split("p_name", " ").alias("keywords"),
        F.array(F.lower("p_type")).alias("tags"), F.col("p_type").alias("niche"), F.array(platform).alias("platform"), (F.col("p_size") % 3 == 0).alias("pipeline"),
    )
    return schema.records(df)


def document_records(spark: SparkSession, d: str) -> DataFrame:
    return schema.records(_docs(spark, d).select("doc_id", F.col("source").alias("command"), F.col("text").alias("description"), F.array("lang").alias("tags"), F.col("lang").alias("niche")))


def _corpus(spark: SparkSession, d: str) -> C.Corpus:
    return C.Corpus.of(part_records(spark, d, keyed=True))


def _search(spark: SparkSession, d: str, options: Options = OPEN) -> Search:
    return Search(_corpus(spark, d), _queries(spark), options)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as a search log: a user's event types are the queries."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events")
    return e.select("user_id", F.col("event_type").alias("query"), "ts", F.row_number().over(w).alias("seq"), F.floor("value").cast("long").alias("results_count"), F.round(F.col("value") * 10).cast("long").alias("duration_ms"))


LOG_SQL = "log AS (SELECT user_id, event_type AS query, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, floor(value)::BIGINT AS results_count, round(value * 10)::BIGINT AS duration_ms FROM events)"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


R = lambda c, n=6: F.round(c, n).alias(c)

# --- tokens ---------------------------------------------------------------------------------


@_register("tok_terms", S.query([f"t AS (SELECT doc_id, {S.terms('text')} AS t FROM documents)"], "SELECT doc_id, len(t)::INTEGER AS n, array_to_string(t, ' ') AS terms FROM t"))
def tok_terms(spark, d):
    t = X.terms(F.coalesce("text", F.lit("")))
    return _docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("terms"))


@_register("tok_bigrams", S.query([f"t AS (SELECT doc_id, {S.terms('text')} AS t FROM documents)", f"b AS (SELECT unnest({S.neighbours('t')}) AS bigram FROM t)"], "SELECT bigram, count(*) AS n FROM b GROUP BY bigram"))
def tok_bigrams(spark, d):
    return _docs(spark, d).select(F.explode(X.neighbours(X.terms(F.col("text")))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@_register("tok_trigrams", S.query([f"g AS (SELECT unnest({S.grams('text')}) AS gram FROM documents)"], "SELECT gram, count(*) AS n FROM g GROUP BY gram"))
def tok_trigrams(spark, d):
    return _docs(spark, d).select(F.explode(X.char_grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@_register("stem_terms", S.query([f"w AS (SELECT unnest({S.weighted('text')}) AS term FROM documents)"], "SELECT term, count(*) AS n FROM w GROUP BY term"))
def stem_terms(spark, d):
    """Words are counted first, so that each different one is stemmed once and in generated code."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    counted = _docs(spark, d).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    stems = counted.select(X.stem(F.col("word")).alias("term"), "n").filter(X.is_weighted_term(F.col("term")))
    return stems.groupBy("term").agg(F.sum("n").alias("n"))


@_register("token_variants", r"""
SELECT DISTINCT w AS token, array_to_string(list_filter([w,
   CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, length(w) - 3) END, CASE WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, length(w) - 2) END,
   CASE WHEN ends_with(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) END, CASE WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) END],
   lambda x: x IS NOT NULL), ' ') AS variants
FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) >= 2)) AS w FROM documents)""")
def token_variants(spark, d):
    w = _docs(spark, d).select(F.explode(X.vector_terms(F.col("text"))).alias("token")).distinct()
    return w.select("token", F.array_join(X.token_variants(F.col("token")), " ").alias("variants"))


# --- index ----------------------------------------------------------------------------------


@_register("index_postings", S.query(S.CORPUS, "SELECT term, doc_id, tf_cmd, tf_desc, tf_keys, tf_tags FROM postings"))
def index_postings(spark, d):
    return C.postings(C.field_tokens(part_records(spark, d)))


@_register("index_df", S.query(S.CORPUS, "SELECT term, df FROM frequency"))
def index_df(spark, d):
    return C.document_frequency(C.postings(C.field_tokens(part_records(spark, d))))


@_register("field_lengths", S.query(S.CORPUS, "SELECT doc_id, len_cmd::INTEGER AS len_cmd, len_desc::INTEGER AS len_desc, len_keys::INTEGER AS len_keys, len_tags::INTEGER AS len_tags, n_grams::INTEGER AS n_grams FROM stats"))
def field_lengths(spark, d):
    docs = part_records(spark, d)
    return C.doc_stats(docs, C.field_tokens(docs))


@_register("corpus_stats", S.query(S.CORPUS, "SELECT n, round(avg_cmd, 6) AS avg_cmd, round(avg_desc, 6) AS avg_desc, round(avg_keys, 6) AS avg_keys, round(avg_tags, 6) AS avg_tags FROM totals"))
def corpus_stats(spark, d):
    docs = part_records(spark, d)
    s = C.corpus_stats(C.doc_stats(docs, C.field_tokens(docs)))
    return s.select("n", *[R(f"avg_{f}") for f in C.FIELDS])


# The same over documents as records: long, hot and null texts reach the corpus tables.
_DOCUMENT_RECORDS = "docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS command, coalesce(text, '') AS description, []::VARCHAR[] AS keywords, CASE WHEN lang IS NULL THEN []::VARCHAR[] ELSE [lang] END AS tags, coalesce(lang, '') AS niche, []::VARCHAR[] AS platform, false AS pipeline FROM documents)"
_DOCUMENT_CORPUS = [_DOCUMENT_RECORDS, S.TOKENS, S.POSTINGS, S.STATS]


@_register("document_index_postings", S.query(_DOCUMENT_CORPUS, "SELECT term, doc_id, tf_cmd, tf_desc, tf_keys, tf_tags FROM postings"))
def document_index_postings(spark, d):
    return C.postings(C.field_tokens(document_records(spark, d)))


@_register("document_index_df", S.query(_DOCUMENT_CORPUS, "SELECT term, df FROM frequency"))
def document_index_df(spark, d):
    return C.document_frequency(C.postings(C.field_tokens(document_records(spark, d))))


@_register("document_field_lengths", S.query(_DOCUMENT_CORPUS, "SELECT doc_id, len_cmd::INTEGER AS len_cmd, len_desc::INTEGER AS len_desc, len_keys::INTEGER AS len_keys, len_tags::INTEGER AS len_tags, n_grams::INTEGER AS n_grams FROM stats"))
def document_field_lengths(spark, d):
    docs = document_records(spark, d)
    return C.doc_stats(docs, C.field_tokens(docs))


@_register("document_corpus_stats", S.query(_DOCUMENT_CORPUS, "SELECT n, round(avg_cmd, 6) AS avg_cmd, round(avg_desc, 6) AS avg_desc, round(avg_keys, 6) AS avg_keys, round(avg_tags, 6) AS avg_tags FROM totals"))
def document_corpus_stats(spark, d):
    docs = document_records(spark, d)
    s = C.corpus_stats(C.doc_stats(docs, C.field_tokens(docs)))
    return s.select("n", *[R(f"avg_{f}") for f in C.FIELDS])


@_register("doc_term_df", S.query([f"t AS (SELECT DISTINCT doc_id, unnest({S.terms('text')}) AS term FROM documents)"], "SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM t GROUP BY term"))
def doc_term_df(spark, d):
    docs = _docs(spark, d)
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.round(C.idf(F.lit(n), F.col("df")), 6).alias("idf"))


@_register("corpus_size", "SELECT count(*) AS n FROM part")
def corpus_size(spark, d):
    return _corpus(spark, d).docs.agg(F.count("*").alias("n"))


@_register("lowered_records", S.query([S.DOCS], "SELECT doc_id, lower(command) AS command_lower, lower(description) AS description_lower, lower(array_to_string(keywords, ' ')) AS keywords, lower(array_to_string(tags, ' ')) AS tags FROM docs"))
def lowered_records(spark, d):
    r = schema.lowered(part_records(spark, d))
    return r.select("doc_id", "command_lower", "description_lower", F.array_join("keywords_lower", " ").alias("keywords"), F.array_join("tags_lower", " ").alias("tags"))


@_register("snapshot_hash", S.query([S.DOCS], "SELECT sha256(string_agg(lower(trim(command)) || chr(31) || lower(trim(description)) || chr(31) || array_to_string(list_transform(keywords, lambda k: lower(trim(k))), chr(30)) || chr(29), '' ORDER BY doc_id)) AS hash FROM docs"))
def snapshot_hash(spark, d):
    return C.snapshot_hash(part_records(spark, d))


# --- filters --------------------------------------------------------------------------------


@_register("platform_filter", S.query([S.DOCS], f"SELECT doc_id, command FROM docs WHERE {S.compatible('windows')} OR {S.compatible('cross-platform')} OR {S.TOOL}"))
def platform_filter(spark, d):
    return part_records(spark, d).filter(platforms.platform_ok(Options(platforms=("windows",)))).select("doc_id", "command")


@_register("cross_platform_excluded", S.query([S.DOCS], f"SELECT doc_id, command FROM docs WHERE {S.compatible('windows', cross=False)} OR {S.compatible('linux', cross=False)}"))
def cross_platform_excluded(spark, d):
    return part_records(spark, d).filter(platforms.platform_ok(Options(platforms=("windows", "linux"), no_cross_platform=True))).select("doc_id", "command")


@_register("pipeline_filter", S.query([S.DOCS], f"SELECT doc_id FROM docs WHERE {S.PIPELINE}"))
def pipeline_filter(spark, d):
    return part_records(spark, d).filter(platforms.is_pipeline(F.col("command"), F.col("pipeline"))).select("doc_id")


# --- query understanding ----------------------------------------------------------------------

_QA = [S.queries(QUERY_SET), S.LEXICON, S.ANALYSIS]
_JOINED = lambda *names: ", ".join(f"array_to_string({n}, ' ') AS {n}" for n in names)
_QT = [*S.CORPUS, *_QA, S.EXPANSION, S.CAP]


@_register("query_analysis", S.query(_QA, f"SELECT qid, cleaned, {_JOINED('actions', 'targets', 'keywords')} FROM analysis"))
def query_analysis(spark, d):
    return analysis.analyze(_queries(spark)).select("qid", "cleaned", *[F.array_join(c, " ").alias(c) for c in ("actions", "targets", "keywords")])


_USER = "queries AS MATERIALIZED (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')"


@_register("query_intent", S.query([_USER, S.LEXICON, S.ANALYSIS], "SELECT qid, intent, len(keywords)::INTEGER AS n_keywords FROM analysis"))
def query_intent(spark, d):
    q = _t(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return analysis.analyze(q).select("qid", "intent", F.size("keywords").alias("n_keywords"))


@_register("expanded_terms", S.query([*_QA, S.EXPANSION], f"SELECT qid, {_JOINED('tokens', 'expanded', 'normal', 'terms')} FROM query_terms"))
def expanded_terms(spark, d):
    q = analysis.query_terms(_queries(spark))
    return q.select("qid", *[F.array_join(c, " ").alias(c) for c in ("tokens", "expanded", "normal", "terms")])


@_register("top_idf_terms", S.query(_QT, "SELECT qid, pos::INTEGER AS pos, term, df, n_terms::INTEGER AS n_terms, round(idf, 6) AS idf, boost, round(weight, 6) AS weight, round(entity, 6) AS entity, anchor FROM weighted_terms"))
def top_idf_terms(spark, d):
    s = _search(spark, d)
    return s.terms.select("qid", F.col("pos").cast("int").alias("pos"), "term", "df", "n_terms", R("idf"), "boost", R("weight"), R("entity"), "anchor")


# --- channels ---------------------------------------------------------------------------------

_TOP = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 6) AS score FROM {0} QUALIFY rank <= {1}"


def _ranked(df: DataFrame, k: int = 10) -> DataFrame:
    return channels.top(df, "score", k).select("qid", "rank", "doc_id", R("score"))


@_register("bm25f_topk", S.query([*_QT, S.EVERYONE, S.bm25_scores(S.bm25f())], _TOP.format("bm25", 10)))
def bm25f_topk(spark, d):
    return _ranked(_search(spark, d).bm25())


_OVER = dict(k1=1.6, b=(0.5, 1.0, 0.0, 0.3), weight=(2.0, 1.5, 2.0, 0.5))


@_register("bm25f_override", S.query([*_QT, S.EVERYONE, S.bm25_scores(S.bm25f(1.6, (0.5, 1.0, 0.0, 0.3), (2.0, 1.5, 2.0, 0.5)))], _TOP.format("bm25", 10)))
def bm25f_override(spark, d):
    return _ranked(_search(spark, d, Options(limit=LIMIT, all_platforms=True, bm25=OPEN.bm25.overridden(**_OVER))).bm25())


@_register("min_idf", S.query([*_QT, S.ELIGIBLE, S.bm25_scores(S.bm25f(), 2.0)], _TOP.format("bm25", 10)))
def min_idf(spark, d):
    return _ranked(_search(spark, d, Options(limit=LIMIT, bm25=OPEN.bm25.overridden(min_idf=2.0))).bm25())


@_register("bm25_topk", S.query([
    S.queries(DOC_QUERIES), f"toks AS MATERIALIZED (SELECT doc_id, {S.terms('text')} AS t FROM documents)", "lens AS (SELECT doc_id, len(t) AS dl FROM toks)",
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL)", "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    f"q AS (SELECT qid, unnest({S.terms('text')}) AS term FROM queries)", "tot AS (SELECT count(*) AS n, avg(dl) AS av FROM lens)",
    f"s AS (SELECT qid, doc_id, sum({S.IDF} * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), tot GROUP BY ALL)",
], _TOP.format("s", 10)))
def bm25_topk(spark, d):
    """BM25 over whole documents."""
    return _ranked(channels.text_bm25(_docs(spark, d).select("doc_id", "text"), _queries(spark, DOC_QUERIES), 10))


@_register("char_ngram_topk", S.query([S.DOCS, S.TOKENS, S.STATS, S.queries(QUERY_SET), S.ELIGIBLE, S.char_scores(LIMIT)], "SELECT qid, doc_id, round(score, 6) AS score FROM chars"))
def char_ngram_topk(spark, d):
    c = _corpus(spark, d)
    return channels.char_gram_scores(c, _queries(spark), Options(limit=LIMIT), len(QUERY_SET)).select("qid", "doc_id", R("score"))


@_register("tfidf_cosine_topk", S.query([S.DOCS, S.TFIDF, S.queries(QUERY_SET), S.SIMILARITIES], "SELECT qid, rank::INTEGER AS rank, doc_id, round(sim, 6) AS sim FROM sims WHERE rank <= 20"))
def tfidf_cosine_topk(spark, d):
    c = _corpus(spark, d)
    return channels.tfidf_similarities(c, _queries(spark), len(QUERY_SET), 20).select("qid", "rank", "doc_id", R("sim"))


@_register("nlp_search", S.query([S.DOCS, S.TFIDF, S.queries(QUERY_SET), S.SIMILARITIES], f"SELECT qid, rank::INTEGER AS rank, doc_id, round(sim * 100.0, 4) AS score FROM sims WHERE rank <= {LIMIT}"))
def nlp_search(spark, d):
    return channels.nlp_search(_corpus(spark, d), _queries(spark), len(QUERY_SET), LIMIT).select("qid", "rank", "doc_id", R("score", 4))


@_register("nlp_search_unindexed")
def nlp_search_unindexed(spark, d):
    """R34 without an index: its fallback joins in where TF-IDF finds fewer than five records."""
    return legacy.nlp_search(_corpus(spark, d), _queries(spark), Options(limit=LIMIT, use_fuzzy=False)).select("qid", "rank", "doc_id", R("score", 4))


@_register("tfidf_vocab_stats", S.query([S.DOCS, S.TFIDF], "SELECT (SELECT count(*) FROM vocabulary) AS vocabulary_size, (SELECT count(*) FROM docs) AS total_documents, round((SELECT count(*) FROM weights) / (SELECT count(*) FROM docs)::DOUBLE, 6) AS avg_terms"))
def tfidf_vocab_stats(spark, d):
    c = _corpus(spark, d)
    return C.vocabulary_stats(c.vocabulary, c.weights, c.totals["n"]).select("vocabulary_size", "total_documents", R("avg_terms"))


@_register("doc_tfidf_vocabulary", S.query([
    f"w1 AS MATERIALIZED (SELECT doc_id, {S.weighted('text')} AS w FROM documents)",
    "t AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM w1)", "n AS (SELECT count(*) AS n FROM documents)",
], "SELECT term, count(*) AS df, round(ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE, 6) AS idf FROM t, n GROUP BY term HAVING count(*) <= greatest(1, any_value(n) * 8 // 10)"))
def doc_tfidf_vocabulary(spark, d):
    docs = _docs(spark, d)
    tf = docs.select("doc_id", F.explode(F.array_distinct(X.single_weighted_terms(F.col("text")))).alias("term"))
    return C.tfidf_vocabulary(tf, docs.count()).select("term", "df", R("idf"))


_HYBRID = [*_QT, S.TFIDF, S.ELIGIBLE, S.bm25_scores(S.bm25f()), S.char_scores(LIMIT), S.SIMILARITIES, S.fused(LIMIT)]
_OPEN_HYBRID = [*_QT, S.TFIDF, S.EVERYONE, S.bm25_scores(S.bm25f()), S.char_scores(LIMIT), S.SIMILARITIES, S.fused(LIMIT)]


@_register("hybrid_fusion_topk", S.query(_HYBRID, _TOP.format("candidates", 20)))
def hybrid_fusion_topk(spark, d):
    return _ranked(_search(spark, d, Options(limit=LIMIT)).candidates(), 20)


# --- features -----------------------------------------------------------------------------------

_FEATURED = [*_OPEN_HYBRID, S.FAMILIES, S.COVERAGE, S.PROXIMITY, S.FEATURES]


def _featured(spark, d, *names: str) -> DataFrame:
    s = _search(spark, d)
    return s.featured(s.candidates(), names)


def _feature(name: str, *columns: str) -> None:
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @_register(name, S.query(_FEATURED, f"SELECT qid, doc_id, {picked} FROM scored"))
    def run(spark, d):
        return _featured(spark, d, *columns).select("qid", "doc_id", *[R(c) for c in columns])


_feature("coverage_boost", "coverage")
_feature("proximity_boost", "proximity")
_feature("intent_boost", "intent_boost", "together")
_feature("cascading_boost", "cascade")
_feature("long_intent_boost", "long_intent")


@_register("feature_scores", S.query(_FEATURED, "SELECT qid, doc_id, round(raw, 6) AS raw, round(family, 6) AS family, round(score, 4) AS score FROM scored"))
def feature_scores(spark, d):
    return _featured(spark, d, "score").select("qid", "doc_id", R("raw"), R("family"), R("score", 4))


@_register("family_prior", S.query([*_QT, S.FAMILIES], "SELECT qid, base, place::INTEGER AS place, round(family, 6) AS family FROM family_scores"))
def family_prior(spark, d):
    return _search(spark, d).families().select("qid", "base", "place", R("family"))


@_register("family_counts", S.query([*S.CORPUS, S.FAMILIES.split("asked AS")[0].rstrip().rstrip(",")], "SELECT token, base, c FROM family"))
def family_counts(spark, d):
    docs = part_records(spark, d)
    return C.family_counts(docs, C.field_tokens(docs))


_CLARITY = "clear AS (SELECT qid, n_terms, CASE WHEN count(*) <= 1 THEN 1.0 ELSE 1.0 - least(greatest(sum(-p * ln(p)) / ln(count(*)::DOUBLE), 0.0), 1.0) END AS clarity FROM (SELECT *, family / sum(family) OVER (PARTITION BY qid) AS p FROM family_scores) GROUP BY qid, n_terms)"


@_register("query_clarity", S.query([*_QT, S.FAMILIES, _CLARITY], "SELECT qid, round(clarity, 6) AS clarity, round(top, 6) AS top, round(margin, 6) AS margin FROM clear JOIN sure USING (qid)"))
def query_clarity(spark, d):
    f = _search(spark, d).families()
    return families.clarity(f).join(families.confidence(f), "qid").select("qid", R("clarity"), R("top"), R("margin"))


@_register("family_expansion", S.query([*_QT, S.FAMILIES, _CLARITY, S.ELIGIBLE], "SELECT f.qid, b.doc_id, round(least(25.0::DOUBLE * f.family * 0.3::DOUBLE, 25.0::DOUBLE), 6) AS bonus FROM family_scores f JOIN clear c USING (qid) JOIN bases b USING (base) JOIN eligible USING (doc_id) WHERE f.n_terms >= 10 AND f.place <= 2 AND c.clarity <= 0.95"))
def family_expansion(spark, d):
    s = _search(spark, d, Options(limit=LIMIT, family_expansion=True, family_bases=2, family_clarity=0.95, family_blend=0.3))
    return families.expansion_scores(s.corpus, s.families(), s.options).select("qid", "doc_id", R("bonus"))


@_register("universal_search", S.query([*_FEATURED, S.results(LIMIT)], "SELECT r.qid, r.rank, r.doc_id, r.score, d.command FROM results r JOIN docs d USING (doc_id)"))
def universal_search(spark, d):
    s = _search(spark, d)
    return s.results().join(s.corpus.docs.select("doc_id", "command"), "doc_id").select("qid", "rank", "doc_id", R("score", 4), "command")


@_register("platform_search", S.query([*_HYBRID, S.FAMILIES, S.COVERAGE, S.PROXIMITY, S.FEATURES, S.results(LIMIT)], "SELECT qid, rank, doc_id, score FROM results"))
def platform_search(spark, d):
    return _search(spark, d, Options(limit=LIMIT)).results().select("qid", "rank", "doc_id", R("score", 4))


# --- additive scorer and fallbacks ----------------------------------------------------------------


def _legacy_sql(final: str) -> str:
    from lexigrove import lexicon

    domain = "CASE word " + " ".join(f"WHEN {S.text(k)} THEN " + "(" + " OR ".join(f"cmd = {S.text(t)} OR starts_with(cmd, {S.text(t + ' ')})" for t in v) + ")" for k, v in lexicon.DOMAINS.items()) + " ELSE false END"
    tool = lambda n: f"(cmd = '{n}' OR starts_with(cmd, '{n} '))"
    finder, packages, mkdir = S.has_any("cmd", ["find", "locate", "grep"]), S.has_any("cmd", ["cargo", "conda"]), "starts_with(cmd, 'mkdir')"
    category = f"""CASE WHEN word IN ('compress', 'archive') THEN CASE WHEN {tool('tar')} OR {tool('zip')} OR {tool('gzip')} THEN 2.5 WHEN {finder} THEN 0.2 ELSE 1.0 END
      WHEN word = 'zip' THEN CASE WHEN {tool('zip')} THEN 3.0 WHEN {S.has_any('cmd', ['bzip', 'gzip'])} THEN 0.3 ELSE 1.0 END
      WHEN word = 'tar' THEN CASE WHEN {tool('tar')} THEN 3.0 ELSE 1.0 END
      WHEN word IN ('directory', 'folder') THEN CASE WHEN {mkdir} THEN 3.0 WHEN {packages} THEN 0.2 ELSE 1.0 END
      WHEN word = 'create' THEN CASE WHEN {mkdir} THEN 2.7 ELSE 1.0 END
      WHEN word = 'new' THEN CASE WHEN {mkdir} THEN 2.25 WHEN {packages} THEN 0.3 ELSE 1.0 END
      WHEN word IN ('search', 'find') THEN CASE WHEN {finder} THEN 1.3 ELSE 1.0 END
      WHEN word IN ('download', 'get') THEN CASE WHEN {S.has_any('cmd', ['wget', 'curl'])} THEN 1.4 ELSE 1.0 END ELSE 1.0 END::DOUBLE"""
    parts = [S.DOCS, S.queries(QUERY_SET), rf"""qw AS (SELECT qid, len(w) AS n_words, unnest(w) AS word FROM (SELECT qid, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM queries))""",
        """low AS (SELECT *, lower(command) AS cmd, lower(description) AS dsc, list_transform(keywords, lambda x: lower(x)) AS kw, list_transform(tags, lambda x: lower(x)) AS tg FROM docs)""",
        f"""ws AS MATERIALIZED (SELECT qid, n_words, word, low.*,
          (CASE WHEN cmd = word THEN 30.0 WHEN starts_with(cmd, word) THEN 22.5 WHEN contains(cmd, ' ' || word) THEN 10.0 WHEN contains(cmd, word) THEN 7.0 ELSE 0.0 END
          + CASE WHEN {domain} THEN 12.0 ELSE 0.0 END
          + CASE WHEN list_contains(kw, word) THEN 6.0 WHEN len(list_filter(kw, lambda x: contains(x, word))) > 0 THEN 1.0 ELSE 0.0 END
          + CASE WHEN contains(dsc, ' ' || word || ' ') OR starts_with(dsc, word || ' ') OR ends_with(dsc, ' ' || word) THEN 6.0 WHEN contains(dsc, word) THEN 3.6 ELSE 0.0 END
          + CASE WHEN list_contains(tg, word) THEN 5.0 WHEN len(list_filter(tg, lambda x: contains(x, word))) > 0 THEN 2.0 ELSE 0.0 END)::DOUBLE AS s,
          {category} AS cat FROM qw, low)""",
        """legacy AS (SELECT qid, doc_id, any_value(command) AS command, any_value(description) AS description, any_value(platform) AS platform, any_value(pipeline) AS pipeline,
          coalesce(sum(s) FILTER (WHERE strlen(word) >= 2), 0) * CASE WHEN any_value(n_words) > 1 AND count(*) FILTER (WHERE s > 0 AND strlen(word) >= 2) > 1 THEN 1.0 + (count(*) FILTER (WHERE s > 0 AND strlen(word) >= 2)) / any_value(n_words)::DOUBLE * 0.5::DOUBLE ELSE 1.0 END
          * (CASE WHEN max(s) FILTER (WHERE strlen(word) >= 2) >= 15 THEN 1.8 WHEN max(s) FILTER (WHERE strlen(word) >= 2) >= 10 THEN 1.4 ELSE 1.0 END)::DOUBLE * product(cat) AS score
          FROM ws GROUP BY qid, doc_id)"""]  # fmt: skip
    return S.query(parts, final)


@_register("legacy_score_topk", _legacy_sql(f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score * f, 6) DESC, doc_id)::INTEGER AS rank, doc_id, round(score * f, 6) AS score
 FROM (SELECT *, CASE WHEN len(list_filter(platform, lambda p: lower(p) IN ('linux', 'cross-platform'))) > 0 OR len(platform) = 0 THEN 1.0 WHEN {S.TOOL} THEN 0.9 END::DOUBLE AS f FROM legacy)
 WHERE f IS NOT NULL AND score * f > 0 QUALIFY rank <= 5"""))
def legacy_score_topk(spark, d):
    return legacy.legacy_search(part_records(spark, d), _queries(spark), Options(limit=LIMIT)).select("qid", "rank", "doc_id", R("score"))


@_register("pipeline_search", _legacy_sql(f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score * 2.0, 6) DESC, doc_id)::INTEGER AS rank, doc_id, round(score * 2.0, 6) AS score
 FROM legacy WHERE {S.PIPELINE} AND score > 0 QUALIFY rank <= 5"""))
def pipeline_search(spark, d):
    return legacy.pipeline_search(part_records(spark, d), _queries(spark)).select("qid", "rank", "doc_id", R("score"))


@_register("substring_recovery", S.query([S.DOCS, S.queries(QUERY_SET), r"""asked AS (SELECT qid, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM queries)""",
    """steps AS (SELECT qid, doc_id, CASE WHEN contains(lower(command), t) THEN 1 WHEN contains(lower(command), w[1]) OR contains(lower(description), w[1]) THEN 2
      WHEN len(list_filter(w, lambda x: strlen(x) >= 2 AND (contains(lower(command), x) OR contains(lower(description), x)))) > 0 THEN 3 END AS step FROM asked, docs)"""],
    "SELECT qid, doc_id, step::INTEGER AS step, (CASE step WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END)::DOUBLE AS score FROM steps WHERE step IS NOT NULL QUALIFY step = min(step) OVER (PARTITION BY qid)"))
def substring_recovery(spark, d):
    return legacy.recovery_search(part_records(spark, d), _queries(spark))


@_register("fuzzy_topk")
def fuzzy_topk(spark, d):
    return fuzzy.fuzzy_search(part_records(spark, d), _queries(spark), LIMIT).select("qid", "rank", "doc_id", "score")


@_register("suggestions")
def suggestions(spark, d):
    return fuzzy.suggestions(part_records(spark, d), spark.createDataFrame([(1, "wdgt"), (2, "rng"), (3, "anvl"), (4, "zzz")], "qid long, text string"))


@_register("exact_and_fuzzy")
def exact_and_fuzzy(spark, d):
    return legacy.exact_and_fuzzy(part_records(spark, d), _queries(spark)).select("qid", "rank", "doc_id", R("score"))


# --- vectors --------------------------------------------------------------------------------------

_DOT = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_COS = lambda a, b: f"CASE WHEN len({a}) = len({b}) AND {_DOT(a, a)} > 0 AND {_DOT(b, b)} > 0 THEN {_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)})) ELSE 0.0 END"


@_register("vector_cosine_topk", S.query([f"s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, {_COS('q.embedding', 'v.embedding')} AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"], "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, doc_id)::INTEGER AS rank, doc_id, round(sim, 6) AS sim FROM s QUALIFY rank <= 10"))
def vector_cosine_topk(spark, d):
    """The search set in full: every vector whose id is divisible by 20, against all vectors."""
    e = spread(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")))
    q = e.filter(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "qid")
    return vectors.cosine_top(q, e, 10).select("qid", "rank", "doc_id", R("sim"))


@_register("vector_normalized", f"SELECT vec_id, round({_DOT('embedding', 'embedding')}, 5) AS squared, round(embedding[1]::DOUBLE / sqrt({_DOT('embedding', 'embedding')}), 6) AS first FROM embeddings")
def vector_normalized(spark, d):
    v = F.col("embedding")
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.dot(v, v), 5).alias("squared"), F.round(V.normalized(v)[0], 6).alias("first"))


@_register("centroid_by_label", "SELECT label, i::INTEGER AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i")
def centroid_by_label(spark, d):
    return _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


_UNIT = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"


@_register("dominant_component_removed", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS doc_id, {_UNIT('e')} AS vec FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
cells AS (SELECT doc_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM v),
lines AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM cells a JOIN cells b USING (doc_id) GROUP BY ALL),
gram AS MATERIALIZED (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS line FROM lines GROUP BY i)),
turns(k, u) AS (
  SELECT 0, list_transform(m, lambda r: 1.0::DOUBLE / sqrt(len(m)::DOUBLE)) FROM gram
  UNION ALL SELECT k + 1, {_UNIT('w')} FROM (SELECT k, list_transform(m, lambda r: list_inner_product(r, u)) AS w FROM turns, gram WHERE k < {vectors.ROUNDS})),
less AS (SELECT doc_id, list_transform(list_zip(vec, u), lambda z: z[1] - along * z[2]) AS w FROM (SELECT doc_id, vec, u, list_inner_product(vec, u) AS along FROM v, turns WHERE k = {vectors.ROUNDS}))
SELECT doc_id, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest({_UNIT('w')}) AS x FROM less)""")
def dominant_component_removed(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.normalized(F.col("embedding")).alias("vec"))
    out = vectors.without_dominant(e, vectors.dominant_direction(e))
    return out.select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "i", R("x"))


def _word_vectors(spark, d) -> DataFrame:
    """The words of part names in the order of the alphabet; the vector of the n-th is the n-th embedding."""
    words = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    ranked = words.withColumn("rank", F.row_number().over(Window.orderBy("word")).cast("long") - 1)  # a vocabulary
    return ranked.join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("rank"), F.col("embedding").alias("vec")), "rank")


_EMBEDDED = [
    S.queries(QUERY_SET),
    "words AS MATERIALIZED (SELECT word, rank, embedding::DOUBLE[] AS vec FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS rank FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)) JOIN embeddings ON vec_id = rank)",
    r"said_words AS (SELECT qid, place, t[place] AS w FROM (SELECT qid, t, unnest(range(1, len(t) + 1)) AS place FROM (SELECT qid, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2) AS t FROM queries)))",
    """forms AS (SELECT qid, place, unnest([1, 2, 3, 4, 5]) AS nth, unnest([w, CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, length(w) - 3) END, CASE WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, length(w) - 2) END,
   CASE WHEN ends_with(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) END, CASE WHEN ends_with(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) END]) AS word FROM said_words)""",
    "known_words AS (SELECT qid, vec, 0.001::DOUBLE / (0.001::DOUBLE + (rank + 1) / (SELECT count(*) FROM words)::DOUBLE) * CASE WHEN regexp_matches(word, '[0-9]') THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN strlen(word) <= 2 THEN 0.85 ELSE 1.0 END::DOUBLE AS w FROM forms JOIN words USING (word) QUALIFY row_number() OVER (PARTITION BY qid, place ORDER BY nth) = 1)",
    "mean_parts AS (SELECT qid, i, sum(w * x) / sum(w) AS x FROM (SELECT qid, w, unnest(range(0, len(vec))) AS i, unnest(vec) AS x FROM known_words) GROUP BY ALL)",
    "query_units AS MATERIALIZED (SELECT qid, i, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS x FROM mean_parts)",
]


@_register("query_vectors", S.query(_EMBEDDED, "SELECT qid, i::INTEGER AS i, round(x, 6) AS x FROM query_units"))
def query_vectors(spark, d):
    """J5, R23, R24"""
    return vectors.embed_queries(_queries(spark), _word_vectors(spark, d)).select("qid", F.posexplode("vec").alias("i", "x")).select("qid", "i", R("x"))


@_register("vector_channel", S.query([S.DOCS, S.ELIGIBLE, *_EMBEDDED, "asked_units AS (SELECT qid, list(x ORDER BY i) AS u FROM query_units GROUP BY qid)", f"near_records AS (SELECT qid, vec_id AS doc_id, {_COS('u', 'embedding')} AS sim FROM asked_units, embeddings)"],
    "SELECT qid, doc_id, round(sim * 45.0, 4) AS score FROM near_records JOIN eligible USING (doc_id) WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, doc_id) <= 15"))
def vector_channel(spark, d):
    """A record's vector is the embedding of its id; all similarities of the stated queries go through the channel."""
    corpus, e = _corpus(spark, d), _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    sims = vectors.query_similarities(_queries(spark), _word_vectors(spark, d), e, e.count())
    return channels.vector_scores(corpus, sims, Options(limit=LIMIT)).select("qid", "doc_id", R("score", 4))


# --- evaluation -------------------------------------------------------------------------------------


def _quotes(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(qid, doc_id): documents (doc_id, text) that hold ``most`` words of an item (qid, text) in a row; an item of fewer words, but not none, counts whole. Whole texts, any case, any place."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))
    sized = items.select("qid", words(F.col("text")).alias("w")).withColumn("k", F.least(F.size("w"), F.lit(most))).filter("k > 0")
    own = sized.select("qid", "k", F.explode(runs(F.col("w"), F.col("k"))).alias("run")).distinct().persist()
    n = own.count()
    ends = lambda w, k: F.xxhash64(F.get(w, F.lit(0)), F.get(w, k - 1))
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect())  # ``most`` at most
    if n <= channels.CONSTANTS:
        heads: dict[int, list[int]] = {k: [] for k in lengths}
        for k, h in own.select("k", ends(F.split("run", " "), F.col("k")).alias("h")).distinct().collect():
            heads[k].append(h)

    def held(k: int) -> Column:
        """A text's runs of k words. Where the items' runs are few, only those whose first and last word are a run's become strings."""
        if n > channels.CONSTANTS:
            return F.coalesce(runs(F.col("w"), F.lit(k)), F.array().cast("array<string>"))
        passed = f"filter(sequence(1, size(w) - {k - 1}), i -> xxhash64(get(w, i - 1), get(w, i + {k - 2})) IN ({', '.join(f'{h}L' for h in heads[k])}))"
        return F.expr(f"CASE WHEN size(w) >= {k} THEN transform({passed}, i -> array_join(slice(w, i, {k}), ' ')) ELSE cast(array() AS array<string>) END")

    wordy = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = F.array_distinct(F.concat(*[held(k) for k in lengths])) if lengths else F.array().cast("array<string>")
    return wordy.select("doc_id", F.explode(found).alias("run")).join(channels.bounded(own.select("qid", "run"), n), "run").select("qid", "doc_id").distinct()


def _judged(spark, d, k: int = 5) -> DataFrame:
    """benchmark items as queries over documents; relevant: documents that quote ten words of the item in a row; slice: the item's id modulo 4. Items that no document quotes stay, with none relevant."""
    docs = _docs(spark, d).select("doc_id", "text")
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", F.concat(F.lit("s"), (F.col("item_id") % 4).cast("string")).alias("slice"))
    best = channels.text_bm25(docs, items.select("qid", "text"), k).select("qid", "rank", "doc_id")
    quotes = _quotes(docs, items.select("qid", "text")).persist()
    holds = best.join(quotes.withColumn("hit", F.lit(True)), ["qid", "doc_id"], "left").select("qid", "rank", F.coalesce("hit", F.lit(False)).alias("hit"))
    known = quotes.groupBy("qid").agg(F.count("*").cast("int").alias("n_relevant"))
    return items.select("qid", "slice").join(known, "qid", "left").fillna(0, ["n_relevant"]).join(holds, "qid", "left")


_WORDS = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

_JUDGED = [
    f"toks AS MATERIALIZED (SELECT doc_id, {S.terms('text')} AS t FROM documents)", "lens AS (SELECT doc_id, len(t) AS dl FROM toks)",
    "tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL)", "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    f"q AS (SELECT item_id AS qid, unnest({S.terms('text')}) AS term FROM benchmark)", "tot AS (SELECT count(*) AS n, avg(dl) AS av FROM lens)",
    f"s AS (SELECT qid, doc_id, sum({S.IDF} * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), tot GROUP BY ALL)",
    "best AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank, doc_id FROM s QUALIFY rank <= 5)",
    f"item_words AS (SELECT item_id AS qid, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS('text')} AS w FROM benchmark) WHERE len(w) > 0)",
    "item_runs AS (SELECT DISTINCT qid, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM item_words))",
    f"doc_words AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents)",
    "doc_runs AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_words) WHERE len(w) >= k))",
    "quotes AS MATERIALIZED (SELECT DISTINCT qid, doc_id FROM doc_runs JOIN item_runs USING (run))",
    "known AS (SELECT item_id AS qid, 's' || (item_id % 4) AS slice, (SELECT count(*) FROM quotes q WHERE q.qid = item_id) AS n_relevant FROM benchmark)",
    "judged AS (SELECT k.*, b.rank, x.doc_id IS NOT NULL AS hit FROM known k LEFT JOIN best b USING (qid) LEFT JOIN quotes x ON x.qid = k.qid AND x.doc_id = b.doc_id)",
    "gains AS (SELECT qid, slice, n_relevant, coalesce(min(rank) FILTER (WHERE hit), 0) AS first, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE hit AND rank <= 3), 0) AS dcg FROM judged GROUP BY ALL)",
    "scored AS (SELECT *, CASE WHEN first > 0 THEN 1.0 / first ELSE 0.0 END AS rr, (first = 1)::INTEGER::DOUBLE AS top1, (first BETWEEN 1 AND 3)::INTEGER::DOUBLE AS hit, CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(3, n_relevant) + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END AS ndcg_ref FROM gains)",
]


@_register("ndcg_at_k", S.query(_JUDGED, "SELECT qid, first::INTEGER AS first, round(rr, 6) AS rr, top1, hit, round(ndcg_ref, 6) AS ndcg_ref, round(least(ndcg_ref, 1.0), 6) AS ndcg FROM scored"))
def ndcg_at_k(spark, d):
    return evaluate.per_query(_judged(spark, d)).select("qid", F.col("first").cast("int").alias("first"), R("rr"), "top1", "hit", R("ndcg_ref"), R("ndcg"))


@_register("eval_by_slice", S.query(_JUDGED, "SELECT coalesce(slice, '(all)') AS slice, count(*) AS n, round(avg(top1), 6) AS top1, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr, round(avg(ndcg_ref), 6) AS ndcg_ref, round(avg(least(ndcg_ref, 1.0)), 6) AS ndcg FROM scored GROUP BY ROLLUP (slice)"))
def eval_by_slice(spark, d):
    return evaluate.summarised(evaluate.per_query(_judged(spark, d))).select("slice", "n", *[R(c) for c in ("top1", "hit", "mrr", "ndcg_ref", "ndcg")])


_SET = [(1, "small ring", "short", ["small"]), (2, "red widget", "short", ["red widget"]), (3, "old gear", "", ["old", "gear"]), (4, "cold plate for standard brand", "long", ["cold plate"])]


_MEANS = "count(*) AS n, round(avg(top1), 6) AS top1, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr, round(avg(ndcg_ref), 6) AS ndcg_ref"
_SET_TABLE = S.table("judgements", "qid, slice, n_relevant, prefix", [f"({q}::BIGINT, {S.text(at or 'unspecified')}, {len(prefixes)}, {S.text(p)})" for q, _, at, prefixes in _SET for p in prefixes])
_SPLIT = lambda c: rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
_PREFIX = f"starts_with(lower(trim(d.command)), j.prefix) OR ({_SPLIT('lower(trim(d.command))')})[1:len({_SPLIT('j.prefix')})] = {_SPLIT('j.prefix')}"
_BOUNDARY = "lower(trim(d.command)) = j.prefix OR starts_with(lower(trim(d.command)), j.prefix || ' ')"


def _evaluated(params: str, fits: str) -> list[str]:
    """SQL parts: the search of _SET with these BM25 parameters, and its measures per query, ``measured``."""
    return [
        *S.CORPUS, S.queries([(q, t) for q, t, _, _ in _SET]), S.LEXICON, S.ANALYSIS, S.EXPANSION, S.CAP, S.TFIDF, S.EVERYONE, S.bm25_scores(params), S.char_scores(LIMIT), S.SIMILARITIES, S.fused(LIMIT),
        S.FAMILIES, S.COVERAGE, S.PROXIMITY, S.FEATURES, S.results(LIMIT), _SET_TABLE,
        f"ranked_hits AS (SELECT j.qid, j.slice, j.n_relevant, r.rank, bool_or({fits}) AS hit FROM judgements j LEFT JOIN results r USING (qid) LEFT JOIN docs d USING (doc_id) GROUP BY ALL)",
        "rank_gains AS (SELECT qid, slice, n_relevant, coalesce(min(rank) FILTER (WHERE hit), 0) AS first, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE hit AND rank <= 3), 0) AS dcg FROM ranked_hits GROUP BY ALL)",
        "measured AS (SELECT *, CASE WHEN first > 0 THEN 1.0 / first ELSE 0.0 END AS rr, (first = 1)::INTEGER::DOUBLE AS top1, (first BETWEEN 1 AND 3)::INTEGER::DOUBLE AS hit, dcg / list_sum(list_transform(range(1, least(3, n_relevant) + 1), lambda i: 1.0 / log2(i + 1.0))) AS ndcg_ref FROM rank_gains)",
    ]


@_register("search_evaluation", S.query(_evaluated(S.bm25f(), _PREFIX), f"SELECT coalesce(slice, '(all)') AS slice, {_MEANS}, round(avg(least(ndcg_ref, 1.0)), 6) AS ndcg FROM measured GROUP BY ROLLUP (slice)"))
def search_evaluation(spark, d):
    q = spark.createDataFrame(_SET, "qid long, text string, slice string, relevant array<string>")
    return evaluate.summarised(evaluate.evaluate(_corpus(spark, d), q, OPEN)).select("slice", "n", *[R(c) for c in ("top1", "hit", "mrr", "ndcg_ref", "ndcg")])


_AXES = dict(k1=[0.9, 1.2], w_cmd=[2.0, 3.5])
_SWEPT = " UNION ALL ".join(
    f"SELECT * FROM ({S.query(_evaluated(S.bm25f(k1, w=(w, 1.0, 2.0, 1.2)), _BOUNDARY), f'SELECT {at}::INTEGER AS config, {_MEANS} FROM measured')})" for at, (k1, w) in enumerate((k1, w) for k1 in _AXES["k1"] for w in _AXES["w_cmd"])
)


@_register("sweep_grid", f"SELECT row_number() OVER (ORDER BY ndcg_ref DESC, hit DESC, top1 DESC, config)::INTEGER AS place, * FROM ({_SWEPT})")
def sweep_grid(spark, d):
    q = spark.createDataFrame(_SET, "qid long, text string, slice string, relevant array<string>")
    return evaluate.sweep(_corpus(spark, d), q, evaluate.grid(OPEN, **_AXES)).select("place", "config", "n", *[R(c) for c in ("top1", "hit", "mrr", "ndcg_ref")])


@_register("eval_worst", S.query(_JUDGED, "SELECT qid, round(rr, 6) AS rr FROM scored ORDER BY scored.rr, qid LIMIT 15"))
def eval_worst(spark, d):
    return evaluate.worst(evaluate.per_query(_judged(spark, d))).select("qid", R("rr"))


@_register("eval_failures", S.query(_JUDGED, "SELECT metric, round(value, 6) AS value, floor FROM (SELECT unnest([{'metric': 'top1', 'value': avg(top1), 'floor': 0.9::DOUBLE}, {'metric': 'hit', 'value': avg(hit), 'floor': 0.0::DOUBLE}, {'metric': 'mrr', 'value': avg(rr), 'floor': 0.95::DOUBLE}], recursive := true) FROM scored) WHERE value < floor"))
def eval_failures(spark, d):
    return evaluate.failures(evaluate.summarised(evaluate.per_query(_judged(spark, d))), top1=0.9, hit=0.0, mrr=0.95).select("metric", R("value"), "floor")


# --- history ----------------------------------------------------------------------------------------


@_register("history_top", S.query([LOG_SQL], "SELECT query, count(*) AS count, max(ts) AS last_used FROM log GROUP BY query ORDER BY count DESC, last_used DESC, query LIMIT 3"))
def history_top(spark, d):
    return history.top_queries(_log(spark, d), 3)


@_register("history_recent", S.query([LOG_SQL], "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY max(seq) DESC)::INTEGER AS rank, query FROM log GROUP BY user_id, query QUALIFY rank <= 3"))
def history_recent(spark, d):
    return history.recent_queries(_log(spark, d), 3)


@_register("history_stats", S.query([LOG_SQL], "SELECT user_id, count(*) AS total, count(DISTINCT query) AS different, round(avg(results_count), 6) AS avg_results, round(coalesce(avg(duration_ms) FILTER (WHERE duration_ms > 0), 0), 6) AS avg_duration_ms, arg_min(ts, seq) AS oldest, arg_max(ts, seq) AS newest FROM log GROUP BY user_id"))
def history_stats(spark, d):
    return history.stats(_log(spark, d), ["user_id"]).select("user_id", "total", "different", R("avg_results"), R("avg_duration_ms"), "oldest", "newest")


@_register("history_collapse", S.query([LOG_SQL, "c AS (SELECT * FROM log QUALIFY coalesce(lead(query) OVER (PARTITION BY user_id ORDER BY seq), '') <> query)"], "SELECT user_id, seq::INTEGER AS seq, query FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 20"))
def history_collapse(spark, d):
    return history.kept(_log(spark, d), 20).select("user_id", "seq", "query")


@_register("history_pattern", S.query([LOG_SQL], "SELECT user_id, ts, query FROM log WHERE contains(lower(query), 'ur')"))
def history_pattern(spark, d):
    return history.matching(_log(spark, d), "UR").select("user_id", "ts", "query")


@_register("history_age", "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 2592000 THEN (s // 604800) || ' week' || CASE WHEN s // 604800 = 1 THEN '' ELSE 's' END || ' ago' ELSE (s // 2592000) || ' month' || CASE WHEN s // 2592000 = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-02-10 00:00:00') // 1000000 - epoch_us(ts) // 1000000 AS s FROM events)")
def history_age(spark, d):
    now = F.to_timestamp(F.lit("2024-02-10 00:00:00"))
    return _t(spark, d, "events").select("event_id", history.time_ago(F.col("ts"), now).alias("age"))


# --- metrics ------------------------------------------------------------------------------------------


def _metrics(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_type").alias("name"), "value", "ts")


_BUCKETS = "buckets AS (SELECT event_type AS name, " + "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(metrics.BOUNDS)) + f" ELSE {len(metrics.BOUNDS)} END AS bucket, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)"


@_register("metric_counters", "SELECT event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def metric_counters(spark, d):
    return metrics.counters(_metrics(spark, d), ["name"]).select("name", R("value", 4))


@_register("metric_gauge_last", "SELECT event_type AS name, trunc(arg_max(value, (ts, value)) * 1000) / 1000.0 AS value FROM events GROUP BY event_type")
def metric_gauge_last(spark, d):
    return metrics.gauges(_metrics(spark, d), ["name"])


@_register("metric_histogram", S.query([_BUCKETS], "SELECT name, bucket::INTEGER AS bucket, n, round(total, 4) AS total FROM buckets"))
def metric_histogram(spark, d):
    return metrics.histogram(_metrics(spark, d), ["name"]).select("name", "bucket", "n", R("total", 4))


_BOUND_LIST = "[" + ", ".join(str(b) for b in metrics.BOUNDS) + "]::DOUBLE[]"


_POINTS = ["r AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY name) AS everything FROM buckets)", "p AS (SELECT unnest([50, 90, 95, 99]) AS p)",
    f"points AS (SELECT name, p::INTEGER AS p, CASE WHEN floor(any_value(everything) * p / 100) = 0 THEN {metrics.BOUNDS[0]} ELSE min(({_BOUND_LIST})[least(bucket + 1, {len(metrics.BOUNDS)})]) FILTER (WHERE upto >= floor(everything * p / 100)) END AS value FROM r, p GROUP BY name, p)"]


@_register("metric_percentiles", S.query([_BUCKETS, *_POINTS], "SELECT name, p, value FROM points"))
def metric_percentiles(spark, d):
    return metrics.percentiles(metrics.histogram(_metrics(spark, d), ["name"]), ["name"], [50, 90, 95, 99])


@_register("metric_export", S.query([_BUCKETS, *_POINTS], """SELECT name, round(value, 4) AS value FROM (
  SELECT event_type AS name, sum(value) AS value FROM events GROUP BY ALL UNION ALL SELECT event_type, trunc(arg_max(value, (ts, value)) * 1000) / 1000.0 FROM events GROUP BY ALL
  UNION ALL SELECT name || '_count', sum(n)::DOUBLE FROM buckets GROUP BY name UNION ALL SELECT name || '_sum', sum(total) FROM buckets GROUP BY name
  UNION ALL SELECT name || '_mean', sum(total) / sum(n) FROM buckets GROUP BY name UNION ALL SELECT name || '_p' || p, value FROM points)"""))
def metric_export(spark, d):
    m = _metrics(spark, d)
    return metrics.exported(metrics.counters(m, ["name"]), metrics.gauges(m, ["name"]), metrics.histogram(m, ["name"])).select("name", R("value", 4))


_MONITORED = {"click": "cache_hits_total", "error": "cache_misses_total", "signup": "searches_total", "view": "system_uptime"}


@_register("metric_derived", """WITH v AS (SELECT event_type AS name, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT any_value(total) FILTER (WHERE name = 'click') AS hits,
  any_value(total) FILTER (WHERE name = 'error') AS misses, any_value(total) FILTER (WHERE name = 'signup') AS searches, any_value(total) FILTER (WHERE name = 'view') AS uptime, any_value(total / n) FILTER (WHERE name = 'purchase') AS mean FROM v)
  SELECT round(hits / (hits + misses), 6) AS hit_ratio, round(searches / uptime, 6) AS searches_per_second, round(mean, 6) AS mean_search_ms FROM t""")
def metric_derived(spark, d):
    """Four event types as totals, purchases as search times."""
    m = _metrics(spark, d)
    named = F.create_map(*[F.lit(x) for kv in _MONITORED.items() for x in kv])[F.col("name")]
    totals = metrics.counters(m.withColumn("name", named).filter("name is not null"), ["name"])
    times = metrics.histogram(m.filter("name = 'purchase'").withColumn("name", F.lit("search_duration")), ["name"])
    return metrics.derived(metrics.exported(totals, totals.limit(0), times)).select(R("hit_ratio"), R("searches_per_second"), R("mean_search_ms"))


@_register("query_latency", "SELECT event_type AS query, count(*) AS iterations, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(sum((user_id % 2 = 0)::INTEGER) / (count(*) - 1)::DOUBLE, 6) AS hit_ratio FROM events GROUP BY event_type")
def query_latency(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_type").alias("query"), "value", (F.col("user_id") % 2 == 0).alias("hit"))
    return metrics.latency(rows).select("query", "iterations", R("avg"), "min", "max", R("hit_ratio"))


# --- ingestion, sanitising, projects ------------------------------------------------------------------


@_register("upsert_union", """WITH a AS (SELECT c_custkey AS doc_id, c_name AS command, c_mktsegment AS description FROM customer UNION ALL SELECT -s_suppkey, s_name, 'old' FROM supplier),
  b AS (SELECT c_custkey AS doc_id, c_name AS command, 'new ' || c_mktsegment AS description FROM customer UNION ALL SELECT p_partkey, p_name, 'new' FROM part),
  ids AS (SELECT command, min(doc_id) AS old_id FROM a GROUP BY command)
  SELECT doc_id, command, description FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.command = a.command)
  UNION ALL SELECT coalesce(ids.old_id, (SELECT max(doc_id) FROM a) + 1 + b.doc_id), b.command, b.description FROM b LEFT JOIN ids USING (command)""")
def upsert_union(spark, d):
    """Whole tables: all customers are replaced, all suppliers stay, all parts are added."""
    c, s, p = (_t(spark, d, t) for t in ("customer", "supplier", "part"))
    row = lambda df, key, name, said: df.select(key.alias("doc_id"), F.col(name).alias("command"), said.alias("description"))
    old = row(c, F.col("c_custkey"), "c_name", F.col("c_mktsegment")).unionByName(row(s, -F.col("s_suppkey"), "s_name", F.lit("old")))
    new = row(c, F.col("c_custkey"), "c_name", F.concat(F.lit("new "), "c_mktsegment")).unionByName(row(p, F.col("p_partkey"), "p_name", F.lit("new")))
    return records.upsert(old, new).select("doc_id", "command", "description")


@_register("personal_union", "SELECT p_partkey AS doc_id, p_name AS command FROM part UNION ALL SELECT s_suppkey + 1 + (SELECT max(p_partkey) FROM part), s_name FROM supplier")
def personal_union(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("command"))
    return _corpus(spark, d).with_personal(s).docs.select("doc_id", "command")


@_register("dedup_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_first(spark, d):
    """First of equal texts: 16-byte digests are grouped, not the texts."""
    key = F.md5(F.col("text").cast("binary"))
    return _t(spark, d, "documents").select("doc_id", key.alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@_register("page_parse", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars,
  regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host FROM pages""")
def page_parse(spark, d):
    return _t(spark, d, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"), F.length(pages.html_text(F.col("html"))).cast("long").alias("n_chars"), pages.host(F.col("url")).alias("host"))


@_register("page_links", """SELECT page_id, l.target AS target, l.label AS label FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) AS z FROM pages), LATERAL (SELECT z[1] AS target, z[2] AS label) l""")
def page_links(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(pages.html_links(F.col("html"))).alias("l")).select("page_id", "l.target", "l.label")


def _manuals(spark, d) -> DataFrame:
    """Manual pages in Markdown of all parts: name, type and brand, two examples."""
    content = F.concat(F.lit("# "), "p_name", F.lit("\n\n> "), "p_type", F.lit(" See `"), "p_brand", F.lit(" --all`.\n\n- Create the "), "p_type", F.lit(":\n\n`"), "p_name", F.lit(" --make {{x}}`\n\n- Remove it:\n\n`"), "p_name", F.lit(" -r`\n"))
    folder = F.when(F.col("p_size") % 3 == 0, "common").when(F.col("p_size") % 3 == 1, "osx").otherwise("other")
    return _t(spark, d, "part").select(folder.alias("folder"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"), content.alias("content"))


@_register("page_records", """SELECT p_name AS command, arg_min(p_type || ' See `' || p_brand || ' --all`.', p_partkey) AS description, string_split(p_name, ' ')[1] AS niche,
  array_to_string(list_sort(list_distinct(flatten(list(CASE p_size % 3 WHEN 0 THEN ['linux', 'macos', 'windows'] WHEN 1 THEN ['macos'] ELSE [] END)))), ' ') AS platform FROM part GROUP BY p_name""")
def page_records(spark, d):
    """S31, S33, S36, S38"""
    return pages.merged(_manuals(spark, d)).select("command", "description", "niche", F.array_join("platform", " ").alias("platform"))


@_register("page_examples", """SELECT p_partkey, 'Create the ' || p_type AS text, p_name || ' --make {{x}}' AS command FROM part UNION ALL SELECT p_partkey, 'Remove it', p_name || ' -r' FROM part""")
def page_examples(spark, d):
    """S32"""
    rows = _manuals(spark, d).select(F.col("path").cast("long").alias("p_partkey"), F.explode(pages.examples(F.col("content"))).alias("e"))
    return rows.select("p_partkey", "e.text", "e.command")


@_register("page_aliases", """SELECT p_partkey, family, array_to_string(CASE WHEN other = family THEN [] ELSE [other] END, ' ') AS aliases FROM (SELECT p_partkey, trim(lower(regexp_replace(string_split(p_name, ' ')[1], '[^a-zA-Z0-9_-]', '', 'g')), '-_') AS family,
  trim(lower(regexp_replace(string_split(p_brand, ' ')[1], '[^a-zA-Z0-9_-]', '', 'g')), '-_') AS other FROM part)""")
def page_aliases(spark, d):
    """S36, S37"""
    name = F.col("p_name")
    said = F.concat(F.lit("See `"), "p_brand", F.lit(" --all` or `a b c d`."))
    return _t(spark, d, "part").select("p_partkey", pages.family(name).alias("family"), F.array_join(pages.aliases(said, name), " ").alias("aliases"))


def _page_words_sql() -> str:
    from lexigrove import lexicon

    tok = "trim(lower(regexp_replace(w, '[^a-zA-Z0-9_-]', '', 'g')), '-_')"
    return rf"""SELECT page_id, word FROM (SELECT DISTINCT page_id, {tok} AS word FROM (SELECT page_id, unnest(regexp_split_to_array(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[^a-zA-Z0-9_-]+')) AS w FROM pages)) WHERE length(word) >= 3 AND NOT {S.one_of('word', lexicon.PAGE_STOP_WORDS)}"""


@_register("page_words", _page_words_sql())
def page_words(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(pages.words(pages.html_title(F.col("html")))).alias("word"))


@_register("pii_mask", f"SELECT doc_id, {S.mask('text')} AS masked FROM documents")
def pii_mask(spark, d):
    return _docs(spark, d).select("doc_id", sanitize.mask(F.col("text")).alias("masked"))


@_register("input_sanitize", f"SELECT doc_id, {S.sanitized('text')} AS clean FROM documents")
def input_sanitize(spark, d):
    return _docs(spark, d).select("doc_id", sanitize.sanitize_input(F.col("text")).alias("clean"))


@_register("filename_sanitize", r"""SELECT page_id, regexp_replace(translate(url, '/\:*?"<>|', '_________'), '^[ .]+|[ .]+$', '', 'g') AS filename, substr(replace(url, '..', '_'), 1, 4096) AS path FROM pages""")
def filename_sanitize(spark, d):
    return _t(spark, d, "pages").select("page_id", sanitize.sanitize_filename(F.col("url")).alias("filename"), sanitize.sanitize_path(F.col("url")).alias("path"))


@_register("query_validate", r"""SELECT page_id, CASE WHEN trim(regexp_replace(url, '\s+', ' ', 'g')) = '' THEN 'empty' WHEN strlen(url) > 1000 THEN 'too_long' WHEN regexp_matches(url, '[<>|&;$]') THEN 'invalid_characters' END AS error FROM pages""")
def query_validate(spark, d):
    return _t(spark, d, "pages").select("page_id", sanitize.query_error(F.col("url")).alias("error"))


_FILES = [(1, "go.mod", None), (1, ".git", None), (1, "Makefile", "build: x\n\tgo build\n.PHONY: all\nA = b:c\n# c: d\ntest:\n"), (2, "package.json", '{"scripts": {"dev": "vite", "lint": "eslint"}}'), (2, "Dockerfile", None), (3, "readme.txt", None), (4, "main.tf", None), (4, "k8s-deploy.yaml", None), (4, "requirements.txt", None)]


def _project_parts() -> list[str]:
    from lexigrove import lexicon

    rules = S.table("rules", "nth, type, pattern, language, build", [f"({i}, {S.text(t)}, {S.text(p)}, {S.text(lang) if lang else 'NULL'}, {S.text(b) if b else 'NULL'})" for i, (t, p, lang, b) in enumerate(lexicon.PROJECT_FILES)])
    files = S.table("files", "project_id, filename", [f"({p}::BIGINT, {S.text(f)})" for p, f, _ in _FILES])
    return [rules, files, "hits AS (SELECT f.*, r.* FROM files f JOIN rules r ON regexp_matches(f.filename, r.pattern))", "firsts AS (SELECT project_id, type, min((filename, nth)) AS spot FROM hits GROUP BY ALL)"]


def _projects_sql() -> str:
    return S.query(_project_parts(),
        """SELECT p.project_id, coalesce((SELECT string_agg(type, ' ' ORDER BY spot) FROM firsts f WHERE f.project_id = p.project_id), 'generic') AS types,
           coalesce((SELECT arg_min(language, (filename, nth)) FROM hits h WHERE h.project_id = p.project_id AND language IS NOT NULL), '') AS language FROM (SELECT DISTINCT project_id FROM files) p""")  # fmt: skip


@_register("project_context", _projects_sql())
def project_context(spark, d):
    files = spark.createDataFrame(_FILES, "project_id long, filename string, content string")
    return projects.contexts(files).select("project_id", F.array_join("types", " ").alias("types"), "language")


_CONTENTS = S.table("contents", "project_id, filename, content", [f"({p}::BIGINT, {S.text(f)}, {S.text(c)})" for p, f, c in _FILES if c])
_SCRIPTS = "scripts AS (SELECT project_id, unnest(json_keys(content::JSON -> '$.scripts')) AS term FROM contents WHERE filename = 'package.json')"
_TARGETS = """targets AS (SELECT project_id, term FROM (SELECT project_id, trim(string_split(line, ':')[1]) AS term FROM (SELECT project_id, trim(unnest(string_split(content, chr(10)))) AS line FROM contents WHERE lower(filename) = 'makefile')
  WHERE contains(line, ':') AND NOT starts_with(line, '#')) WHERE term <> '' AND NOT contains(term, '=') AND NOT starts_with(term, '.'))"""


def _files(spark) -> DataFrame:
    return spark.createDataFrame(_FILES, "project_id long, filename string, content string")


def _boosts_sql() -> str:
    from lexigrove import lexicon

    boosts = S.table("boosts", "type, term, boost", [f"({S.text(t)}, {S.text(k)}, {v}::DOUBLE)" for t, b in lexicon.PROJECT_BOOSTS.items() for k, v in b.items()])
    typed = """typed AS (SELECT project_id, type, row_number() OVER (PARTITION BY project_id ORDER BY spot) AS place FROM firsts
  UNION ALL SELECT DISTINCT project_id, 'generic', 1 FROM files WHERE project_id NOT IN (SELECT project_id FROM firsts))"""
    own = "own AS (SELECT * FROM scripts UNION ALL SELECT * FROM targets)"
    return S.query([*_project_parts(), boosts, _CONTENTS, _SCRIPTS, _TARGETS, typed, own],
        f"SELECT project_id, term, boost FROM (SELECT project_id, term, boost, place FROM typed JOIN boosts USING (type) UNION ALL SELECT project_id, term, {projects.LISTED}::DOUBLE, 1000 FROM own) QUALIFY row_number() OVER (PARTITION BY project_id, term ORDER BY place DESC) = 1")


@_register("project_boosts", _boosts_sql())
def project_boosts(spark, d):
    return projects.context_boosts(_files(spark))


@_register("package_scripts", S.query([_CONTENTS, _SCRIPTS], "SELECT project_id, term FROM scripts"))
def package_scripts(spark, d):
    return projects.package_scripts(_files(spark))


@_register("make_targets", S.query([_CONTENTS, _TARGETS], "SELECT project_id, term FROM targets"))
def make_targets(spark, d):
    return projects.make_targets(_files(spark))


@_register("pipeline_steps", S.query([S.DOCS], "SELECT doc_id, i::INTEGER AS step, trim(p[i]) AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(command || ' | sort | ' || niche, '|') AS p FROM docs))"))
def pipeline_steps(spark, d):
    r = part_records(spark, d).withColumn("command", F.concat_ws(" | ", "command", F.lit("sort"), "niche"))
    return r.select("doc_id", F.posexplode(presentation.pipeline_steps(F.col("command"))).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("step"), "text")


# --- extensions: search results joined with ordinary tables, windows over events -------------------------


@_register("search_revenue", S.query([*_FEATURED, S.results(LIMIT), "wanted AS (SELECT qid, doc_id FROM results)"], "SELECT w.qid, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM wanted w JOIN lineitem ON l_partkey = w.doc_id GROUP BY w.qid"))
def search_revenue(spark, d):
    """Extension: revenue of the parts that a query finds. The results are a bounded set, so the fact table is filtered where it is scanned."""
    found = _search(spark, d).results().select("qid", "doc_id")
    lines = _t(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_discount")
    j = lines.join(F.broadcast(found), F.col("l_partkey") == F.col("doc_id"))
    return j.groupBy("qid").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@_register("events_hourly", "SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, d):
    """Extension: the batch form of streaming.events.windowed_metrics()."""
    w = _metrics(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "name", "n", R("total", 4))
