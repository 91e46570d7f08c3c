"""Behaviour of searches on a few hand-made records."""

import pytest

from lexigrove.operators import channels, evaluate, features, fuzzy, legacy
from lexigrove.operators.corpus import Corpus
from lexigrove.operators.search import Search, search
from lexigrove.options import Bm25, Options

SCHEMA = "doc_id long, command string, description string, keywords array<string>, platform array<string>, pipeline boolean"
ROWS = [
    (0, "git commit", "save changes to the repository", ["git", "commit"], [], False),
    (1, "find", "find files by name in a directory", ["find", "files"], ["linux"], False),
    (2, "tar", "create a compressed archive", ["tar", "archive", "compress"], ["linux", "macos"], False),
    (3, "ls | grep x", "list and filter", ["list"], ["linux"], True),
    (4, "status win", "show status", ["status"], ["windows"], False),
    (5, "status lin", "show status", ["status"], ["linux"], False),
    (6, "status all", "show status", ["status"], ["cross-platform"], False),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.of(spark.createDataFrame(ROWS, SCHEMA))


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def ids(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_best_match_comes_first(spark, corpus):
    rows = search(corpus, ask(spark, "git commit"), Options(limit=5)).orderBy("rank").collect()
    assert rows[0]["doc_id"] == 0 and rows[0]["score"] > 0
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))


def test_limit_and_no_result(spark, corpus):
    assert search(corpus, ask(spark, "status"), Options(limit=2, all_platforms=True)).count() == 2
    assert search(corpus, ask(spark, "qqqq"), Options()).count() == 0


def test_platforms(spark, corpus):
    windows = ids(search(corpus, ask(spark, "status"), Options(platforms=("windows",), use_nlp=False)))
    assert set(windows) == {4, 6}
    alone = ids(search(corpus, ask(spark, "status"), Options(platforms=("windows",), no_cross_platform=True, use_nlp=False)))
    assert alone == [4]


def test_typo_is_found_by_trigrams(spark, corpus):
    assert ids(search(corpus, ask(spark, "gti comit"), Options(use_nlp=False, bigrams=False)))[0] == 0


def test_pair_of_neighbours_matches_in_order_only(spark):
    c = Corpus.of(spark.createDataFrame([(0, "git reset --hard", "", [], [], False), (1, "reset git index", "", [], [], False)], SCHEMA))
    assert {r["doc_id"] for r in c.postings.filter("term = 'git_reset'").collect()} == {0}


def test_least_idf_drops_terms(spark, corpus):
    assert search(corpus, ask(spark, "git"), Options(use_nlp=False, char_grams=False, bm25=Bm25(min_idf=10.0))).count() == 0


def test_context_boost_turns_the_order(spark):
    c = Corpus.of(spark.createDataFrame([(0, "find x", "search files", ["search", "files"], [], False), (1, "grep x", "search files", ["search", "files", "grep"], [], False)], SCHEMA))
    q = ask(spark, "search files grep find")
    s = lambda boosts: {r["doc_id"]: r["score"] for r in Search(c, q, Options(use_nlp=False, context_boosts=boosts)).bm25().collect()}
    plain, lifted = s({}), s({"grep": 3.0})
    assert lifted[1] > plain[1] and lifted[0] == pytest.approx(plain[0])


def test_set_of_queries_equals_single_queries(spark, corpus):
    texts = ["git commit", "find files", "create archive", "show status"]
    together = search(corpus, ask(spark, *texts), Options(limit=3)).collect()
    for i, t in enumerate(texts):
        alone = [(r["rank"], r["doc_id"], round(r["score"], 6)) for r in search(corpus, ask(spark, t), Options(limit=3)).collect()]
        assert sorted(alone) == sorted((r["rank"], r["doc_id"], round(r["score"], 6)) for r in together if r["qid"] == i)


def test_proximity(spark):
    from pyspark.sql import functions as F

    rows = [("disk directory usage report listing",), ("disk report for every listing shown under one directory",)]
    df = spark.createDataFrame(rows, "description string").withColumn("tw", F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term")) for i, t in enumerate(("disk", "directory"))]))
    near, far = [r[0] for r in df.select(features.proximity_boost()).collect()]
    assert near > far > 1.0


def test_fuzzy_fallback_and_suggestions(spark, corpus):
    assert search(corpus, ask(spark, "gtcmt"), Options(use_fuzzy=True, char_grams=False)).count() > 0
    words = [r["word"] for r in fuzzy.suggestions(corpus.docs, ask(spark, "archve")).collect()]
    assert "archive" in words
    assert fuzzy.fuzzy_score("abc", "acb") is None
    assert fuzzy.fuzzy_score("git", "git") > fuzzy.fuzzy_score("git", "g i t x")


def test_additive_scores(spark):
    c = spark.createDataFrame([(0, "git commit", "save changes", ["git", "commit"], [], False)], SCHEMA)
    docs = Corpus.of(c).docs
    assert legacy.legacy_search(docs, ask(spark, "git commit")).first()["score"] >= 24.0
    assert legacy.recovery_search(docs, ask(spark, "save x")).first()["step"] == 2


def test_pipelines_only(spark, corpus):
    assert ids(legacy.pipeline_search(corpus.docs, ask(spark, "list filter"))) == [3]


def test_saved_corpus_gives_the_same(spark, corpus, tmp_path):
    corpus.save(str(tmp_path / "c"), buckets=2)
    loaded = Corpus.load(spark, str(tmp_path / "c"))
    q = ask(spark, "find files")
    assert ids(search(loaded, q)) == ids(search(corpus, q))


def test_evaluation(spark):
    from pyspark.sql import functions as F

    results = spark.createDataFrame([(1, 1, "gitk"), (1, 2, "git log"), (2, 1, "ls")], "qid long, rank int, command string")
    judged = spark.createDataFrame([(1, "a", ["git"]), (2, "", ["tar"]), (3, "a", ["x"])], "qid long, slice string, relevant array<string>")
    loose = {r["qid"]: r for r in evaluate.per_query(evaluate.judged(results, judged)).collect()}
    strict = {r["qid"]: r for r in evaluate.per_query(evaluate.judged(results, judged, boundary=True)).collect()}
    assert loose[1]["first"] == 1 and strict[1]["first"] == 2 and loose[3]["first"] == 0
    assert loose[1]["ndcg_ref"] > 1 >= loose[1]["ndcg"]
    summary = evaluate.summarised(evaluate.per_query(evaluate.judged(results, judged)))
    assert {r["slice"] for r in summary.collect()} == {"a", "unspecified", "(all)"}
    assert evaluate.failures(summary, top1=0.9).count() == 1 and evaluate.failures(summary).count() == 0
    assert len(evaluate.grid(Options(), k1=[1, 2], w_cmd=[1, 2, 3])) == 6
    assert summary.filter(F.col("slice") == "(all)").first()["n"] == 3


def test_overrides():
    b = Bm25().overridden(k1=-1, min_idf=0.5, b=(2, -1, 0.5, 0.5), weight=(0, 2, 0, 0))
    assert b.k1 == 1.2 and b.min_idf == 0.5 and b.b == (1.0, 0.0, 0.5, 0.5) and b.weight == (3.5, 2, 2.0, 1.2)


def test_vector_channel_is_capped_and_filtered(spark, corpus):
    sims = spark.createDataFrame([(0, i, 0.05 + 0.1 * i) for i in range(7)], "qid long, doc_id long, sim double")
    got = {r["doc_id"] for r in channels.vector_scores(corpus, sims, Options(limit=1, all_platforms=True)).collect()}
    assert got == {1, 2, 3, 4, 5, 6}


def test_more_queries_than_one_block_holds(spark, corpus, monkeypatch):
    asked = ask(spark, "git commit", "find files", "create archive", "show status", "list", "zzz")
    whole = [sorted(map(tuple, f(corpus.docs, asked).collect())) for f in (legacy.legacy_search, fuzzy.fuzzy_search)]
    monkeypatch.setattr(channels, "QUERY_ROWS", 2)
    assert len(channels.blocks(asked)) == 6
    assert whole == [sorted(map(tuple, f(corpus.docs, asked).collect())) for f in (legacy.legacy_search, fuzzy.fuzzy_search)]


def test_quotes_at_any_place_of_an_item(spark):
    from lexigrove.plans.queries import _quotes

    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "Two words"), (3, ""), (4, None)], "qid long, text string")
    docs = [(1, "x " + " ".join(f"W{i}" for i in range(20, 30))), (2, " ".join(f"w{i}" for i in range(9))), (3, "say two, words!"), (4, None), (5, ""), (6, item), (7, "two other words")]
    found = {tuple(r) for r in _quotes(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {(1, 1), (2, 3), (1, 6)}


def test_tables_of_a_corpus_lie_with_their_records(spark):
    """Records move once, by doc_id; postings, lengths, shares and norms, made by doc_id, do not move again."""
    rows = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "concat('red ring part', id % 7) as command", "'small gear of a kind' as description", "array('ring', 'gear') as keywords")
    c = Corpus.of(rows)
    assert c.docs.count() == 4000 and c.docs.rdd.getNumPartitions() > 1
    for table in (c.postings, c.stats, c.tf, c.norms):
        table.count()
        lies = table.select("*")._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
        assert lies.startswith("hashpartitioning(doc_id#"), lies


def test_a_feature_alone_is_the_same_and_makes_no_families(spark):
    corpus = Corpus.of(spark.createDataFrame(ROWS, SCHEMA))  # no table is there yet
    s = Search(corpus, ask(spark, "find files by name", "show status"), Options(limit=5))
    found = s.candidates()
    alone = s.featured(found, ("proximity",)).select("qid", "doc_id", "proximity")
    near = sorted(alone.collect())
    assert s._families is None and "family" not in corpus.__dict__
    assert near == sorted(s.featured(found).select("qid", "doc_id", "proximity").collect()) and len(near) > 0


def test_a_sweep_searches_once_for_sets_that_differ_in_bm25_only(spark, corpus, monkeypatch):
    from dataclasses import replace

    began, init = [], Search.__init__
    monkeypatch.setattr(Search, "__init__", lambda self, *a, **k: (began.append(1), init(self, *a, **k))[1])
    q = spark.createDataFrame([(1, "find files", "a", ["find"]), (2, "show status", "", ["status win"]), (3, "qqqq", "a", ["x"])], "qid long, text string, slice string, relevant array<string>")
    base = Options(limit=3, all_platforms=True)
    configs = [*evaluate.grid(base, k1=[0.9, 1.2], min_idf=[0.0, 1.5]), *evaluate.grid(base, w_desc=[9.0]), replace(base, use_nlp=False)]
    got = {r["config"]: r for r in evaluate.sweep(corpus, q, configs).collect()}
    assert len(began) == 2 and sorted(got) == list(range(6)) and sorted(r["place"] for r in got.values()) == list(range(1, 7))
    for at in (0, 1, 5):  # one of each least idf, and the other search
        one = evaluate.summarised(evaluate.evaluate(corpus, q, configs[at], boundary=True)).filter("slice = '(all)'").first()
        assert all(abs(one[m] - got[at][m]) < 1e-9 for m in ("n", "top1", "hit", "mrr", "ndcg_ref", "ndcg"))
    s = Search(corpus, q.select("qid", "text"), base)
    both = s.alternatives({7: configs[1].bm25, 8: configs[0].bm25}).collect()
    assert {r["config"] for r in both} == {7, 8}
    alone = Search(corpus, q.select("qid", "text"), configs[1]).results().collect()
    assert sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in both if r["config"] == 7) == sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in alone)
