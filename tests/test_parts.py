"""Text, sanitising, cache, sources, projects, vectors, history and metrics in the small."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrove import errors, schema
from lexigrove.cache import CachedSearch, LruCache, cache_key
from lexigrove.cluster import spread
from lexigrove.functions import sanitize
from lexigrove.functions import text as X
from lexigrove.functions import vectors as V
from lexigrove.operators import analysis, channels, history, legacy, metrics, projects, vectors
from lexigrove.operators.corpus import Corpus
from lexigrove.options import Options
from lexigrove.plans import queries as plans
from lexigrove.errors import CorpusNotFound
from lexigrove.sources import embeddings, pages, records
from lexigrove.sources.embeddings import find_asset
from lexigrove.streaming import events


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("word, stem", [("installing", "install"), ("running", "run"), ("files", "fil"), ("copies", "copy"), ("deleted", "delete"), ("archived", "archive"), ("cat", "cat"), ("calling", "call")])
def test_stem(spark, word, stem):
    assert one(spark, X.stem, word) == stem


def test_tokens(spark):
    assert one(spark, X.terms, "Go build the café_x, a-b 42!") == ["build", "caf", "42"]
    assert one(spark, X.weighted_terms, "Über Straßen") == ["über", "straßen", "über_straßen"]
    assert one(spark, X.char_grams, "ab c") == ["abc"] and one(spark, X.char_grams, "ab") == []
    assert one(spark, lambda c: X.with_bigrams(F.split(c, " ")), "a b c") == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, X.token_variants, "glasses") == ["glasses", "glass", "glasse"]


def test_sanitising(spark):
    assert one(spark, sanitize.mask, "mail a.b@c.de password: x 1234-5678-9012-3456") == "mail ***@***.*** password=*** ****-****-****-****"
    assert one(spark, sanitize.sanitize_input, "<script>a'b</script>  select x") == "ab x"
    assert one(spark, sanitize.sanitize_filename, " a/b:c. ") == "a_b_c"
    assert one(spark, sanitize.query_error, "a|b") == "invalid_characters" and one(spark, sanitize.query_error, " ") == "empty" and one(spark, sanitize.query_error, "ok") is None
    assert sanitize.checked_limit(0) == 5
    with pytest.raises(errors.QueryError):
        sanitize.checked_limit(101)


def test_cache_order_and_age():
    now = [0.0]
    c = LruCache(2, 10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.keys() == ["c", "a"] and c.get("b") is None and c.stats()["evictions"] == 1
    now[0] = 11
    assert c.sweep() == 2 and len(c) == 0
    assert cache_key(" Git ", Options()) == cache_key("git", Options()) != cache_key("git", Options(platforms=("windows",)))


def test_cached_search(spark):
    corpus = Corpus.of(records.embedded(spark))
    s = CachedSearch(corpus)
    first, again = s.search(spark, "git commit"), s.search(spark, "Git commit ")
    assert first == again and [t[2] for t in s.timings] == [False, True]


def test_yaml_round_trip_and_fallback(spark, tmp_path):
    pytest.importorskip("yaml")
    path = str(tmp_path / "c.yml")
    records.write_yaml(records.embedded(spark), path)
    back = records.read_yaml(spark, path)
    assert back.count() == 11 and back.filter("command = 'pwd'").first()["keywords"] == ["directory", "path"]
    assert records.with_fallback(spark, lambda: records.read_yaml(spark, str(tmp_path / "none.yml")))[1] == "embedded"
    assert records.delay(1) == 0.1 and records.delay(20) == 5.0


def test_recovery_with_personal_records(spark):
    main, own = records.embedded(spark), records.minimal(spark)
    waits = []

    def fails():
        raise OSError("busy")

    def missing():
        raise CorpusNotFound("none")

    docs, source = records.with_fallback(spark, lambda: main, personal=lambda: own)
    assert source == "primary" and docs.count() == 13 and docs.filter("command = 'man'").first()["doc_id"] == 12
    docs, source = records.with_fallback(spark, lambda: main, personal=missing)
    assert source == "primary" and docs.count() == 11
    docs, source = records.with_fallback(spark, lambda: main, backup=lambda: own, personal=fails, sleep=waits.append)
    assert source == "backup" and docs.count() == 2 and waits == [0.1, 0.2]
    assert records.with_fallback(spark, missing, sleep=waits.append)[1] == "embedded" and len(waits) == 2  # no attempt mends a missing file


def test_assets(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "v.bin").write_bytes(b"x")
    assert find_asset("v.bin", (str(tmp_path), str(tmp_path / "b"))) == str(tmp_path / "b" / "v.bin")
    assert find_asset("none.bin", (str(tmp_path),)) is None


def test_monitored_searches(spark):
    now = iter([0.0, 10.0])
    monitor = metrics.Monitor(clock=lambda: next(now))
    monitor.searched(0.002, 3, False, "tar")
    monitor.searched(0.004, 5, True, "tar")
    rows = monitor.exported(spark)
    values = {r["name"]: r["value"] for r in rows.collect()}
    assert values["searches_total"] == 2 and values["search_results"] == 5 and values["search_duration_sum"] == 6.0 and values["system_uptime"] == 10.0
    report = metrics.derived(rows).first()
    assert (report["hit_ratio"], report["searches_per_second"], report["mean_search_ms"]) == (0.5, 0.2, 3.0)
    ticks = iter([1.0, 3.0])
    assert metrics.benchmark("x", lambda: None, 4, clock=lambda: next(ticks))["ns_per_op"] == 500_000_000


def test_nlp_search_fills_up_with_keyword_matches(spark):
    docs = [(0, "tar", "archive files", ["archive"]), (1, "mkdir", "create a directory", ["directory"]), (2, "find", "find files", ["find"]), (3, "ls", "zzz", [])]
    corpus = Corpus.of(spark.createDataFrame(docs, "doc_id long, command string, description string, keywords array<string>"))
    asked = spark.createDataFrame([(1, "create directory"), (2, "zzqx"), (3, None)], "qid long, text string")
    near = {(r["qid"], r["doc_id"]): r["sim"] * 100 for r in channels.tfidf_similarities(corpus, asked, 3, 10).collect()}
    got = legacy.nlp_search(corpus, asked, Options(limit=5, use_fuzzy=False)).collect()
    scores = {(r["qid"], r["doc_id"]): r["score"] for r in got}
    assert near and all(scores[k] >= v for k, v in near.items()) and {q for q, _ in scores} == {1}
    q = spark.createDataFrame([(1, "create directory")], "qid long, text string")
    side = analysis.analyze(q).select("*", analysis.enhanced_keywords().alias("k")).first()
    room = 5 - len([k for k in near if k[0] == 1])
    more = legacy.exact_and_fuzzy(corpus.docs, spark.createDataFrame([(1, " ".join(side["k"]))], "qid long, text string"), Options(limit=5, use_fuzzy=False)).filter(f"rank <= {room}").collect()
    assert more and set(scores) == set(near) | {(1, r["doc_id"]) for r in more}
    assert [r["rank"] for r in sorted(got, key=lambda r: -r["score"])] == list(range(1, len(got) + 1))


def test_pages_in_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pages.zip", "w") as out:
        for i in range(300):
            out.writestr(f"main/pages/linux/p{i}.md", f"# p{i}\n\n> Page é {i}.\n")
        out.writestr("main/readme.txt", "x")
        out.writestr("top.md", "# top\n")
    rows = pages.read_zip(spark, str(tmp_path / "pages.zip")).collect()
    assert len(rows) == 301 and {r["folder"] for r in rows} == {"linux", ""}
    assert next(r for r in rows if r["path"].endswith("/p299.md"))["content"] == "# p299\n\n> Page é 299.\n"


def test_normal_form_of_records(spark):
    df = spark.createDataFrame([(1, None, None, "x")], "doc_id long, command string, keywords array<string>, other string")
    row = schema.records(df).first()
    assert row["command"] == "" and row["keywords"] == [] and row["platform"] == [] and row["pipeline"] is False


def test_vector_files(spark, tmp_path):
    rows = [("cat", [1.0, 0.0]), ("dog", [0.0, 2.0]), ("cat", [3.0, 4.0])]
    (tmp_path / "w.bin").write_bytes(embeddings.pack_word_vectors(rows))
    got = {r["word"]: (r["rank"], r["vec"]) for r in embeddings.read_word_vectors(spark, str(tmp_path / "w.bin"), 2).collect()}
    assert got == {"cat": (2, [3.0, 4.0]), "dog": (1, [0.0, 2.0])}
    (tmp_path / "r.bin").write_bytes(embeddings.pack_record_vectors([[3.0, 4.0]], "abc"))
    df, head = embeddings.read_record_vectors(spark, str(tmp_path / "r.bin"))
    assert head == {"n": 1, "dimension": 2, "version": 1, "hash": "abc"} and df.first()["vec"] == pytest.approx([0.6, 0.8])
    docs = records.minimal(spark)
    assert embeddings.aligned(df, head, docs, "abc") is not None and embeddings.aligned(df, head, docs, "x") is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]
    words = spark.createDataFrame([("install", 0, [1.0, 0.0]), ("tar", 1, [0.0, 1.0])], "word string, rank int, vec array<double>")
    q = spark.createDataFrame([(1, "installing"), (2, "nothing")], "qid long, text string")
    assert [(r["qid"], r["vec"]) for r in vectors.embed_queries(q, words).collect()] == [(1, [1.0, 0.0])]
    docs = schema.records(spark.createDataFrame([(0, "tar", "install"), (1, "x", "y")], "doc_id long, command string, description string"))
    got = {r["doc_id"]: r["vec"] for r in vectors.embed_records(docs, words, 2).collect()}
    assert got[1] == [0.0, 0.0] and got[0][1] > got[0][0] > 0 and math.isclose(sum(x * x for x in got[0]), 1.0)
    many = spark.createDataFrame([(i, [2.0, 0.1 * (i % 3)]) for i in range(20)], "doc_id long, vec array<double>")
    u = vectors.dominant_direction(many)
    assert abs(u[0]) > 0.99 and vectors.dominant_direction(many.limit(5)) is None


def test_pages(spark):
    text = "# tar\n\n> Archiving utility. See `zip`.\n> More.\n\n- Create an archive:\n\n`tar cf {{target.tar}} {{file}}`\n\n- Extract files:\n\n`tar xf a.tar`\n"
    df = spark.createDataFrame([("common", "a", text), ("osx", "b", text.replace("Archiving", "Other"))], "folder string, path string, content string")
    r = pages.merged(df).first()
    assert r["command"] == "tar" and r["description"].startswith("Archiving utility") and r["platform"] == ["linux", "macos", "windows"]
    assert {"family:tar", "alias:zip", "verb:create", "verb:extract", "object:archive", "object:files"} <= set(r["tags"])


def test_projects(spark):
    files = spark.createDataFrame([(1, "go.mod", None), (1, "Makefile", "build:\n\tgo build\n.PHONY: x\n"), (2, "a.txt", None)], "project_id long, filename string, content string")
    ctx = {r["project_id"]: r for r in projects.contexts(files).collect()}
    assert set(ctx[1]["types"]) == {"go", "make"} and ctx[1]["language"] == "go" and ctx[2]["types"] == ["generic"]
    boosts = {r["term"]: r["boost"] for r in projects.context_boosts(files).filter("project_id = 1").collect()}
    assert boosts["go"] == 2.0 and boosts["build"] == 1.3


def test_history_and_metrics(spark):
    log = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4)], "user_id long, query string, seq int")
    assert [r["seq"] for r in history.collapsed(log).orderBy("seq").collect()] == [2, 3, 4]
    assert [r["query"] for r in history.recent_queries(log).orderBy("rank").collect()] == ["a", "b"]
    m = spark.createDataFrame([("x", float(v)) for v in range(1, 101)], "name string, value double")
    p = {r["p"]: r["value"] for r in metrics.percentiles(metrics.histogram(m, ["name"]), ["name"], [50, 99]).collect()}
    assert p == {50: 50.0, 99: 100.0}
    g = spark.createDataFrame([("x", -1.23456, 2), ("x", 5.0, 1)], "name string, value double, ts int")
    assert metrics.gauges(g, ["name"]).first()["value"] == -1.234


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' name, 1.0D value union all select timestamp'2024-01-01 00:20:00', 'a', 2.0D").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, name string, value double").parquet(src)
    q = events.windowed_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.table("hours").collect()] == [(2, 3.0)]


def test_upsert(spark):
    s = "doc_id long, command string, description string"
    got = records.upsert(spark.createDataFrame([(0, "a", "old"), (1, "b", "b")], s), spark.createDataFrame([(0, "a", "new"), (1, "c", "c")], s))
    assert {(r["doc_id"], r["command"], r["description"]) for r in got.collect()} == {(0, "a", "new"), (1, "b", "b"), (3, "c", "c")}


def test_upsert_takes_whole_tables(spark, tmp_path):
    """Rows of every id pass through the registered query, beyond 600 too."""
    for name, prefix, key, text in (("customer", "c", "c_custkey", "c_mktsegment"), ("supplier", "s", "s_suppkey", "s_x"), ("part", "p", "p_partkey", "p_x")):
        spark.range(1, 801).selectExpr(f"id as {key}", f"'{prefix}' || id as {prefix}_name", f"'m' as {text}").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["command"]: (r["doc_id"], r["description"]) for r in plans.QUERIES["upsert_union"](spark, str(tmp_path)).collect()}
    assert len(got) == 2400
    assert got["c700"] == (700, "new m") and got["s700"] == (-700, "old") and got["p700"] == (800 + 1 + 700, "new")


def test_stems(spark):
    words = {
        "mov": "mov", "moved": "move", "copies": "copy", "running": "run", "stopped": "stop", "delet": "delete", "deleting": "delete", "boxes": "box",
        "class": "class", "bed": "bed", "sing": "sing", "falling": "fall", "": "",
    }
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == words
    whole = spark.createDataFrame([("moved copies",)], "w string").select(F.transform(F.split("w", " "), X.stem).alias("s")).first()
    assert whole["s"] == ["move", "copy"]


def test_terms_cut_at_all_but_ascii(spark):
    df = spark.createDataFrame([("Git-Commit.v2 caf\u00e9s \u212aelvin\u0130x a bb_cc",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(X.terms(F.col("c"))).collect()] == [["git", "commit", "v2", "caf", "elvin", "bb", "cc"], [], None]


def test_spread_keeps_rows_and_leaves_tiny_tables(spark):
    tiny, small = spark.range(3), spark.range(40_000)
    assert spread(tiny).count() == 3 and spread(small).count() == 40_000
    assert spread(tiny).rdd.getNumPartitions() == tiny.rdd.getNumPartitions()
    one = small.coalesce(1)
    assert spread(one).rdd.getNumPartitions() > 1
    huge = spark.range(1 << 30)
    assert spread(huge).rdd.getNumPartitions() == huge.rdd.getNumPartitions()


def test_cosine_search_in_blocks(spark):
    """Ties, a zero vector, a null and another length, whatever the blocks of queries."""
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None), (62, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "doc_id long, vec array<float>").repartition(3)
    q = e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    full = {i: v for i, v in rows if v is not None and len(v) == 3}
    expected = {(i, r + 1, j) for i in full if i % 20 == 0 for r, j in enumerate(sorted(full, key=lambda j: (-round(cosine(full[i], full[j]), 6), j))[:5])}
    for block in (1, 2, 100):
        got = vectors.cosine_top(q, e, 5, block).collect()
        assert {(r["qid"], r["rank"], r["doc_id"]) for r in got} == expected


def test_search_set_is_every_twentieth_vector(spark, tmp_path):
    spark.range(100).selectExpr("id as vec_id", "array(float(id), 1f) as embedding", "1 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.QUERIES["vector_cosine_topk"](spark, str(tmp_path)).groupBy("qid").count().collect()
    assert {(r["qid"], r["count"]) for r in got} == {(i, 10) for i in range(0, 100, 20)}


def test_index_over_documents(spark, tmp_path):
    """Whole texts reach the index, long ones and nulls too."""
    rows = [(1, "alpha beta alpha", "en", "web"), (2, None, None, None), (3, " ".join(["gamma"] * 50_000 + ["omega"]), "de", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["term"], r["doc_id"]): r["tf_desc"] for r in plans.QUERIES["document_index_postings"](spark, str(tmp_path)).collect()}
    assert got["alpha", 1] == 2 and got["gamma", 3] == 50_000 and got["omega", 3] == 1
    assert plans.QUERIES["document_field_lengths"](spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("lines", [False, True])
def test_histories_of_several_users_come_back(spark, tmp_path, lines):
    from lexigrove.sources.history import read_history, write_history

    rows = [(u, s, f"query {u}", 3, "here", 5) for u in (1, 2, 3, 44) for s in range(3)]
    log = spark.createDataFrame(rows, "user_id long, seq int, query string, results_count long, context string, duration_ms long").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    path = str(tmp_path / "histories")
    write_history(log.repartition(2), path, 2, lines)
    got = read_history(spark, path, lines)
    assert sorted((r["user_id"], r["seq"], r["query"], r["results_count"], r["duration_ms"]) for r in got.collect()) == sorted((str(u), s, q, n, t) for u, s, q, n, _, t in rows if s > 0)
    assert read_history(spark, str(tmp_path / "nothing"), lines).count() == 0


def test_word_vectors_are_ranked_by_line(spark, tmp_path):
    """A file of several splits: ranks count the lines, whatever the splits; copies and lines of another width as stated."""
    lines = [f"w{i} {i}.0 {i}.5" for i in range(50_000)]
    lines[10], lines[20] = "broken 1.0", "w5 7.0 7.5"
    (tmp_path / "v.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r["word"]: (r["rank"], r["vec"]) for r in embeddings.read_glove(spark, str(tmp_path / "v.txt"), 40_000, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 39_998 and "broken" not in got and got["w5"] == (5, [7.0, 7.5])
    assert got["w9"][0] == 9 and got["w11"][0] == 10 and got["w39999"] == (39_997, [39_999.0, 39_999.5])


def test_judged_sets(spark, tmp_path):
    from lexigrove.errors import CorpusNotFound
    from lexigrove.sources.judgements import read_judgements

    (tmp_path / "a.yaml").write_text("queries:\n  - {query: list files, slice: short, set: dev, relevant: [ls, dir]}\n  - {query: copy, set: test}\n")
    (tmp_path / "b.yaml").write_text("queries:\n  - {query: move, relevant: [mv], set: dev}\n")
    (tmp_path / "c.yaml").write_text("")
    every = {r["qid"]: (r["text"], r["slice"], r["set"], r["relevant"]) for r in read_judgements(spark, str(tmp_path)).collect()}
    assert every == {0: ("list files", "short", "dev", ["ls", "dir"]), 1: ("copy", "", "test", []), 2: ("move", "", "dev", ["mv"])}
    assert [r["qid"] for r in read_judgements(spark, str(tmp_path), "dev").orderBy("qid").collect()] == [0, 2]
    with pytest.raises(CorpusNotFound):
        read_judgements(spark, str(tmp_path / "none.yaml"))


def test_vectors_are_optional(spark, tmp_path):
    docs = spark.createDataFrame([(0, "list"), (1, "copy")], "doc_id long, command string")
    words, records_file = tmp_path / "w.bin", tmp_path / "r.bin"
    words.write_bytes(embeddings.pack_word_vectors([("list", [1.0, 0.0]), ("copy", [0.0, 1.0])]))
    records_file.write_bytes(embeddings.pack_record_vectors([[1.0, 0.0], [0.0, 1.0]], "abc"))
    w, r, said = vectors.attached(docs, "abc", str(words), str(records_file), 2)
    assert said == [] and w.count() == 2
    asked = spark.createDataFrame([(1, "list")], "qid long, text string")
    best = vectors.query_similarities(asked, w, r, 1).collect()
    assert [(x["doc_id"], round(x["sim"], 6)) for x in best] == [(0, 1.0)]
    assert vectors.attached(docs, "other", str(words), str(records_file), 2)[1:] == (None, ["record vectors: they belong to other records"])
    records_file.write_bytes(b"WTFE")
    assert vectors.attached(docs, "abc", str(words), str(records_file), 2)[1] is None
    assert vectors.attached(docs, "abc", str(tmp_path / "none.bin"), None, 2)[0] is None


def test_larger_tables_are_dealt_out_once(spark, tmp_path):
    """One file is one task, until its table is dealt out; a table beyond 32 MB a core has more tasks than cores."""
    spark.range(300_000).selectExpr("id as p_partkey", "'small ring' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "1d as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = plans.part_records(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() > 1 and spread(dealt).rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
    assert spread(spark.range(64 << 20).coalesce(1)).rdd.getNumPartitions() == 16


def test_terms_of_every_letter(spark):
    """terms() cuts before letters become small, whatever the letter."""
    every = spark.range(1, 0x3000).selectExpr("concat('ab', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'Cd') as c")
    plain = F.filter(F.split(F.lower(F.regexp_replace("c", "[^A-Za-z0-9]+", " ")), " "), lambda t: (F.length(t) >= 2) & ~X.is_stop_word(t))
    assert every.filter(~plain.eqNullSafe(X.terms(F.col("c")))).count() == 0
