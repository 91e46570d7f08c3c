"""The additive scorer, its searches, and the substring searches that recovery falls back to.

A query is split at white space; every word scores against the fields of every record. All
of it is one projection over the scan, with the stated query set joined by broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.functions import text as X
from lexigrove.operators import analysis
from lexigrove.operators.channels import blocks, bounded, tfidf_similarities, top
from lexigrove.operators.corpus import Corpus
from lexigrove.operators.features import intent_boost
from lexigrove.operators.fuzzy import fuzzy_search
from lexigrove.operators.platforms import CROSS, is_cross_platform_tool, is_pipeline
from lexigrove.operators.search import settled
from lexigrove.options import Options


def query_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _command_score(w: Column, cmd: Column) -> Column:
    """F2"""
    return F.when(cmd == w, 30.0).when(cmd.startswith(w), 22.5).when(F.contains(cmd, F.concat(F.lit(" "), w)), 10.0).when(F.contains(cmd, w), 7.0).otherwise(0.0)


def _domain_score(w: Column, cmd: Column) -> Column:
    """the command is, or starts with, one of the word's domain."""
    tools = F.try_element_at(X.lists_literal(lexicon.DOMAINS), w)
    mine = F.exists(tools, lambda t: (cmd == t) | cmd.startswith(F.concat(t, F.lit(" "))))
    return F.when(w.isin(*lexicon.DOMAINS) & mine, 12.0).otherwise(0.0)  # few words have a domain


def _list_score(w: Column, words: Column, exact: float, partial: float) -> Column:
    """F3 and F5"""
    return F.when(F.array_contains(words, w), exact).when(F.exists(words, lambda x: F.contains(x, w)), partial).otherwise(0.0)


def _description_score(w: Column, desc: Column) -> Column:
    """F4"""
    s = F.lit(" ")
    whole = F.contains(desc, F.concat(s, w, s)) | desc.startswith(F.concat(w, s)) | desc.endswith(F.concat(s, w))
    return F.when(whole, 6.0).when(F.contains(desc, w), 6.0 * 0.6).otherwise(0.0)


def category_boost(w: Column, cmd: Column) -> Column:
    """F7 for one word."""
    tool = lambda name: (cmd == name) | cmd.startswith(f"{name} ")
    packer, finder = tool("tar") | tool("zip") | tool("gzip"), X.has_any(cmd, ["find", "locate", "grep"])
    mkdir, packages = cmd.startswith("mkdir"), X.has_any(cmd, ["cargo", "conda"])
    one = F.lit(1.0)
    known = w.isin("compress", "archive", "zip", "tar", "directory", "folder", "create", "new", "search", "find", "download", "get")
    return F.when(~known, one).otherwise(
        F.when(w.isin("compress", "archive"), F.when(packer, 2.5).when(finder, 0.2).otherwise(one))
        .when(w == "zip", F.when(tool("zip"), 3.0).when(X.has_any(cmd, ["bzip", "gzip"]), 0.3).otherwise(one))
        .when(w == "tar", F.when(tool("tar"), 3.0).otherwise(one))
        .when(w.isin("directory", "folder"), F.when(mkdir, 3.0).when(packages, 0.2).otherwise(one))
        .when(w == "create", F.when(mkdir, 1.5 * 1.8).otherwise(one))
        .when(w == "new", F.when(mkdir, 1.5 * 1.5).when(packages, 0.3).otherwise(one))
        .when(w.isin("search", "find"), F.when(finder, 1.3).otherwise(one))
        .when(w.isin("download", "get"), F.when(X.has_any(cmd, ["wget", "curl"]), 1.4).otherwise(one))
        .otherwise(one)
    )


def lowered(docs: DataFrame) -> DataFrame:
    """Records with what legacy_score() reads of them: small letters, made once and not for each word of each query."""
    low = lambda n: F.transform(n, lambda x: F.lower(x))
    d = docs.select("*", F.lower("command").alias("low_command"), F.lower("description").alias("low_description"), low("keywords").alias("low_keywords"), low("tags").alias("low_tags"))
    return d.withColumn("low_all", F.concat_ws("\n", "low_command", "low_description", "low_keywords", "low_tags"))


def word_score(w: Column) -> Column:
    """F2 to F6, over lowered() records. A word has no white space: what the joined fields do not hold, no field holds."""
    cmd, desc = F.col("low_command"), F.col("low_description")
    domain = _domain_score(w, cmd)
    full = _command_score(w, cmd) + domain + _list_score(w, F.col("low_keywords"), 6.0, 1.0) + _description_score(w, desc) + _list_score(w, F.col("low_tags"), 5.0, 2.0)
    return F.when(F.contains(F.col("low_all"), w), full).otherwise(domain)


def legacy_score(words: Column, boosts: dict[str, float] | None = None) -> Column:
    """F1, over lowered() records."""
    lifted = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]) if boosts else None
    lift = lambda w: F.coalesce(F.try_element_at(lifted, w), F.lit(1.0)) if lifted is not None else F.lit(1.0)
    scored = F.transform(F.filter(words, lambda w: F.octet_length(w) >= 2), lambda w: F.struct(word_score(w).alias("s"), lift(w).alias("b")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"), F.lit(0).alias("matched"))
    step = lambda a, x: F.struct((a["sum"] + x["s"] * x["b"]).alias("sum"), F.greatest(a["most"], x["s"]).alias("most"), (a["matched"] + (x["s"] > 0).cast("int")).alias("matched"))
    n = F.size(words)

    def finish(a: Column) -> Column:
        complete = F.when((n > 1) & (a["matched"] > 1), 1.0 + a["matched"] / n * 0.5).otherwise(1.0)
        return a["sum"] * complete * F.when(a["most"] >= 15.0, 1.8).when(a["most"] >= 10.0, 1.4).otherwise(1.0)

    cmd = F.col("low_command")
    category = F.aggregate(words, F.lit(1.0), lambda a, w: a * category_boost(w, cmd))
    niche = F.when(F.col("niche") != "", 1.0 + 0.2 * F.coalesce(F.try_element_at(lifted, F.lower("niche")), F.lit(0.0))).otherwise(1.0) if lifted is not None else F.lit(1.0)
    return F.aggregate(scored, start, step, finish) * category * niche


def _asked(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every record with every query of a stated set, one block of queries at a time."""
    words = queries.select("qid", "text", F.lower("text").alias("asked"), query_words(F.col("text")).alias("words"))
    met = [docs.join(F.broadcast(block.drop("text")), F.size("words") >= 0) for block in blocks(words)]
    return reduce(DataFrame.unionByName, met)


def _best(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("qid", "rank", "doc_id", "score", "command", "description")


def legacy_search(docs: DataFrame, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """R31 (P8): best records by F1; other platforms only as cross-platform tools, at 0.9 of the score."""
    o = options or Options(limit=5)
    exact = (F.size("platform") == 0) | F.exists("platform", lambda p: (F.lower(p) == o.current_platform) | (F.lower(p) == CROSS))
    factor = F.when(exact, 1.0).when(is_cross_platform_tool(F.col("command")), 0.9)
    rows = _asked(lowered(docs.withColumn("factor", factor).filter(F.col("factor").isNotNull())), queries)
    rows = rows.withColumn("score", legacy_score(F.col("words"), o.context_boosts) * F.col("factor")).filter("score > 0")
    return _best(rows, o.limit if o.limit > 0 else 5)


def pipeline_search(docs: DataFrame, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """No platform filter; pipelines only, if asked, and times the boost."""
    o = options or Options(limit=5, pipeline_only=True, pipeline_boost=2.0)
    piped = is_pipeline(F.col("command"), F.col("pipeline"))
    rows = _asked(lowered(docs.filter(piped) if o.pipeline_only else docs), queries)
    boost = F.when(piped, o.pipeline_boost).otherwise(1.0) if o.pipeline_boost > 0 else F.lit(1.0)
    rows = rows.withColumn("score", legacy_score(F.col("words"), o.context_boosts) * boost).filter("score > 0")
    return _best(rows, o.limit if o.limit > 0 else 5)


def exact_and_fuzzy(docs: DataFrame, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """R31 at 2 L where it gives L results and the best is above 0.5, else together with fuzzy matches at 0.8 of their score, each record once."""
    o = options or Options(limit=5, use_fuzzy=True)
    limit = o.limit if o.limit > 0 else 5
    exact = legacy_search(docs, queries, Options(**{**o.__dict__, "limit": 2 * limit})).withColumn("source", F.lit(0))
    exact = settled(exact, 2 * limit * queries.count())  # it has three uses: all records are scored once
    enough = exact.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("most")).filter((F.col("n") >= limit) & (F.col("most") > 0.5)).select("qid")
    fuzzy = fuzzy_search(docs, queries.join(F.broadcast(enough), "qid", "left_anti"), limit, o.fuzzy_threshold).withColumn("score", F.col("score") * 0.8).withColumn("source", F.lit(1))
    both = exact.unionByName(fuzzy) if o.use_fuzzy else exact
    once = Window.partitionBy("qid", "command", "description").orderBy("source", F.col("score").desc(), "doc_id")
    return _best(both.withColumn("nth", F.row_number().over(once)).filter("nth = 1"), limit)


def nlp_search(corpus: Corpus, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """R34 where no index was built before: (qid, rank, doc_id, score).

    Up to 2 L records by TF-IDF at 100 times their cosine. A query with fewer than L gets, for
    the places left, the best records of R33 for its enhanced keywords, at 0.8 of their score
    times the record's intent boost (F18). A record that both find is there once, with the higher score.
    """
    o = options or Options(limit=5)
    limit = o.limit if o.limit > 0 else 5
    n = queries.count()
    near = tfidf_similarities(corpus, queries, n, 2 * limit).select("qid", "doc_id", (F.col("sim") * 100.0).alias("score"))
    found = near.groupBy("qid").agg(F.count("*").alias("found"))
    short = bounded(analysis.analyze(queries), n).join(found, "qid", "left").withColumn("room", F.lit(limit) - F.coalesce("found", F.lit(0))).filter("room > 0")
    asked = short.select("qid", F.array_join(analysis.enhanced_keywords(), " ").alias("text"))
    more = exact_and_fuzzy(corpus.docs, asked, Options(**{**o.__dict__, "limit": limit}))
    sides = short.select("qid", "actions", "targets", "intent", "room")
    more = more.join(bounded(sides, n), "qid").filter(F.col("rank") <= F.col("room")).select("qid", "doc_id", (F.col("score") * intent_boost() * 0.8).alias("score"))
    once = near.unionByName(more).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return top(once, "score", limit).select("qid", "rank", "doc_id", "score")


def recovery_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Records whose command has the whole query; else command or description the first word; else any word of two bytes.

    (qid, doc_id, step, score) of each query's first step that finds anything; no limit.
    """
    cmd, desc = F.lower("command"), F.lower("description")
    has = lambda w: F.contains(cmd, w) | F.contains(desc, w)
    first = F.try_element_at("words", F.lit(1))
    step = F.when(F.contains(cmd, F.col("asked")), 1).when(first.isNotNull() & has(first), 2).when(F.exists("words", lambda w: (F.octet_length(w) >= 2) & has(w)), 3)
    rows = _asked(docs, queries).withColumn("step", step).filter(F.col("step").isNotNull())
    least = F.min("step").over(Window.partitionBy("qid"))
    rows = rows.select("qid", "doc_id", "step").withColumn("least", least).filter("step = least")
    return rows.select("qid", "doc_id", "step", F.when(F.col("step") == 1, 1.0).when(F.col("step") == 2, 0.8).otherwise(0.6).alias("score"))
