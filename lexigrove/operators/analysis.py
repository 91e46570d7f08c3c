"""Query understanding: routing of words, intent, expansion and choice of terms, for a DataFrame of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.functions import text as X
from lexigrove.operators.corpus import idf
from lexigrove.options import Options

LONG, VERY_LONG, CORE = 7, 10, 10


def _none() -> Column:
    return F.array().cast("array<string>")


def _routed(pair: Column) -> Column:
    """Q2: what one word, with its stem, adds to the actions, targets and keywords."""
    actions, targets, synonyms = X.lists_literal(lexicon.ACTIONS), X.lists_literal(lexicon.TARGETS), X.lists_literal(lexicon.SYNONYMS)
    at = lambda m, w: F.try_element_at(m, w)
    word, short = pair["word"], pair["stem"]
    changed = short != word
    action = F.coalesce(at(actions, word), F.when(changed, at(actions, short)))
    direct, stemmed = at(targets, word), F.when(changed, at(targets, short))
    synonym = F.coalesce(at(synonyms, word), at(synonyms, short))
    both = F.when(changed, F.array(word, short)).otherwise(F.array(word))
    keywords = F.when(direct.isNotNull(), F.array(word)).when(stemmed.isNotNull(), F.array(word, short)).otherwise(F.concat(both, F.when(synonym.isNotNull(), F.array(synonym[0])).otherwise(_none())))
    stop = X.is_one_of(word, lexicon.STOP_WORDS) | X.is_one_of(short, lexicon.STOP_WORDS)
    is_action = action.isNotNull()
    return F.struct(
        F.when(stop | ~is_action, _none()).otherwise(action).alias("actions"),
        F.when(stop | is_action, _none()).otherwise(F.coalesce(direct, stemmed, _none())).alias("targets"),
        F.when(stop | is_action, _none()).otherwise(keywords).alias("keywords"),
    )


def _intent(actions: Column, keywords: Column) -> Column:
    """Q3 to Q5: the intent with most votes; ties in the order of lexicon.INTENTS."""
    count = lambda c, words: F.size(F.filter(c, lambda x: X.is_one_of(x, words)))
    viewing = (count(actions, lexicon.VIEW_ACTIONS) > 0) | ((count(actions, lexicon.CLEAR_ACTIONS) == 0) & (F.size(actions) == 0))
    votes: dict[str, Column] = {}
    for intent, weight, words in lexicon.ACTION_VOTES:
        votes[intent] = count(actions, words) * F.lit(weight)
    for intent, weight, words in lexicon.KEYWORD_VOTES:
        vote = count(keywords, words) * F.lit(weight)
        votes[intent] = votes[intent] + (F.when(viewing, vote).otherwise(0.0) if intent == "view" else vote)
    order = {name: k for k, name in enumerate(lexicon.INTENTS)}
    ranked = F.array_max(F.array(*[F.struct(F.round(v, 6).alias("score"), F.lit(-order[k]).alias("order"), F.lit(k).alias("intent")) for k, v in votes.items()]))
    return F.when(ranked["score"] > 0, ranked["intent"]).otherwise("general")


def analyze(queries: DataFrame) -> DataFrame:
    """Q1: (qid, text) -> with cleaned, actions, targets, keywords, intent."""
    q = queries.select("qid", F.coalesce("text", F.lit("")).alias("text")).withColumn("cleaned", X.clean(F.col("text")))
    words = F.filter(F.split(F.lower("cleaned"), r"\s+"), lambda w: w != "")
    q = q.withColumn("stems", F.transform(words, lambda w: F.struct(w.alias("word"), X.stem(w).alias("stem"))))
    q = q.withColumn("routed", F.transform("stems", _routed))
    flat = lambda name: F.flatten(F.transform("routed", lambda r: r[name]))
    low = F.lower("text")
    peek = X.has_any(low, lexicon.VIEW_HINTS) & X.has_any(low, lexicon.CLOSED_HINTS)
    seen = F.when(peek, X.words_literal(["view", "show", "display"])).otherwise(_none())
    q = q.select("qid", "text", "cleaned", F.concat(flat("actions"), seen).alias("all_actions"), flat("targets").alias("all_targets"), flat("keywords").alias("all_keywords"))
    return q.select(
        "qid", "text", "cleaned", F.array_distinct("all_actions").alias("actions"), F.array_distinct("all_targets").alias("targets"), F.array_distinct("all_keywords").alias("keywords"),
        _intent(F.col("all_actions"), F.col("all_keywords")).alias("intent"),
    )


def enhanced_keywords() -> Column:
    """Q6, over the columns of analyze()."""
    listed = F.concat("keywords", F.slice("actions", 1, 3), F.slice("targets", 1, 3))
    extra = F.coalesce(F.try_element_at(X.lists_literal(lexicon.INTENT_KEYWORDS), F.col("intent")), _none())
    return F.array_distinct(F.when(F.size(listed) < 4, F.concat(listed, extra)).otherwise(listed))


def _expanded(tokens: Column, keywords: Column) -> Column:
    """Q7"""
    long = F.size(tokens) >= LONG
    new = F.filter(keywords, lambda t: ~F.array_contains(tokens, t) & (~long | X.may_expand(t)))
    room = F.greatest(F.when(long, 10).otherwise(8) - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.slice(new, F.lit(1), room))


def _core(terms: Column) -> Column:
    """Q9"""
    only = lambda c, keep: F.filter(c, keep)
    strong_action = lambda t: ~X.is_one_of(t, lexicon.GENERIC_VERBS) & X.may_expand(t)
    strong_target = lambda t: ~X.is_one_of(t, lexicon.LOW_SIGNAL_TARGETS) & X.may_expand(t)
    parts = [only(terms, X.is_anchor), only("keywords", X.is_anchor), only("actions", strong_action), only("targets", strong_target), only("keywords", X.may_expand), only(terms, X.may_expand)]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, CORE)


def query_terms(queries: DataFrame, options: Options | None = None) -> DataFrame:
    """(qid, text, actions, targets, keywords, intent, tokens, expanded, normal, terms): a query's terms before the cap.

    ``tokens`` are T3, ``expanded`` Q7, ``normal`` Q8; ``terms`` has the pairs of neighbours as well.
    """
    options = options or Options()
    q = (analyze(queries) if options.use_nlp else queries.select("qid", F.coalesce("text", F.lit("")).alias("text"), *[_none().alias(n) for n in ("actions", "targets", "keywords")], F.lit("general").alias("intent"))).withColumn("tokens", X.terms(F.col("text")))
    q = q.withColumn("expanded", _expanded(F.col("tokens"), enhanced_keywords()) if options.use_nlp else F.col("tokens"))
    t = F.col("expanded")
    plain = F.array_distinct(F.filter(t, lambda x: ~X.is_weak(x)))
    fallback = F.when(F.size(plain) >= 3, plain).otherwise(t)
    core = _core(t) if options.use_nlp else _none()
    q = q.withColumn("normal", F.when(F.size(t) < VERY_LONG, t).when(F.size(core) >= 3, core).otherwise(fallback))
    return q.withColumn("terms", X.with_bigrams(F.col("normal")) if options.bigrams else F.col("normal"))


def _importance(t: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(1.0)
    return one(X.is_one_of(t, lexicon.GENERIC_VERBS), 0.35) * one(X.is_one_of(t, lexicon.LOW_SIGNAL_TERMS), 0.45) * one(X.is_entity(t), 1.35) * one(X.is_one_of(t, lexicon.ANCHORS), 1.20)


def capped_terms(q: DataFrame, df: DataFrame, n: int, cap: int = 10) -> DataFrame:
    """Q10 to Q12: (qid, pos, term, df, n_terms) of query_terms() rows; lists within the cap stay as they are.

    Longer lists keep each term once, their first ``preserved`` originals, and then the terms of highest idf (ties in their order).
    """
    rows = q.select("qid", F.size("terms").alias("size"), F.posexplode("terms").alias("pos", "term")).join(df, "term", "left")
    whole = rows.filter(F.col("size") <= cap).select("qid", "pos", "term", "df")
    over = rows.filter(F.col("size") > cap)
    first = Window.partitionBy("qid", "term").orderBy("pos")
    over = over.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    long = F.col("size") >= LONG
    preserved = F.when(long, 2).otherwise(4)
    t = F.col("term")
    known = F.col("df").isNotNull()
    over = over.filter(known | ((F.col("pos") < preserved) & (~long | X.is_entity(t))))
    weight = F.when(~known, 1.0).otherwise(idf(F.lit(n), F.col("df")) * F.when(long, _importance(t)).otherwise(1.0))
    marked = F.when(long, ~known | X.may_preserve(t)).otherwise(F.col("pos") < preserved)
    over = over.withColumn("weight", F.round(weight, 6)).withColumn("marked", marked)
    by_pos = Window.partitionBy("qid").orderBy("pos")
    before = F.sum(F.col("marked").cast("int")).over(by_pos)
    over = over.withColumn("original", F.col("marked") & (~long | (before <= preserved)))
    per = Window.partitionBy("qid")
    over = over.withColumn("left", F.count("*").over(per))
    best = Window.partitionBy("qid").orderBy(F.col("original").desc(), F.when(F.col("original"), F.lit(0.0)).otherwise(F.col("weight")).desc(), "pos")
    over = over.withColumn("place", F.row_number().over(best))
    kept = over.filter((F.col("left") <= cap) | F.col("original") | (F.col("place") <= cap))
    pos = F.when(F.col("left") <= cap, F.col("pos")).otherwise(F.col("place") - 1)
    out = whole.unionByName(kept.select("qid", pos.alias("pos"), "term", "df"))
    return out.withColumn("n_terms", F.count("*").over(per).cast("int"))


def weighted_query_terms(q: DataFrame, corpus_df: DataFrame, n: int, options: Options) -> DataFrame:
    """capped_terms() with idf, boost (R2), weight (R9), entity weight (R10) and anchor flag."""
    t = F.col("term")
    rows = capped_terms(q, corpus_df, n, options.top_terms).join(q.select("qid", "actions", "targets"), "qid")
    in_actions, in_targets = F.array_contains("actions", t), F.array_contains("targets", t)
    context = F.lit(0.0)
    if options.context_boosts:
        context = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in options.context_boosts.items() for x in kv]), t), F.lit(0.0))
    boost = F.greatest(context, F.when(in_actions, 2.0).otherwise(0.0), F.when(in_targets, 1.6).otherwise(0.0))
    long = F.col("n_terms") >= LONG
    verb = F.when(X.is_one_of(t, lexicon.GENERIC_VERBS), F.when(long, 0.55).otherwise(0.7)).otherwise(1.0)
    entity = F.when(X.is_entity(t), F.when(long, 1.45).otherwise(1.25)).otherwise(1.0)
    rows = rows.withColumn("idf", idf(F.lit(n), F.col("df")))
    return rows.select(
        "qid", "pos", "term", "df", "n_terms", "idf", F.when(boost > 0, boost).otherwise(1.0).alias("boost"), F.coalesce(0.5 + F.col("idf"), F.lit(1.0)).alias("weight"),
        (verb * entity * F.when(in_targets, 1.35).otherwise(1.0) * F.when(in_actions, 0.85).otherwise(1.0)).alias("entity"), (X.is_anchor(t) | in_targets).alias("anchor"),
    )
