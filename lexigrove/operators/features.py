"""Multiplicative features of a (query, record) row: Column expressions over the record's
columns, the query's arrays (actions, targets, keywords, intent) and ``tw``, its weighted
terms as an array of (pos, term, weight, anchor)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.functions import text as X


def _product(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda acc, x: acc * f(x))


def coverage_boost() -> Column:
    """The weighted share of the query's terms that the record has, by field, with its penalties."""
    cmd, keys, desc = F.lower("command"), F.lower(F.array_join("keywords", " ")), F.lower("description")
    strength = lambda t: F.when(X.has_word(cmd, t), 1.0).when(X.has_word(keys, t), 0.9).when(X.has_word(desc, t), 0.65).otherwise(0.0)
    met = F.transform("tw", lambda t: F.struct(t["weight"].alias("w"), strength(t["term"]).alias("s"), t["anchor"].alias("anchor")))
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("total", "matched", "heaviest")], F.lit(False).alias("top"), *[F.lit(0).alias(n) for n in ("count", "strong")], F.lit(False).alias("anchors"), F.lit(False).alias("anchored"))

    def step(a: Column, x: Column) -> Column:
        hit = x["s"] > 0
        return F.struct(
            (a["total"] + x["w"]).alias("total"), (a["matched"] + x["w"] * x["s"]).alias("matched"), F.greatest(a["heaviest"], x["w"]).alias("heaviest"),
            F.when(x["w"] > a["heaviest"], hit).when(x["w"] == a["heaviest"], a["top"] | hit).otherwise(a["top"]).alias("top"),
            (a["count"] + hit.cast("int")).alias("count"), (a["strong"] + (x["s"] >= 0.9).cast("int")).alias("strong"),
            (a["anchors"] | x["anchor"]).alias("anchors"), (a["anchored"] | (hit & x["anchor"])).alias("anchored"),
        )

    def finish(a: Column) -> Column:
        share = a["matched"] / a["total"]
        boost = F.lit(0.55) + share
        n = F.size("tw")
        boost = boost * F.when((n >= 3) & ~a["top"], 0.45).otherwise(1.0) * F.when((n >= 3) & (share < 0.7), 0.7).otherwise(1.0)
        long = n >= 7
        boost = boost * F.when(long & (a["count"] < 2), 0.45).otherwise(1.0) * F.when(long & (a["strong"] < 1), 0.70).otherwise(1.0)
        boost = boost * F.when(long & a["anchors"] & ~a["anchored"], 0.50).otherwise(1.0)
        return F.when(a["total"] == 0, 1.0).otherwise(boost)

    return F.when(F.size("tw") == 0, 1.0).otherwise(F.aggregate(met, start, step, finish))


def proximity_boost() -> Column:
    """How close two different query terms come in the description. Neighbours among the matched terms suffice."""
    asked = F.array_distinct(F.filter(F.transform("tw", lambda t: t["term"]), lambda t: (t != "") & ~F.contains(t, F.lit("_"))))
    tokens = X.terms(F.lower("description"))
    places = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("t")))
    met = F.filter(places, lambda p: F.array_contains(asked, p["t"]))
    n = F.size(met)
    gaps = F.zip_with(F.slice(met, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(met, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a["t"] != b["t"], b["at"] - a["at"]))
    least = F.array_min(gaps)
    different = F.size(F.array_distinct(F.transform(met, lambda p: p["t"])))
    share = F.least(different / F.least(F.lit(4), F.size(asked)), F.lit(1.0))
    boost = F.least(1.0 + 0.20 * share * (1.0 / (1.0 + least)), F.lit(1.10))
    return F.when((F.size(tokens) >= 4) & (F.size(asked) >= 2) & (different >= 2) & least.isNotNull(), boost).otherwise(1.0)


def long_intent_boost() -> Column:
    """For very long queries about downloading, disks, text search or ports."""
    spoken = F.array_distinct(F.concat(F.transform("tw", lambda t: t["term"]), "actions", "targets", "asked_keywords"))
    text = X.search_text(F.col("command"), F.col("description"), F.col("keywords"), F.col("tags"))
    positive, negative, any_of = F.lit(0), F.lit(0), F.lit(False)
    for _, cues, good, bad in lexicon.LONG_INTENTS:
        on = F.size(F.array_intersect(spoken, X.words_literal(cues))) >= 2
        positive = positive + F.when(on, X.count_words(text, good)).otherwise(0)
        negative = negative + F.when(on, X.count_words(text, bad)).otherwise(0)
        any_of = any_of | on
    raw = 1.0 + 0.45 * (positive - 0.30 * negative)
    return F.when((F.size("tw") >= 10) & any_of, F.least(F.greatest(raw, F.lit(0.65)), F.lit(1.70))).otherwise(1.0)


def intent_rule() -> Column:
    """does the record do what the intent asks for?"""
    cmd, desc, intent = F.lower("command"), F.lower("description"), F.col("intent")
    when = lambda c, v: F.when(c, v).otherwise(1.0)
    package = F.contains(cmd, F.lit("makepkg")) & ~F.contains(desc, F.lit("package"))
    return (
        F.when(intent == "find", when(X.has_any(cmd, ["find", "search", "ls", "grep"]), 2.0))
        .when(intent == "view", F.when(X.has_any(cmd, ["cat", "less", "more", "head", "tail", "view"]), 2.5).when(X.has_any(desc, ["display", "show", "view", "print"]), 2.0).otherwise(1.0))
        .when(intent == "create", F.when(X.has_any(cmd, ["mkdir", "touch", "create", "make"]), F.when(package, 0.6).otherwise(2.0)).otherwise(1.0))
        .when(intent == "delete", when(X.has_any(cmd, ["rm", "del", "delete", "remove"]), 2.0))
        .when(intent == "modify", F.when(X.has_any(cmd, ["chmod", "chown", "edit", "modify", "change"]), 2.0).when(X.has_any(desc, ["permission", "modify"]), 1.8).otherwise(1.0))
        .when(intent == "install", when(X.has_any(cmd, ["install", "add", "setup"]) | X.has_any(desc, ["install"]), 2.0))
        .when(intent == "run", when(X.has_any(cmd, ["run", "exec", "start", "launch"]), 2.0))
        .when(intent == "configure", when(X.has_any(cmd, ["config", "set", "configure"]) | X.has_any(desc, ["config"]), 2.0))
        .otherwise(1.0)
    )


def intent_boost() -> Column:
    """the intent's rule, times the actions (F20) and targets (F21) found in the record."""
    cmd, desc = F.lower("command"), F.lower("description")
    found = lambda x, strong, weak: F.when(F.contains(cmd, x), strong).when(F.contains(desc, x), weak).otherwise(1.0)
    packing = lambda x: F.when(X.is_one_of(x, ["compress", "archive"]), F.when(X.has_any(cmd, ["tar", "zip", "gzip"]), 2.5).otherwise(1.0) * F.when(X.has_any(cmd, ["find", "locate"]), 0.2).otherwise(1.0)).otherwise(1.0)
    return intent_rule() * _product(F.col("actions"), lambda x: found(x, 1.5, 1.3) * packing(x)) * _product(F.col("targets"), lambda x: found(x, 1.4, 1.2))


def together_boost() -> Column:
    """An action and a target in one record: 1.2."""
    text = F.concat_ws(" ", F.lower("command"), F.lower("description"))
    return F.when(X.has_any_of(text, F.col("actions")) & X.has_any_of(text, F.col("targets")), 1.2).otherwise(1.0)


def with_synonyms(words: Column) -> Column:
    """each word followed by all its synonyms, without repeats."""
    synonyms = X.lists_literal(lexicon.SYNONYMS)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.coalesce(F.try_element_at(synonyms, F.lower(w)), none)))))


def cascading_boost() -> Column:
    """over the record, and the query's action_words, target_words, keyword_words, contexts and intent."""
    text = F.lower(F.concat_ws(" ", "command", "description", F.array_join("keywords", " ")))
    has = lambda c: X.has_any_word(text, F.col(c))
    context = F.exists("contexts", lambda w: X.has_word(F.col("command"), w) | X.has_word(text, w))
    evidence = F.coalesce(F.try_element_at(X.lists_literal(lexicon.INTENT_EVIDENCE), F.col("intent")), F.array().cast("array<string>"))
    signals = [(has("action_words"), 0.35), (context, 0.25), (has("target_words"), 0.20), (has("keyword_words"), 0.12), (X.has_any_word(text, evidence), 0.20)]
    count, boost = F.lit(0), F.lit(1.0)
    for s, worth in signals:
        count, boost = count + s.cast("int"), boost + F.when(s, worth).otherwise(0.0)
    return F.when(count >= 2, F.least(boost, F.lit(1.9))).otherwise(1.0)
