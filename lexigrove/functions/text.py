"""Text functions from Column to Column; no Python runs on the rows.

Two families of tokens exist side by side: ``terms`` is ASCII (accents separate words) and
feeds the inverted index; ``weighted_terms`` and ``vector_terms`` keep all letters.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove import lexicon


def words_literal(words: list[str]) -> Column:
    """A constant array of strings. One expression that the optimiser folds, not one for each word."""
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def lists_literal(lists: dict[str, list[str]]) -> Column:
    """A constant map from words to arrays."""
    return F.from_json(F.lit(json.dumps(lists)), "map<string,array<string>>")


def is_one_of(c: Column, words: list[str]) -> Column:
    """Membership in a short list."""
    return F.array_contains(words_literal(words), c)


def is_stop_word(c: Column) -> Column:
    """Membership in the stop words, which every token of a corpus is tested for: a hash set in generated code."""
    return c.isin(*lexicon.STOP_WORDS)


def clean(c: Column) -> Column:
    """Everything but ASCII word characters, white space, ``-`` and ``.`` becomes a space; spaces are collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\w\s\-.]", " "), r"\s+", " "))


def terms(c: Column) -> Column:
    """Lower-case ASCII terms of two characters or more, without stop words.

    Whatever clean() drops or keeps between two terms separates them here, so one pass does.
    The two letters that are not ASCII but have a small letter that begins with one go first;
    a split at a class of two ranges is several times faster than a replacement, or than three.
    """
    ascii_only = F.replace(F.replace(c, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))
    parts = F.split(F.lower(ascii_only), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~is_stop_word(t))


def drop_double(c: Column) -> Column:
    """The last letter goes if it doubles the one before, unless it is a vowel or l."""
    return F.regexp_replace(c, r"([^aeioul])\1$", "$1")


def stem(c: Column) -> Column:
    """Conservative stem of a lower-case word. Words without a suffix, most of them, pass only cheap tests."""
    fixes = F.from_json(F.lit(json.dumps(lexicon.STEM_FIXES)), "map<string,string>")
    n = F.octet_length(c)
    cut = lambda k: F.substring(c, F.lit(1), F.length(c) - k)
    shorter = (
        F.when((n > 4) & c.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & c.endswith("ing"), drop_double(cut(3)))
        .when((n > 4) & c.endswith("ed"), drop_double(cut(2)))
        .when((n > 4) & c.endswith("es"), cut(2))
        .otherwise(c)
    )
    suffixed = c.endswith("es") | c.endswith("ing") | c.endswith("ed")
    return (
        F.when(n < 4, c)
        .when(c.isin(*lexicon.STEM_FIXES), F.try_element_at(fixes, c))
        .when(suffixed, F.coalesce(F.try_element_at(fixes, shorter), shorter))
        .otherwise(c)
    )


def neighbours(tokens: Column) -> Column:
    """The adjacent pairs of an array, joined by ``_``."""
    # an array of one element, so that the tokens are made once
    one = F.array(tokens)
    return F.transform(one, lambda t: F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat(F.get(t, i - 1), F.lit("_"), F.get(t, i)))))[0]


def with_bigrams(tokens: Column) -> Column:
    """The tokens, then their adjacent pairs."""
    # an array of one element, so that the tokens are made once
    return F.transform(F.array(tokens), lambda t: F.concat(t, neighbours(t)))[0]


def weighted_terms(c: Column) -> Column:
    """T4: stemmed terms of all alphabets (two bytes or more, stop words tested on the stem), then their adjacent pairs."""
    return with_bigrams(single_weighted_terms(c))


def single_weighted_terms(c: Column) -> Column:
    """weighted_terms() without the pairs."""
    stems = F.transform(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), stem)
    return F.filter(stems, is_weighted_term)


def is_weighted_term(t: Column) -> Column:
    """Whether a stem counts as a weighted term."""
    return (F.octet_length(t) >= 2) & ~is_stop_word(t)


def vector_terms(c: Column) -> Column:
    """T5: lower-case terms of all alphabets, two bytes or more."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def char_grams(c: Column, n: int = 3) -> Column:
    """The different n-grams of characters, lower case, without spaces."""
    text = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def token_variants(t: Column) -> Column:
    """The token, then itself without -ing, -ed, -es and -s where enough remains."""
    n = F.length(t)
    less = lambda suffix, least: F.when(t.endswith(suffix) & (n > least), F.substring(t, F.lit(1), n - len(suffix)))
    return F.array_distinct(F.filter(F.array(t, less("ing", 5), less("ed", 4), less("es", 4), less("s", 3)), lambda x: x.isNotNull()))


def has_word(text: Column, word: Column) -> Column:
    """Whether the word stands between spaces (or the ends) of the text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def has_any_word(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: has_word(text, w))


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the words the text has."""
    return F.size(F.filter(words_literal(words), lambda w: has_word(text, w)))


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts is a substring."""
    return F.exists(words_literal(parts), lambda p: F.contains(text, p))


def has_any_of(text: Column, parts: Column) -> Column:
    """As has_any(), for an array column; empty text or parts do not count."""
    return (text != "") & F.exists(parts, lambda p: (p != "") & F.contains(text, p))


def base_of(command: Column) -> Column:
    """The first field of a command, or the whole where it has none."""
    first = F.try_element_at(F.filter(F.split(command, r"\s+"), lambda x: x != ""), F.lit(1))
    return F.coalesce(first, command)


def clamp01(c: Column) -> Column:
    """T23"""
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def search_text(command: Column, description: Column, keywords: Column, tags: Column) -> Column:
    """T27"""
    return F.concat_ws(" ", F.lower(command), F.lower(description), F.lower(F.array_join(keywords, " ")), F.lower(F.array_join(tags, " ")))


def is_entity(t: Column) -> Column:
    """A four-digit number, or a unit or format."""
    return t.rlike("^[0-9]{4}$") | is_one_of(t, lexicon.ENTITIES)


def is_anchor(t: Column) -> Column:
    """P13 or P17"""
    return is_entity(t) | is_one_of(t, lexicon.ANCHORS)


def is_weak(t: Column) -> Column:
    """P14 or P15"""
    return is_one_of(t, lexicon.GENERIC_VERBS + lexicon.LOW_SIGNAL_TERMS)


def may_expand(t: Column) -> Column:
    """P20"""
    return (t != "") & (is_anchor(t) | (~is_weak(t) & (F.octet_length(t) >= 4)))


def may_preserve(t: Column) -> Column:
    """P19"""
    return is_anchor(t) | (~is_weak(t) & (F.octet_length(t) >= 3))
