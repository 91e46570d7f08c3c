"""DuckDB SQL that says the same as the Spark operators, in pieces: expressions and named table expressions.

It is the oracle of the tests, written from the definitions and not from the operators.
"""

from __future__ import annotations

from lexigrove import lexicon
from lexigrove.functions import sanitize


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(words: list[str]) -> str:
    return "[" + ", ".join(text(w) for w in words) + "]::VARCHAR[]" if words else "[]::VARCHAR[]"


def table(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(rows) + ")"


def lists(name: str, of: dict[str, list[str]]) -> str:
    return table(name, "word, words", [f"({text(k)}, {array(v)})" for k, v in of.items()])


def one_of(x: str, words: list[str]) -> str:
    return f"({x} IN (" + ", ".join(text(w) for w in words) + "))"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\w\s\-.]', ' ', 'g'), '\s+', ' ', 'g'))"


def terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({clean(x)}), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT {one_of('t', lexicon.STOP_WORDS)})"


def stem(x: str) -> str:
    # the regular expressions of DuckDB have no back references: doubled consonants are listed
    doubles = "(" + "|".join(c + c for c in "bcdfghjkmnpqrstvwxyz0123456789_") + ")$"
    drop = lambda s: f"CASE WHEN regexp_matches({s}, {text(doubles)}) THEN left({s}, length({s}) - 1) ELSE {s} END"
    shorter = f"""CASE WHEN strlen({x}) > 4 AND ends_with({x}, 'ies') THEN left({x}, length({x}) - 3) || 'y'
      WHEN strlen({x}) > 5 AND ends_with({x}, 'ing') THEN {drop(f'left({x}, length({x}) - 3)')}
      WHEN strlen({x}) > 4 AND ends_with({x}, 'ed') THEN {drop(f'left({x}, length({x}) - 2)')}
      WHEN strlen({x}) > 4 AND ends_with({x}, 'es') THEN left({x}, length({x}) - 2) ELSE {x} END"""
    fixes = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in lexicon.STEM_FIXES.items())
    return f"CASE WHEN strlen({x}) < 4 THEN {x} ELSE coalesce(CASE {x} {fixes} END, CASE ({shorter}) {fixes} END, {shorter}) END"


def neighbours(l: str) -> str:
    return f"list_transform(range(1, greatest(len({l}), 1)), lambda i: ({l})[i] || '_' || ({l})[i + 1])"


def weighted(x: str) -> str:
    """The single stemmed terms; pairs are added by the caller."""
    return rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: {stem('w')}), lambda t: strlen(t) >= 2 AND NOT {one_of('t', lexicon.STOP_WORDS)})"


def grams(x: str) -> str:
    p = f"replace(lower({x}), ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(length({p}) - 1, 1)), lambda i: substr({p}, i, 3)))"


def has_word(t: str, w: str) -> str:
    return f"contains(' ' || {t} || ' ', ' ' || {w} || ' ')"


def has_any(t: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {text(p)})" for p in parts) + ")"


def count_words(t: str, words: list[str]) -> str:
    return "(" + " + ".join(f"({has_word(t, text(w))})::INTEGER" for w in words) + ")"


def distinct(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def is_entity(t: str) -> str:
    return f"(regexp_full_match({t}, '[0-9]{{4}}') OR {one_of(t, lexicon.ENTITIES)})"


def is_anchor(t: str) -> str:
    return f"({is_entity(t)} OR {one_of(t, lexicon.ANCHORS)})"


def is_weak(t: str) -> str:
    return one_of(t, lexicon.GENERIC_VERBS + lexicon.LOW_SIGNAL_TERMS)


def may_expand(t: str) -> str:
    return f"({t} <> '' AND ({is_anchor(t)} OR (NOT {is_weak(t)} AND strlen({t}) >= 4)))"


def may_preserve(t: str) -> str:
    return f"({is_anchor(t)} OR (NOT {is_weak(t)} AND strlen({t}) >= 3))"


def mask(x: str) -> str:
    for pattern, put in sanitize.MASKS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, {text(pattern.removeprefix('(?i)'))}, {text(put.replace('$1', chr(92) + '1'))}, '{flags}')"
    return x


def sanitized(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')"
    for pattern in sanitize.REMOVED:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, {text(pattern.removeprefix('(?i)'))}, '', '{flags}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# --- named table expressions -------------------------------------------------------------

DOCS = """docs AS MATERIALIZED (
  SELECT p_partkey AS doc_id, p_name AS command, p_type || ' ' || p_brand AS description, string_split(p_name, ' ') AS keywords,
         [lower(p_type)] AS tags, p_type AS niche,
         [CASE p_size % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' WHEN 2 THEN 'windows' ELSE 'cross-platform' END] AS platform,
         p_size % 3 = 0 AS pipeline FROM part)"""

TOKENS = f"""single AS MATERIALIZED (
  SELECT doc_id, {terms('lower(command)')} AS c, {terms('lower(description)')} AS d, {terms("lower(array_to_string(keywords, ' '))")} AS k,
         {terms("lower(array_to_string(tags, ' '))")} AS t FROM docs),
tokens AS MATERIALIZED (
  SELECT doc_id, list_concat(c, {neighbours('c')}) AS cmd, d AS descr, list_concat(k, {neighbours('k')}) AS keys, t AS tags FROM single)"""

POSTINGS = """occurrences AS (
  SELECT doc_id, unnest(cmd) AS term, 'cmd' AS f FROM tokens UNION ALL SELECT doc_id, unnest(descr), 'desc' FROM tokens
  UNION ALL SELECT doc_id, unnest(keys), 'keys' FROM tokens UNION ALL SELECT doc_id, unnest(tags), 'tags' FROM tokens),
postings AS MATERIALIZED (
  SELECT term, doc_id, count(*) FILTER (WHERE f = 'cmd') AS tf_cmd, count(*) FILTER (WHERE f = 'desc') AS tf_desc,
         count(*) FILTER (WHERE f = 'keys') AS tf_keys, count(*) FILTER (WHERE f = 'tags') AS tf_tags
  FROM occurrences GROUP BY term, doc_id),
frequency AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

GRAM_TEXT = "lower(command) || ' ' || lower(array_to_string(keywords, ' '))"

STATS = f"""gram_lists AS MATERIALIZED (SELECT doc_id, {grams(GRAM_TEXT)} AS g FROM docs),
stats AS MATERIALIZED (
  SELECT doc_id, len(cmd) AS len_cmd, len(descr) AS len_desc, len(keys) AS len_keys, len(tags) AS len_tags, len(g) AS n_grams
  FROM tokens JOIN gram_lists USING (doc_id)),
totals AS MATERIALIZED (
  SELECT count(*) AS n, avg(len_cmd) AS avg_cmd, avg(len_desc) AS avg_desc, avg(len_keys) AS avg_keys, avg(len_tags) AS avg_tags FROM stats)"""

CORPUS = [DOCS, TOKENS, POSTINGS, STATS]

TFIDF = f"""words1 AS MATERIALIZED (SELECT doc_id, {weighted("command || ' ' || description || ' ' || array_to_string(keywords, ' ')")} AS w FROM docs),
words2 AS MATERIALIZED (SELECT doc_id, list_concat(w, {neighbours('w')}) AS w FROM words1),
shares AS MATERIALIZED (SELECT doc_id, term, count(*) / any_value(n)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words2) GROUP BY doc_id, term),
vocabulary AS MATERIALIZED (
  SELECT term, count(*) AS df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM shares, (SELECT count(*) AS n FROM docs) GROUP BY term, n HAVING count(*) <= greatest(1, n * 8 // 10)),
weights AS MATERIALIZED (SELECT s.doc_id, s.term, s.tf * v.idf AS w FROM shares s JOIN vocabulary v USING (term)),
norms AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id)"""


def queries(rows: list[tuple[int, str]]) -> str:
    return table("queries", "qid, text", [f"({q}::BIGINT, {text(t)})" for q, t in rows])


def _votes(actions: str, keywords: str) -> str:
    """One struct (score, -order, name) per intent."""
    count = lambda l, words: f"len(list_filter({l}, lambda x: {one_of('x', words)}))"
    viewing = f"({count(actions, lexicon.VIEW_ACTIONS)} > 0 OR ({count(actions, lexicon.CLEAR_ACTIONS)} = 0 AND len({actions}) = 0))"
    parts = {name: f"{count(actions, words)} * {weight}::DOUBLE" for name, weight, words in lexicon.ACTION_VOTES}
    for name, weight, words in lexicon.KEYWORD_VOTES:
        vote = f"{count(keywords, words)} * {weight}::DOUBLE"
        parts[name] += f" + CASE WHEN {viewing} THEN {vote} ELSE 0.0 END" if name == "view" else f" + {vote}"
    order = {n: k for k, n in enumerate(lexicon.INTENTS)}
    return "[" + ", ".join(f"{{'score': round({v}, 6), 'place': {-order[k]}, 'intent': {text(k)}}}" for k, v in parts.items()) + "]"


LEXICON = ", ".join([lists("lex_actions", lexicon.ACTIONS), lists("lex_targets", lexicon.TARGETS), lists("lex_synonyms", lexicon.SYNONYMS), lists("lex_intent", lexicon.INTENT_KEYWORDS), lists("lex_evidence", lexicon.INTENT_EVIDENCE)])

_STOP = f"({one_of('w', lexicon.STOP_WORDS)} OR {one_of('st', lexicon.STOP_WORDS)})"
_FLAT = lambda c: f"coalesce(flatten(list({c} ORDER BY i) FILTER (WHERE {c} IS NOT NULL)), [])"

ANALYSIS = rf"""cleaned AS MATERIALIZED (SELECT qid, text, {clean('text')} AS cleaned FROM queries),
query_words AS (
  SELECT qid, i, ws[i] AS w FROM (
    SELECT qid, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
      SELECT qid, list_filter(regexp_split_to_array(lower(cleaned), '\s+'), lambda x: x <> '') AS ws FROM cleaned))),
stems AS (SELECT qid, i, w, {stem('w')} AS st FROM query_words),
routed AS (
  SELECT qid, i,
    CASE WHEN {_STOP} THEN NULL ELSE coalesce(a1.words, a2.words) END AS act,
    CASE WHEN {_STOP} OR coalesce(a1.words, a2.words) IS NOT NULL THEN NULL ELSE coalesce(t1.words, t2.words) END AS tgt,
    CASE WHEN {_STOP} OR coalesce(a1.words, a2.words) IS NOT NULL THEN NULL
         WHEN t1.words IS NOT NULL THEN [w] WHEN t2.words IS NOT NULL THEN [w, st]
         ELSE list_concat(CASE WHEN st <> w THEN [w, st] ELSE [w] END, CASE WHEN coalesce(s1.words, s2.words) IS NULL THEN [] ELSE [coalesce(s1.words, s2.words)[1]] END) END AS kw
  FROM stems LEFT JOIN lex_actions a1 ON a1.word = w LEFT JOIN lex_actions a2 ON a2.word = st AND st <> w
    LEFT JOIN lex_targets t1 ON t1.word = w LEFT JOIN lex_targets t2 ON t2.word = st AND st <> w
    LEFT JOIN lex_synonyms s1 ON s1.word = w LEFT JOIN lex_synonyms s2 ON s2.word = st),
gathered AS (SELECT qid, {_FLAT('act')} AS a, {_FLAT('tgt')} AS t, {_FLAT('kw')} AS k FROM routed GROUP BY qid),
all_lists AS MATERIALIZED (
  SELECT c.qid, c.text, c.cleaned,
    list_concat(coalesce(g.a, []::VARCHAR[]), CASE WHEN {has_any('lower(c.text)', lexicon.VIEW_HINTS)} AND {has_any('lower(c.text)', lexicon.CLOSED_HINTS)} THEN ['view', 'show', 'display'] ELSE [] END) AS a,
    coalesce(g.t, []::VARCHAR[]) AS t, coalesce(g.k, []::VARCHAR[]) AS k
  FROM cleaned c LEFT JOIN gathered g USING (qid)),
voted AS (SELECT *, list_max({_votes('a', 'k')}) AS best FROM all_lists),
analysis AS MATERIALIZED (
  SELECT qid, text, cleaned, {distinct('a')} AS actions, {distinct('t')} AS targets, {distinct('k')} AS keywords,
         CASE WHEN best.score > 0 THEN best.intent ELSE 'general' END AS intent FROM voted)"""

EXPANSION = f"""listed AS (
  SELECT a.*, {terms('a.text')} AS tokens, list_concat(list_concat(keywords, actions[1:3]), targets[1:3]) AS l, coalesce(x.words, []::VARCHAR[]) AS extra
  FROM analysis a LEFT JOIN lex_intent x ON x.word = a.intent),
enhanced AS (SELECT *, CASE WHEN len(l) < 4 THEN list_concat(l, extra) ELSE l END AS e FROM listed),
offered AS (
  SELECT *, list_filter({distinct('e')}, lambda x: NOT list_contains(tokens, x) AND (len(tokens) < 7 OR {may_expand('x')})) AS fresh FROM enhanced),
expanded AS MATERIALIZED (
  SELECT * EXCLUDE (l, e, extra, fresh), list_concat(tokens, fresh[1:greatest(CASE WHEN len(tokens) >= 7 THEN 10 ELSE 8 END - len(tokens), 0)]) AS expanded FROM offered),
core_lists AS (
  SELECT *, list_concat(list_concat(list_concat(list_concat(list_concat(
      list_filter(expanded, lambda x: {is_anchor('x')}), list_filter(keywords, lambda x: {is_anchor('x')})),
      list_filter(actions, lambda x: NOT {one_of('x', lexicon.GENERIC_VERBS)} AND {may_expand('x')})),
      list_filter(targets, lambda x: NOT {one_of('x', lexicon.LOW_SIGNAL_TARGETS)} AND {may_expand('x')})),
      list_filter(keywords, lambda x: {may_expand('x')})), list_filter(expanded, lambda x: {may_expand('x')})) AS c,
    list_filter(expanded, lambda x: NOT {is_weak('x')}) AS p FROM expanded),
cores AS (SELECT * EXCLUDE (c, p), ({distinct('c')})[1:10] AS core, {distinct('p')} AS plain FROM core_lists),
normals AS (
  SELECT * EXCLUDE (core, plain), CASE WHEN len(expanded) < 10 THEN expanded WHEN len(core) >= 3 THEN core WHEN len(plain) >= 3 THEN plain ELSE expanded END AS normal FROM cores),
query_terms AS MATERIALIZED (SELECT *, list_concat(normal, {neighbours('normal')}) AS terms FROM normals)"""

IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
_IMPORTANCE = f"(CASE WHEN {one_of('term', lexicon.GENERIC_VERBS)} THEN 0.35::DOUBLE ELSE 1 END * CASE WHEN {one_of('term', lexicon.LOW_SIGNAL_TERMS)} THEN 0.45::DOUBLE ELSE 1 END * CASE WHEN {is_entity('term')} THEN 1.35::DOUBLE ELSE 1 END * CASE WHEN {one_of('term', lexicon.ANCHORS)} THEN 1.20::DOUBLE ELSE 1 END)"

CAP = f"""placed AS (SELECT qid, len(terms) AS size, i - 1 AS pos, terms[i] AS term FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM query_terms)),
known AS (SELECT p.*, f.df, t.n FROM placed p LEFT JOIN frequency f USING (term), totals t),
firsts AS (SELECT *, size >= 7 AS long, CASE WHEN size >= 7 THEN 2 ELSE 4 END AS preserved FROM known WHERE size > 10 QUALIFY row_number() OVER (PARTITION BY qid, term ORDER BY pos) = 1),
rated AS (
  SELECT *, round(CASE WHEN df IS NULL THEN 1.0 ELSE {IDF} * CASE WHEN long THEN {_IMPORTANCE} ELSE 1 END END, 6) AS weight,
         CASE WHEN long THEN df IS NULL OR {may_preserve('term')} ELSE pos < preserved END AS marked
  FROM firsts WHERE df IS NOT NULL OR (pos < preserved AND (NOT long OR {is_entity('term')}))),
ordered AS (SELECT *, marked AND (NOT long OR sum(marked::INTEGER) OVER (PARTITION BY qid ORDER BY pos) <= preserved) AS original, count(*) OVER (PARTITION BY qid) AS remain FROM rated),
chosen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY original DESC, CASE WHEN original THEN 0.0 ELSE weight END DESC, pos) AS place FROM ordered),
capped0 AS (
  SELECT qid, pos, term, df FROM known WHERE size <= 10
  UNION ALL SELECT qid, CASE WHEN remain <= 10 THEN pos ELSE place - 1 END, term, df FROM chosen WHERE remain <= 10 OR original OR place <= 10),
capped AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY qid) AS n_terms FROM capped0),
weighted_terms AS MATERIALIZED (
  SELECT c.qid, c.pos, c.term, c.df, c.n_terms, {IDF} AS idf,
    CASE WHEN list_contains(q.actions, c.term) THEN 2.0 WHEN list_contains(q.targets, c.term) THEN 1.6 ELSE 1.0 END::DOUBLE AS boost,
    coalesce(0.5::DOUBLE + {IDF}, 1.0) AS weight,
    (CASE WHEN {one_of('c.term', lexicon.GENERIC_VERBS)} THEN CASE WHEN n_terms >= 7 THEN 0.55 ELSE 0.7 END ELSE 1 END::DOUBLE
     * CASE WHEN {is_entity('c.term')} THEN CASE WHEN n_terms >= 7 THEN 1.45 ELSE 1.25 END ELSE 1 END::DOUBLE
     * CASE WHEN list_contains(q.targets, c.term) THEN 1.35 ELSE 1 END::DOUBLE * CASE WHEN list_contains(q.actions, c.term) THEN 0.85 ELSE 1 END::DOUBLE) AS entity,
    {is_anchor('c.term')} OR list_contains(q.targets, c.term) AS anchor
  FROM capped c JOIN query_terms q USING (qid), totals)"""


def bm25f(k1: float = 1.2, b: tuple = (0.75, 0.75, 0.70, 0.70), w: tuple = (3.5, 1.0, 2.0, 1.2)) -> str:
    parts = []
    for f, bb, ww in zip(("cmd", "desc", "keys", "tags"), b, w):
        parts.append(f"CASE WHEN tf_{f} > 0 THEN ({ww}::DOUBLE * tf_{f} * ({k1}::DOUBLE + 1)) / ({ww}::DOUBLE * tf_{f} + {k1}::DOUBLE * (1 - {bb}::DOUBLE + {bb}::DOUBLE * len_{f} / (CASE WHEN avg_{f} > 0 THEN avg_{f} ELSE 1 END))) ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


_VARIANT = {"linux": "lower(p) IN ('unix', 'bash', 'zsh') OR starts_with(lower(p), 'linux')", "windows": "lower(p) IN ('cmd', 'powershell', 'windows-cmd', 'windows-powershell') OR starts_with(lower(p), 'windows')"}


def compatible(wanted: str, cross: bool = True) -> str:
    own = f"lower(p) = {text(wanted)}" + (f" OR {_VARIANT[wanted]}" if wanted in _VARIANT else "")
    inner = f"lower(p) = 'cross-platform' OR {own}" if cross else f"lower(p) <> 'cross-platform' AND ({own})"
    return f"(len(platform) = 0 OR len(list_filter(platform, lambda p: {inner})) > 0)"


TOOL = one_of("string_split(lower(command), ' ')[1]", lexicon.CROSS_PLATFORM_TOOLS)
PIPELINE = "(pipeline OR contains(command, '|') OR contains(command, '&&') OR contains(command, '>>') OR contains(lower(command), 'pipe'))"
ELIGIBLE = f"eligible AS MATERIALIZED (SELECT doc_id FROM docs WHERE {compatible('linux')} OR {compatible('cross-platform')} OR {TOOL})"
EVERYONE = "eligible AS MATERIALIZED (SELECT doc_id FROM docs)"


def bm25_scores(params: str, min_idf: float = 0.0) -> str:
    return f"""bm25 AS MATERIALIZED (
  SELECT w.qid, p.doc_id, sum(w.idf * w.boost * {params}) AS score
  FROM weighted_terms w JOIN postings p USING (term) JOIN stats USING (doc_id) JOIN eligible USING (doc_id), totals
  WHERE w.df IS NOT NULL AND w.idf >= {min_idf}::DOUBLE GROUP BY w.qid, p.doc_id)"""


def char_scores(limit: int) -> str:
    return f"""query_grams AS (SELECT qid, {grams('text')} AS g FROM queries),
gram_rows AS (SELECT doc_id, unnest(g) AS gram FROM gram_lists),
shared AS (SELECT q.qid, q.n_q, g.doc_id, count(*) AS common FROM (SELECT qid, len(g) AS n_q, unnest(g) AS gram FROM query_grams) q JOIN gram_rows g USING (gram) GROUP BY ALL),
gram_sims AS (SELECT qid, doc_id, common / (sqrt(n_q::DOUBLE) * sqrt(n_grams::DOUBLE)) AS sim FROM shared JOIN stats USING (doc_id) JOIN eligible USING (doc_id) WHERE n_grams > 0),
chars AS MATERIALIZED (
  SELECT qid, doc_id, sim * 55.0::DOUBLE AS score FROM gram_sims WHERE sim >= 0.12
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, doc_id) <= {max(6 * limit, 12)})"""


SIMILARITIES = f"""query_words1 AS MATERIALIZED (SELECT qid, {weighted('text')} AS w FROM queries),
query_shares AS (
  SELECT qid, term, count(*) / any_value(n)::DOUBLE AS tf
  FROM (SELECT qid, len(w) AS n, unnest(w) AS term FROM (SELECT qid, list_concat(w, {neighbours('w')}) AS w FROM query_words1)) GROUP BY qid, term),
query_vectors AS MATERIALIZED (SELECT qid, term, tf * idf AS q FROM query_shares JOIN vocabulary USING (term)),
query_norms AS (SELECT qid, sqrt(sum(q * q)) AS q_norm FROM query_vectors GROUP BY qid),
dots AS (SELECT v.qid, w.doc_id, sum(v.q * w.w) AS dot FROM query_vectors v JOIN weights w USING (term) GROUP BY v.qid, w.doc_id),
sims AS MATERIALIZED (
  SELECT qid, doc_id, dot / (q_norm * norm) AS sim, row_number() OVER (PARTITION BY qid ORDER BY round(dot / (q_norm * norm), 6) DESC, doc_id) AS rank
  FROM dots JOIN query_norms USING (qid) JOIN norms USING (doc_id) WHERE q_norm > 0 AND norm > 0 AND dot / (q_norm * norm) > 0.01)"""


def fused(limit: int) -> str:
    return f"""tfidf AS (SELECT qid, doc_id, sim * 100.0::DOUBLE AS score FROM sims JOIN eligible USING (doc_id) WHERE rank <= {max(6 * limit, 15)}),
channels AS (
  SELECT qid, doc_id, max(score) FILTER (WHERE c = 'b') AS b, max(score) FILTER (WHERE c = 'g') AS g, max(score) FILTER (WHERE c = 't') AS t
  FROM (SELECT *, 'b' AS c FROM bm25 UNION ALL SELECT *, 'g' FROM chars UNION ALL SELECT *, 't' FROM tfidf) GROUP BY qid, doc_id),
candidates AS MATERIALIZED (
  SELECT qid, doc_id, coalesce(b, 0.0) + coalesce(g * CASE WHEN b IS NOT NULL THEN 0.35::DOUBLE ELSE 0.80::DOUBLE END, 0.0)
         + coalesce(t * CASE WHEN b IS NOT NULL OR g IS NOT NULL THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END, 0.0) AS score
  FROM channels WHERE qid IN (SELECT qid FROM query_terms WHERE len(terms) > 0))"""


BASE = r"coalesce(list_filter(regexp_split_to_array(lower(command), '\s+'), lambda x: x <> '')[1], lower(command))"

FAMILIES = f"""bases AS MATERIALIZED (SELECT doc_id, {BASE} AS base FROM docs),
family AS MATERIALIZED (
  SELECT token, base, count(*) AS c FROM (
    SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(list_concat(list_concat(list_concat(c, d), k), t)) AS token FROM single)) JOIN bases USING (doc_id) GROUP BY token, base),
asked AS (SELECT qid, term, n_terms, any_value(weight * entity) AS w FROM weighted_terms GROUP BY qid, term, n_terms),
split AS (SELECT a.qid, a.n_terms, f.base, a.w * (f.c / sum(f.c) OVER (PARTITION BY a.qid, a.term))::DOUBLE AS s FROM asked a JOIN family f ON f.token = a.term),
summed AS (SELECT qid, n_terms, base, sum(s) AS s FROM split GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, base) AS place FROM summed QUALIFY place <= 5),
family_scores AS MATERIALIZED (SELECT qid, n_terms, base, place, s / max(s) OVER (PARTITION BY qid) AS family FROM best),
sure AS (SELECT qid, max(family) FILTER (WHERE place = 1) AS top, max(family) FILTER (WHERE place = 1) - coalesce(max(family) FILTER (WHERE place = 2), 0) AS margin FROM family_scores GROUP BY qid),
family_boosts AS (
  SELECT qid, base, CASE WHEN n_terms < 7 OR (top >= 0.65 AND margin >= 0.20) THEN 1 + (CASE WHEN n_terms >= 7 THEN 0.35::DOUBLE * 0.45::DOUBLE ELSE 0.35::DOUBLE END) * family ELSE 1.0 END AS family_boost
  FROM family_scores JOIN sure USING (qid))"""

COVERAGE = f"""met AS (
  SELECT k.qid, k.doc_id, w.weight, w.anchor,
    CASE WHEN {has_word('lower(d.command)', 'w.term')} THEN 1.0 WHEN {has_word("lower(array_to_string(d.keywords, ' '))", 'w.term')} THEN 0.9
         WHEN {has_word('lower(d.description)', 'w.term')} THEN 0.65 ELSE 0.0 END::DOUBLE AS s,
    max(w.weight) OVER (PARTITION BY k.qid, k.doc_id) AS heaviest
  FROM candidates k JOIN docs d USING (doc_id) JOIN weighted_terms w USING (qid)),
counted AS (
  SELECT qid, doc_id, sum(weight * s) / sum(weight) AS share, count(*) AS n, bool_or(s > 0 AND weight = heaviest) AS top, count(*) FILTER (WHERE s > 0) AS c,
         count(*) FILTER (WHERE s >= 0.9) AS strong, bool_or(anchor) AS anchors, bool_or(anchor AND s > 0) AS anchored FROM met GROUP BY qid, doc_id),
coverage AS MATERIALIZED (
  SELECT qid, doc_id, (0.55::DOUBLE + share) * (CASE WHEN n >= 3 AND NOT top THEN 0.45 ELSE 1 END)::DOUBLE * (CASE WHEN n >= 3 AND share < 0.7 THEN 0.7 ELSE 1 END)::DOUBLE
    * (CASE WHEN n >= 7 AND c < 2 THEN 0.45 ELSE 1 END)::DOUBLE * (CASE WHEN n >= 7 AND strong < 1 THEN 0.70 ELSE 1 END)::DOUBLE * (CASE WHEN n >= 7 AND anchors AND NOT anchored THEN 0.50 ELSE 1 END)::DOUBLE AS coverage
  FROM counted)"""

PROXIMITY = """spoken AS (SELECT DISTINCT qid, term FROM weighted_terms WHERE term <> '' AND NOT contains(term, '_')),
spoken_n AS (SELECT qid, count(*) AS n FROM spoken GROUP BY qid),
spots AS (SELECT doc_id, len(d) AS n_tokens, i AS pos, d[i] AS term FROM (SELECT doc_id, d, unnest(range(1, len(d) + 1)) AS i FROM single)),
near AS (
  SELECT k.qid, k.doc_id, s.n_tokens, s.pos, s.term, lag(s.pos) OVER w AS before_pos, lag(s.term) OVER w AS before_term
  FROM candidates k JOIN spots s USING (doc_id) JOIN spoken q ON q.qid = k.qid AND q.term = s.term WINDOW w AS (PARTITION BY k.qid, k.doc_id ORDER BY s.pos)),
closest AS (SELECT qid, doc_id, any_value(n_tokens) AS n_tokens, count(DISTINCT term) AS c, min(pos - before_pos) FILTER (WHERE term <> before_term) AS gap FROM near GROUP BY qid, doc_id),
proximity AS (
  SELECT qid, doc_id, least(1.0 + 0.20::DOUBLE * least(c / least(4, n)::DOUBLE, 1.0) * (1.0 / (1.0 + gap))::DOUBLE, 1.10::DOUBLE) AS proximity
  FROM closest JOIN spoken_n USING (qid) WHERE n_tokens >= 4 AND n >= 2 AND c >= 2 AND gap IS NOT NULL)"""


def _long_intent() -> str:
    spoken = "said"
    positive, negative, any_of = [], [], []
    for _, cues, good, bad in lexicon.LONG_INTENTS:
        on = f"(len(list_filter({spoken}, lambda x: {one_of('x', cues)})) >= 2)"
        positive.append(f"CASE WHEN {on} THEN {count_words('record', good)} ELSE 0 END")
        negative.append(f"CASE WHEN {on} THEN {count_words('record', bad)} ELSE 0 END")
        any_of.append(on)
    raw = f"1.0 + 0.45::DOUBLE * (({' + '.join(positive)}) - 0.30::DOUBLE * ({' + '.join(negative)}))"
    return f"CASE WHEN n_terms >= 10 AND ({' OR '.join(any_of)}) THEN least(greatest({raw}, 0.65::DOUBLE), 1.70::DOUBLE) ELSE 1.0 END"


def _intent_rule() -> str:
    a = lambda parts: has_any("cmd", parts)
    d = lambda parts: has_any("dsc", parts)
    return f"""CASE intent
      WHEN 'find' THEN CASE WHEN {a(['find', 'search', 'ls', 'grep'])} THEN 2.0 ELSE 1.0 END
      WHEN 'view' THEN CASE WHEN {a(['cat', 'less', 'more', 'head', 'tail', 'view'])} THEN 2.5 WHEN {d(['display', 'show', 'view', 'print'])} THEN 2.0 ELSE 1.0 END
      WHEN 'create' THEN CASE WHEN {a(['mkdir', 'touch', 'create', 'make'])} THEN CASE WHEN contains(cmd, 'makepkg') AND NOT contains(dsc, 'package') THEN 0.6 ELSE 2.0 END ELSE 1.0 END
      WHEN 'delete' THEN CASE WHEN {a(['rm', 'del', 'delete', 'remove'])} THEN 2.0 ELSE 1.0 END
      WHEN 'modify' THEN CASE WHEN {a(['chmod', 'chown', 'edit', 'modify', 'change'])} THEN 2.0 WHEN {d(['permission', 'modify'])} THEN 1.8 ELSE 1.0 END
      WHEN 'install' THEN CASE WHEN {a(['install', 'add', 'setup'])} OR {d(['install'])} THEN 2.0 ELSE 1.0 END
      WHEN 'run' THEN CASE WHEN {a(['run', 'exec', 'start', 'launch'])} THEN 2.0 ELSE 1.0 END
      WHEN 'configure' THEN CASE WHEN {a(['config', 'set', 'configure'])} OR {d(['config'])} THEN 2.0 ELSE 1.0 END
      ELSE 1.0 END::DOUBLE"""


_FOUND = lambda strong, weak: f"CASE WHEN contains(cmd, x) THEN {strong} WHEN contains(dsc, x) THEN {weak} ELSE 1.0 END::DOUBLE"
_PACK = f"CASE WHEN x IN ('compress', 'archive') THEN (CASE WHEN {has_any('cmd', ['tar', 'zip', 'gzip'])} THEN 2.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN {has_any('cmd', ['find', 'locate'])} THEN 0.2 ELSE 1.0 END)::DOUBLE ELSE 1.0 END::DOUBLE"
_MULTIPLIED = lambda l, f: f"list_reduce(list_prepend(1.0::DOUBLE, list_transform({l}, lambda x: {f})), lambda a, b: a * b)"
_WIDE = lambda l: f"(SELECT coalesce(list(DISTINCT y), []) FROM (SELECT unnest({l}) AS y UNION ALL SELECT unnest(s.words) FROM (SELECT unnest({l}) AS z) JOIN lex_synonyms s ON s.word = lower(z)))"
_HAS = lambda l: f"len(list_filter({l}, lambda w: {has_word('record3', 'w')})) > 0"

FEATURES = f"""said AS (SELECT qid, list(DISTINCT term) AS terms, any_value(n_terms) AS n_terms FROM weighted_terms GROUP BY qid),
contexts AS (SELECT qid, list(DISTINCT b) AS contexts FROM (SELECT qid, lower(unnest(keywords)) AS b FROM analysis) WHERE b IN (SELECT base FROM bases) GROUP BY qid),
wide AS MATERIALIZED (
  SELECT a.qid, a.actions, a.targets, a.keywords, a.intent, coalesce(s.n_terms, 0) AS n_terms, list_distinct(list_concat(list_concat(list_concat(coalesce(s.terms, []), a.actions), a.targets), a.keywords)) AS said,
    {_WIDE('a.actions')} AS aw, {_WIDE('a.targets')} AS tw, {_WIDE('a.keywords')} AS kw, coalesce(c.contexts, []) AS contexts, coalesce(e.words, []) AS evidence
  FROM analysis a LEFT JOIN said s USING (qid) LEFT JOIN contexts c USING (qid) LEFT JOIN lex_evidence e ON e.word = a.intent),
rows_ AS (
  SELECT k.qid, k.doc_id, k.score AS raw, w.* EXCLUDE (qid), d.command AS command, lower(d.command) AS cmd, lower(d.description) AS dsc,
    lower(d.command) || ' ' || lower(d.description) || ' ' || lower(array_to_string(d.keywords, ' ')) || ' ' || lower(array_to_string(d.tags, ' ')) AS record,
    lower(d.command || ' ' || d.description || ' ' || array_to_string(d.keywords, ' ')) AS record3, b.base
  FROM candidates k JOIN wide w USING (qid) JOIN docs d USING (doc_id) JOIN bases b USING (doc_id)),
signals AS (
  SELECT *, {_HAS('aw')} AS s1, len(list_filter(contexts, lambda w: {has_word('command', 'w')} OR {has_word('record3', 'w')})) > 0 AS s2, {_HAS('tw')} AS s3, {_HAS('kw')} AS s4, {_HAS('evidence')} AS s5 FROM rows_),
features AS MATERIALIZED (
  SELECT s.qid, s.doc_id, s.raw, coalesce(p.proximity, 1.0) AS proximity, coalesce(c.coverage, 1.0) AS coverage, coalesce(f.family_boost, 1.0) AS family, {_long_intent()} AS long_intent,
    {_intent_rule()} * {_MULTIPLIED('actions', f'{_FOUND(1.5, 1.3)} * {_PACK}')} * {_MULTIPLIED('targets', _FOUND(1.4, 1.2))} AS intent_boost,
    CASE WHEN len(list_filter(actions, lambda x: x <> '' AND contains(cmd || ' ' || dsc, x))) > 0 AND len(list_filter(targets, lambda x: x <> '' AND contains(cmd || ' ' || dsc, x))) > 0 THEN 1.2 ELSE 1.0 END::DOUBLE AS together,
    CASE WHEN s1::INTEGER + s2::INTEGER + s3::INTEGER + s4::INTEGER + s5::INTEGER >= 2
         THEN least(1.0 + 0.35::DOUBLE * s1::INTEGER + 0.25::DOUBLE * s2::INTEGER + 0.20::DOUBLE * s3::INTEGER + 0.12::DOUBLE * s4::INTEGER + 0.20::DOUBLE * s5::INTEGER, 1.9::DOUBLE) ELSE 1.0 END AS cascade
  FROM signals s LEFT JOIN proximity p USING (qid, doc_id) LEFT JOIN coverage c USING (qid, doc_id) LEFT JOIN family_boosts f ON f.qid = s.qid AND f.base = s.base),
scored AS MATERIALIZED (SELECT *, raw * proximity * coverage * family * long_intent * intent_boost * together AS score FROM features)"""


def results(limit: int) -> str:
    return f"""kept AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) <= {max(5 * limit, 10)}),
blended AS (
  SELECT k.qid, k.doc_id, (k.score + CASE WHEN s.rank <= count(*) OVER (PARTITION BY k.qid) THEN s.sim * 35.0::DOUBLE ELSE 0.0 END) * k.cascade AS score
  FROM kept k LEFT JOIN sims s USING (qid, doc_id)),
results AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 4) DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 4) AS score
  FROM blended QUALIFY rank <= {limit})"""


def query(parts: list[str], final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final
