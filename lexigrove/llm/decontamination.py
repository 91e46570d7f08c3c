"""Benchmark decontamination with built-in functions only.

The windows of all benchmark items form a hash set. Its bits travel in the plan as constant
arrays, so that the scan of the documents tests every token window where it stands, in the
same pass that splits the text: each word is hashed once, a window is first probed by its
first and last word's hashes, then by the hash of all its word hashes. Windows that pass are
compared as strings with the set, which verifies them; the covered words and the items
found are then gathered by row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import materialize, small_side, words_of

WINDOW = 10
#: 64-bit words of one bit array at most, and bits a window at least and at most. A set too large for one array has several, all tested in the same scan.
BIT_WORDS, LEAST_BITS, MOST_BITS = 1 << 16, 16, 128
#: Bytes, as counted, of a window table that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Contaminated documents that are broadcast to take them out; more are joined by a shuffle.
REMOVED_ROWS = 100_000


def window_set(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(gram, length, items): each different window and the items that hold it. Shorter items are one window."""
    worded = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.lit(width), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    grams = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, length), " "))
    exploded = worded.select("item", length.alias("length"), F.explode(grams).alias("gram"))
    return exploded.groupBy("gram", "length").agg(F.collect_set("item").alias("items"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _ends(hashes: Column | str, first: Column | int, length: int | Column) -> Column:
    """The hash of a window's first and last word."""
    return F.get(hashes, first).bitwiseXOR(F.shiftright(F.get(hashes, first + length - 1), 1))


def _all(hashes: Column | str, first: Column, length: int | Column) -> Column:
    return F.xxhash64(F.slice(hashes, first + 1, length))


def _bit_arrays(windows: DataFrame, counted: int) -> tuple[Column, int]:
    """(the bit arrays of all blocks of the set, the size of each in bits); the bits are summed where the windows are."""
    blocks = max(1, -(-counted * LEAST_BITS // (64 * BIT_WORDS)))
    size = min(64 * BIT_WORDS, 1 << max(10, (MOST_BITS * counted // blocks).bit_length()))
    hashes = _hashed(F.split("gram", " "))
    probes = [h for name in ("ends", "all") for h in (F.col(name), F.shiftright(name, 32))]
    hashed = windows.select(F.pmod(F.xxhash64("gram"), F.lit(blocks)).cast("int").alias("block"), hashes.alias("h"), "length")
    hashed = hashed.select("block", _ends("h", F.lit(0), F.col("length")).alias("ends"), _all("h", F.lit(0), F.col("length")).alias("all"))
    at = hashed.select("block", F.explode(F.array(*[p.bitwiseAND(F.lit(size - 1)) for p in probes])).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = at.groupBy("block", F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    arrays = [[0] * (size // 64) for _ in range(blocks)]
    for block, word, bits in rows.collect():  # at most BIT_WORDS rows a block
        arrays[block][word] = bits
    return F.from_json(F.lit(json.dumps(arrays)), "array<array<bigint>>"), size


def _probe(h: Column, bits: Column, size: int) -> Column:
    def bit(at: Column) -> Column:
        at = at.bitwiseAND(F.lit(size - 1))
        return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return bit(h) & bit(F.shiftright(h, 32))


def hits(docs: DataFrame, benchmark: DataFrame, carry: dict[str, Column], width: int = WINDOW) -> DataFrame:
    """One row per document: ``carry``, n_words, covered (array of word positions), found (array of items)."""
    windows = materialize(window_set(benchmark, width), "benchmark-windows")
    size_of = F.octet_length("gram") + F.aggregate("items", F.lit(64), lambda n, item: n + F.octet_length(item) + 24)
    counted, volume = windows.agg(F.count("*"), F.coalesce(F.sum(size_of), F.lit(0))).first()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``width`` values
    arrays = {n: _bit_arrays(part, m) for n in lengths if (m := (part := windows.filter(F.col("length") == n)).count())}

    def found(n: int) -> Column:
        blocks, size = arrays[n]
        starts = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
        passed = F.transform(blocks, lambda bits: F.filter(starts, lambda i: _probe(_ends("h", i, n), bits, size) & _probe(_all("h", i, n), bits, size)))
        return F.transform(F.array_distinct(F.flatten(passed)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("gram")))

    none = F.array().cast("array<struct<at:int,n:int,gram:string>>")
    worded = docs.select(*[c.alias(k) for k, c in carry.items()], words_of(F.col("text")).alias("words"))
    worded = worded.select(*carry, "words", _hashed(F.col("words")).alias("h"))
    maybe = worded.select(F.monotonically_increasing_id().alias("uid"), *carry, F.size("words").cast("long").alias("n_words"), (F.concat(*map(found, lengths)) if lengths else none).alias("maybe"))
    opened = maybe.select("uid", *carry, "n_words", F.explode_outer("maybe").alias("w"))
    known = windows.select(F.col("gram").alias("window_gram"), "items")
    sure = opened.join(F.broadcast(known) if volume <= BROADCAST_BYTES else known, opened["w"]["gram"] == known["window_gram"], "left")
    spot = F.when(F.col("items").isNotNull(), F.struct(F.col("w")["at"].alias("at"), F.col("w")["n"].alias("n")))
    gathered = sure.groupBy("uid", *carry, "n_words").agg(F.collect_list(spot).alias("spots"), F.collect_set("items").alias("lists"))
    covered = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    return gathered.select(*carry, "n_words", covered.alias("covered"), F.array_distinct(F.flatten("lists")).alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not
    looked at. Null, empty and wordless texts have no words and no hits; an item without
    words has no window; repeated rows each get their row; items that share an item_id are
    one item, and a null item_id is an item whose id reads as the empty string; an empty
    table gives no rows or no hits. The digest of no items is that of the empty string.
    """
    got = hits(docs, benchmark, {"doc_id": F.col("doc_id")}, width)
    listed = F.array_join(F.array_sort("found"), ",")
    n_hit = F.size("covered").cast("long")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the words that are hit.

    The columns stay as they are, whatever their names. A removed word goes with the
    separator that follows it. Null, empty and wordless texts and null ids stay; repeated
    rows are treated alike; an empty benchmark removes nothing.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    key = {"key_id": F.col("doc_id"), "key_text": F.md5(F.col("text").cast("binary"))}
    bad = hits(docs, benchmark, key, width).filter(F.size("covered") > 0).select("key_id", "key_text", "covered")
    bad = materialize(bad.dropDuplicates(["key_id", "key_text"]), "contaminated")
    side = small_side(bad, bad.count(), REMOVED_ROWS)
    same = docs["doc_id"].eqNullSafe(side["key_id"]) & (F.md5(docs["text"].cast("binary")) == side["key_text"])
    if remove == "documents":
        return docs.join(side, same, "left_anti")
    pieces = F.regexp_extract_all(docs["text"], F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lead = F.when(F.substring(docs["text"], 1, 1).rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    kept = F.filter(pieces, lambda p, j: ~F.array_contains(side["covered"], F.floor((j - lead) / 2).cast("int")) | (j < lead))
    clean = F.when(side["covered"].isNull(), docs["text"]).otherwise(F.array_join(kept, ""))
    return docs.join(side, same, "left").select(*[clean.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])


#: DuckDB form of contamination().
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
spots AS (
  SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT uid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT s.uid, s.i, s.n, g.item FROM spots s JOIN grams g ON s.gram = g.gram AND s.n = g.n),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM found) GROUP BY uid),
items AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT uid, item FROM found) GROUP BY uid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit,
       coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.listed, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid)
"""
