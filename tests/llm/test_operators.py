"""The operators against brute force on small tables, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import decontamination, language_id, lm_scoring, mixing, near_duplicates, perspectives, quality, sharding, topk

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LONG = " ".join(f"w{i}" for i in range(60_000))


def docs_of(spark, rows):
    """Documents whose other columns bear the names of results."""
    full = [(i, t, lang, s, len(t or ""), 1, 2, "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size long, score long, shard string")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (None, "x y", "de", "s2"), (4, LONG, "en", "s2"), (5, "a b c", "en", None), (6, "!!! ???", "en", "s3")]
    return docs_of(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [(1, "a", "en", "s")]).filter("doc_id < 0")


# --- mixing ---------------------------------------------------------------------------------


def fill(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return {**capped, **target}
        capped.update({s: most * sizes[s] for s in over})


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(600)]
    df = docs_of(spark, rows)
    got = mixing.mix_report(df).toPandas()
    assert len(got) == 600 and (got["taken"] <= 2 * got["size"]).all()
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    want = fill(dict(sizes), [3, 1, 2], 1.5, 2.0)
    source = {r[0]: r[3] for r in rows}
    for s, g in got.groupby(got["doc_id"].map(lambda i: str(source[i]))):
        name = None if s == "None" else s
        assert g["target"].iloc[0] == pytest.approx(want[name]) and abs(g["taken"].sum() - want[name]) <= 20
    again = mixing.mix_report(df.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == got["taken"].sum()


def test_mix_odd_rows(odd, none):
    got = mixing.mix_report(odd)
    assert got.count() == 8 and got.filter("doc_id = 2").first()["taken"] == 0
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


# --- decontamination ------------------------------------------------------------------------


def words(t):
    return [w.decode() for w in WORD.findall((t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]


def brute_hits(texts, items):
    grams = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_contamination(spark, monkeypatch, small):
    if small:  # several bit arrays, crowded ones, and no broadcast
        monkeypatch.setattr(decontamination, "BIT_WORDS", 2)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(2)
    vocab = ["É", "ab", "c1", "the", "x", "Zü", "of"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, text(14)), (2, text(10)), (2, text(12)), (3, "Short item"), (4, "..."), (None, text(11)), (5, None)]
    texts = [(i, text(30)) for i in range(15)] + [(20, f"x, {items[0][1].upper().replace('É', 'É')}! y"), (21, "a SHORT-item here"), (22, None), (23, ""), (20, items[1][1]), (24, items[5][1] * 3)]
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, n_words int")
    got = decontamination.contamination(docs_of(spark, [(i, t, "en", "s") for i, t in texts]), b)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_hits(texts, items), key=str)


def test_contamination_by_many_windows(spark):
    """A set of over 200,000 windows: hits inside long items, and near misses that differ in one word."""
    rng = np.random.default_rng(14)
    item = [f"v{i}" for i in rng.integers(0, 50_000, 230_000)]
    items = [(1, " ".join(item[:115_000])), (2, " ".join(item[115_000:])), (3, "short one")]
    texts = []
    for i, at in enumerate(rng.integers(0, 229_000, 60)):
        w = item[at : at + 30]
        if i % 2:
            w[4::9] = ["changed"] * len(w[4::9])
        texts.append((i, "before " + " ".join(w) + " after"))
    texts += [(100, "a short one too"), (101, None), (102, " ".join(item[100:40_000]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs_of(spark, [(i, t, "en", "s") for i, t in texts]), b)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_hits(texts, items), key=str)


def test_decontaminate_removes(spark, odd, none):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    d = docs_of(spark, [(1, "Before ONE two three four five six seven eight nine ten. after", "en", "s"), (2, "clean text", "en", "s"), (None, None, "en", "s")])
    kept = decontamination.decontaminate(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, None}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, b, remove="spans").collect()}
    assert cut == {1: "Before after", 2: "clean text", None: None}
    assert decontamination.contamination(odd, b).count() == 8 and decontamination.contamination(none, b).count() == 0
    assert decontamination.contamination(odd, b.filter("item_id < 0")).filter("contaminated").count() == 0


# --- top k ------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 6), 1)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [rows[50], (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (550, [0.5, 0.5]), (551, [0.1, 0.2]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    ok = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(topk.scaled(df), block=40).collect())) == sorted(want)
    assert topk.top_k(topk.scaled(df.filter("vec_id < 0"))).count() == 0
    every = topk.top_k(topk.scaled(df.filter("vec_id < 400")), every=1)  # more queries than are bounded together, in several rounds
    assert every.filter("vec_id is not null").count() == 5 * 300


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 1, (3000, 8)) * np.array([8, 4, 1, 1, 0.1, 0.1, 0.1, 0.1])).astype(np.int64)
    q = x[:40]
    for (at, score), v in zip(topk.nra_block(np.arange(3000), x, q, 5), q):
        full = x @ v
        order = np.lexsort((np.arange(3000), -full))[:5]
        assert at.tolist() == order.tolist() and score.tolist() == full[order].tolist()


# --- sharding -----------------------------------------------------------------------------------


def check_shards(got, n):
    assert (got["slot"] == got.sort_values(["shard", "slot"]).groupby("shard").cumcount().sort_index()).all()
    assert got["shard"].between(0, n - 1).all() and (got["law"] == "bytes").all() and got["grown_shard"].isna().all()


def test_shards(spark, odd, none):
    rng = np.random.default_rng(6)
    rows = [(i, "word " * int(rng.integers(1, 60)), "en", "s") for i in range(4000)] + [(5000 + i, "the same text", "en", "s") for i in range(2000)]
    got = sharding.shards(docs_of(spark, rows)).toPandas()
    check_shards(got, 40)
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 6000 and len(sums) == 40 and sums.max() - sums.min() < 0.12 * sums.mean()
    again = sharding.shards(docs_of(spark, rows).repartition(5)).toPandas()
    assert got.sort_values("doc_id")["shard"].tolist() == again.sort_values("doc_id")["shard"].tolist()
    few = sharding.shards(odd).toPandas()
    check_shards(few, 40)
    assert len(few) == 8 and few[few["doc_id"] == 2]["size"].tolist() == [16]
    assert sharding.shards(none).count() == 0
    whole = sharding.assign_shards(odd)
    assert set(whole.columns) == set(odd.columns) and whole.count() == 8


@pytest.mark.parametrize("kind", ["random", "even", "hot", "repeated"])
def test_groups_that_fit_a_shard_are_whole(spark, kind):
    """Against the rules stated plainly: which groups may be cut, into how many shards, and how equal the shards are."""
    rng = np.random.default_rng(20)
    sizes = {"random": rng.integers(1, 40, 300), "even": [8] * 40, "hot": [1] * 300, "repeated": [1] * 300}[kind]
    rows, i = [], 0
    for g, n in enumerate(sizes):
        text = f"group {g} " + "y" * int(rng.integers(0, 300) if kind != "even" else 400)
        for _ in range(int(n)):
            rows, i = [*rows, (i, text)], i + 1
    if kind == "even":
        rows += [(i + k, f"lone {k} " + "z" * 400) for k in range(2600)]
    if kind == "hot":  # one text holds a third of all bytes
        rows += [(i + k, "hot " + "x" * 180) for k in range(150)]
    if kind == "repeated":  # one row, id and all
        rows += [(7, "hot " + "x" * 180)] * 150
    got = sharding.shards(docs_of(spark, [(k, t, "en", "s") for k, t in rows]).repartition(4), n_shards=10, range_rows=40).toPandas()
    check_shards(got, 10)
    assert sorted(got["doc_id"]) == sorted(k for k, _ in rows)
    load, mean = got.groupby("shard")["size"].sum().reindex(range(10), fill_value=0), got["size"].sum() / 10
    for _, g in got.groupby("text_crc32"):
        assert g["shard"].nunique() <= (1 if g["size"].sum() <= mean else math.ceil(g["size"].sum() / mean) + 1)
    assert load.max() - load.min() <= 0.1 * mean, load.tolist()


# --- near duplicates ----------------------------------------------------------------------------


def grams(t):
    w = WORD.findall(t.encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [grams(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = sum((a & b).values())
            union = sum(a.values()) + sum(b.values()) - common
            if rows[i][1] is not None and (rows[i][1] == rows[j][1] or (union and common >= 0.8 * union)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(k) for k, (i, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def copies():
    """Texts, exact copies, and near copies of one text with more and more words changed."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [[word() for _ in range(int(rng.integers(20, 120)))] for _ in range(30)]
    rows = [" ".join(b) for b in base]
    for k in range(90):
        b = list(base[k % 30] if k < 40 else base[0])
        for _ in range(int(rng.integers(0, 6))):
            b[int(rng.integers(0, len(b)))] = word()
        rows.append(" ".join(b))
    rows += [rows[3], rows[3], "one two", "one two", "", "", "!!", None, None, "a b a b a b a b a b"]
    return [(100 + i, t) for i, t in enumerate(rows)]


def test_near_duplicate_classes(spark, copies):
    got = near_duplicates.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in copies]).repartition(4)).toPandas()
    want = brute_classes(copies)
    smallest = {}
    for i, _ in copies:
        smallest.setdefault(want[i], i)
    assert dict(zip(got["doc_id"], got["class_id"])) == {i: smallest[want[i]] for i, _ in copies}
    assert got["kept"].sum() == got["class_id"].nunique()


def test_deduplicate(spark, copies, odd, none):
    d = docs_of(spark, [(i, t, "en", "s") for i, t in copies])
    kept = near_duplicates.deduplicate(d)
    classes = brute_classes(copies)
    assert kept.columns == d.columns and kept.count() == len(set(classes.values()))
    left = near_duplicates.deduplicate(odd)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (True, None)]
    assert near_duplicates.near_duplicates(odd).count() == 8
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.deduplicate(none).count() == 0


def union_find(links):
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in list(parent)}


@pytest.mark.parametrize("shape", ["path", "tree", "cycle", "many"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(len(shape))
    n = 200
    names = rng.permutation(n)
    ends = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "tree": [(int(rng.integers(0, i)), i) for i in range(1, n)],
        "cycle": [(i, (i + 1) % 4) for i in range(4)] + [(4 + i, 4 + (i + 1) % (n - 4)) for i in range(n - 4)],
        "many": [(int(a), int(b)) for a, b in rng.integers(0, n, (120, 2))],
    }[shape]
    links = [(int(names[a]), int(names[b])) for a, b in ends]
    got, count = near_duplicates.components(spark.createDataFrame(links, "a long, b long"))
    want = union_find([x for x in links if x[0] != x[1]])
    assert dict(map(tuple, got.collect())) == want and count == len(want)


def chain(n, step, words=160):
    """Texts each of which has ``step`` more new words in front than the one before: neighbours are similar, the ends are not."""
    long = [f"c{i}" for i in range(words + n * step)]
    return [" ".join(long[i * step : i * step + words]) for i in range(n)]


def test_chained_near_duplicates_are_one_class(spark):
    rng = np.random.default_rng(12)
    texts = chain(12, 10) + ["alone " + " ".join(f"z{i}" for i in range(50))]
    ids = rng.permutation(len(texts)) + 1
    rows = [(int(i), t) for i, t in zip(ids, texts)]
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert len({got[int(i)]["class_id"] for i in ids[:12]}) == 1 and got[int(ids[0])]["members"] == 12
    assert got[int(ids[12])]["members"] == 1 and sum(r["kept"] for r in got.values()) == 2


def test_slices_count_exactly(spark):
    """Texts of several slices, of different levels, and hubs dealt over several groups have the same links."""
    rng = np.random.default_rng(13)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 700)]
    rows = [(i, " ".join(base[: 480 + 20 * i])) for i in range(12)]
    for i in range(12, 40):
        b = list(base[: int(rng.integers(500, 560))])
        for at in rng.integers(0, 500, int(rng.integers(0, 25))):
            b[at] = "other"
        rows.append((i, " ".join(b)))
    text = {i: t for i, t in rows}
    units = spark.createDataFrame([(near_duplicates_key(t), t) for t in text.values()], "key binary, text string").mapInArrow(near_duplicates._units(0.8, 64), "key binary, level int, part int, own boolean, units array<long>")
    every = [(a, b) for a in text for b in text if a < b]
    size = {i: sum(grams(t).values()) for i, t in text.items()}
    pairs = spark.createDataFrame([(near_duplicates_key(text[a]), near_duplicates_key(text[b]), size[a], size[b]) for a, b in every if min(size[a], size[b]) >= 0.8 * max(size[a], size[b])], "a binary, b binary, weight_a long, weight_b long")
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_duplicates._linked(pairs, units, 0.8, 64, 2).collect()}
    want = set()
    for a, b in every:
        x, y = grams(text[a]), grams(text[b])
        if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
            want.add((near_duplicates_key(text[a]), near_duplicates_key(text[b])))
    assert got == want and len(want) > 20


def near_duplicates_key(t):
    return hashlib.md5(t.encode()).digest()


def test_recall_of_all_similar_pairs(spark):
    """Every pair of the table at 0.8 or more lies in one class, and classes are those of the exact links."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    sets, by_gram = {i: grams(t or "") for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    met = {(a, b) for members in by_gram.values() for k, b in enumerate(members) for a in members[:k]}
    links = [(a, b) for a, b in met if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())]
    equal = defaultdict(list)
    for i, t in rows:
        if t is not None:
            equal[t].append(i)
    links += [(x[0], i) for x in equal.values() for i in x[1:]]
    want = union_find(links)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: want.get(i, i) for i, _ in rows}


def test_long_texts_without_spaces_are_one_word():
    """The words and shingles of a text do not depend on where it is cut."""
    import pyarrow as pa

    from lexigrove.llm import bytes_kernel

    texts = ["x" * 5_000_000, "\n".join(f"line{i}" for i in range(40_000)), "a-b " * 60_000, "tail"]
    counts = Counter()
    for chunk, starts, rows in bytes_kernel.chunks(pa.array(texts)):
        _, at = bytes_kernel.word_hashes(chunk)
        counts.update(rows[np.searchsorted(starts, at, "right") - 1].tolist())
    assert [counts[i] for i in range(4)] == [1, 40_000, 120_000, 1]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**62, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 9, 300), rng.uniform(0.2, 9, 300)
    owner = np.repeat([0, 1], 300)
    s = near_duplicates.dart_signatures(owner, np.concatenate([e, e]), np.concatenate([a, b]), 2, k=4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


# --- models -------------------------------------------------------------------------------------


def test_language(spark, odd, none):
    rng = np.random.default_rng(9)
    syllables = {"aa": ["ba", "do", "ki"], "bb": ["ész", "üt", "öl"], "cc": ["str", "cht", "ung"]}
    text = lambda k: " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(int(rng.integers(3, 40))))
    rows = [(i, text(k), k, "s") for i in range(300) for k in [list(syllables)[i % 3]]]
    extra = [(1000, None, "aa", "s"), (1001, "123 !!", "aa", "s"), (1002, "", None, "s"), (1003, text("bb"), None, "s"), (1003, text("bb"), None, "s")]
    got = language_id.language_report(docs_of(spark, rows + extra)).toPandas()
    lang = {r[0]: r[2] for r in rows}
    held = got[got["held_out"] & (got["doc_id"] < 1000)]
    assert len(got) == 305 and len(held) > 40 and (held["lang_pred"] == held["doc_id"].map(lang)).all()
    assert set(got[got["doc_id"].isin([1000, 1001, 1002])]["lang_pred"]) == {"und"} and set(got[got["doc_id"] == 1003]["lang_pred"]) == {"bb"}
    assert got["score"].between(0, 1).all()
    assert language_id.language_report(none).count() == 0 and language_id.language_report(odd).count() == 8


def test_every_language_trains(spark):
    """Languages of one to three rows train with all of them; one of many copies of a row is not lost."""
    from lexigrove.llm import char_lm

    rows = [(i * 10 + j, f"{chr(97 + i)}{chr(98 + j)}x", f"l{i:02}", "s") for i in range(20) for j in range(1 + i % 3)]
    copies = [(1000 + i, f"copy{chr(97 + i)}", f"m{i}", "s") for i in range(9) for _ in range(40)]
    model = language_id.train(docs_of(spark, rows + copies), F.lit(True), 5, 2).model
    assert model.names == sorted({r[2] for r in rows + copies})
    grams = set()
    for text in {r[1] for r in rows + copies}:
        s = [0, *text.encode(), 0]
        grams |= {bytes(s[max(0, k - 3) : k + 1]).lstrip(b"\0") if s[k] else bytes(s[max(1, k - 3) : k + 1]) for k in range(1, len(s))}
    assert len(model.grams[char_lm.ORDER - 1].hashes) - 1 == len(grams)


def test_probabilities_sum_to_one(spark):
    from lexigrove.llm import bytes_kernel, char_lm
    import pyarrow as pa

    table = char_lm.letters_table()
    chunk, starts, _ = next(bytes_kernel.chunks(pa.array(["the cat and the dog", "der hund"])))
    s, index = char_lm.symbols(chunk, starts, table)
    keys = char_lm.gram_keys(s)
    different, which = np.unique(keys, return_inverse=True)
    counts = np.zeros((len(different), 2))
    np.add.at(counts, (which, (np.arange(len(s)) >= index[1]).astype(int)), 1)
    model = char_lm.build(["en", "de"], different, counts)
    for context in ("", "t", "th", "the", "xyz"):
        head = 0
        for c in context[-3:]:
            head = (head << 16) | ord(c)
        every = np.array([(head << 16) | int(v) for v in list(np.unique(s)) + [999]], dtype=np.uint64)
        assert np.exp(model.log_prob(every).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_long_texts_are_cut_without_loss():
    from lexigrove.llm import bytes_kernel
    import pyarrow as pa

    texts = ["é" * 300_000, None, "", LONG, "a b"]
    got = defaultdict(bytes)
    for chunk, starts, rows in bytes_kernel.chunks(pa.array(texts)):
        for a, b, r in zip(starts, np.append(starts[1:], len(chunk)), rows):
            piece = chunk[a : b - 1]
            piece.decode("utf-8")
            got[int(r)] += piece
    assert [got[i].decode() for i in range(5)] == [t or "" for t in texts]


def test_quality(spark, odd, none):
    rng = np.random.default_rng(10)
    good = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)) + "."
    bad = lambda: " | ".join("".join(rng.choice(list("ABCDE"), 5)) + "!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(9999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs_of(spark, rows + [(500, None, "en", "s"), (501, "", "en", "s")]), labels).toPandas()
    held = got[got["held_out"] & (got["doc_id"] < 400)]
    assert len(got) == 402 and (held["predicted"] == (held["doc_id"] % 3 > 0).astype(int)).mean() > 0.95
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    a, b = (got[got["doc_id"] == i]["score"].iloc[0] for i in (500, 501))
    assert a == b
    assert quality.quality_report(odd, labels.filter("doc_id < 0")).toPandas()["score"].tolist() == [0.5] * 8
    assert quality.quality_report(none, labels).count() == 0
    kept = quality.keep_good(docs_of(spark, rows), labels)
    assert "score" in kept.columns and kept.count() == pytest.approx(266, abs=8)
    own = docs_of(spark, rows).withColumn("quality_score", F.col("doc_id") * 2).withColumn("__quality_score", F.lit("x"))
    kept = quality.keep_good(own, labels)
    assert kept.columns == own.columns and kept.filter("quality_score <> doc_id * 2 or __quality_score <> 'x'").count() == 0


def test_quality_reads_words_in_order():
    """The encoder tells a text from the same words in another order, and from the same letters in other words."""
    import pyarrow as pa

    rng = np.random.default_rng(15)
    nouns, verbs = [f"noun{c}" for c in "abcdefgh"], [f"verb{c}" for c in "abcdefgh"]
    good = [" ".join(w for _ in range(60) for w in (str(rng.choice(nouns)), str(rng.choice(verbs)))) for _ in range(300)]
    mixed = [" ".join(rng.permutation(t.split())) for t in good]
    parts = [list(quality.passages(pa.array(kind))) for kind in (good[:200], mixed[:200])]
    row = np.concatenate([np.concatenate([r for r, _ in p]) + 200 * k for k, p in enumerate(parts)])
    x = np.concatenate([np.concatenate([x for _, x in p]) for p in parts])
    model = quality.fit(row, x, np.repeat([1.0, 0.0], 200))
    assert (quality.score_texts(model, pa.array(good[200:])) > 0.5).mean() > 0.9
    assert (quality.score_texts(model, pa.array(mixed[200:])) < 0.5).mean() > 0.9


def test_quality_equals_brute_force():
    """Scores of whole texts, in chunks with a running softmax, are those of one softmax over all passages; long texts count to their end."""
    import pyarrow as pa

    rng = np.random.default_rng(16)
    model = quality.fit(np.arange(40), rng.normal(0, 1, (40, quality.FEATURES)).astype(np.float32), (np.arange(40) % 2).astype(float))
    texts = ["a few words", "", None, "w\n" * 300_000, "x" * 700_000, LONG]
    got = quality.score_texts(model, pa.array(texts))
    for t, score in zip(texts, got):
        x = np.concatenate([x for _, x in quality.passages(pa.array([t], pa.string()))])
        assert len(x) >= max(1, len(t or "") // quality.PASSAGE)
        h, s = model.embed(x)
        e = np.exp(s.astype(float) - s.max())
        assert score == pytest.approx(float(model.score((e[:, None] * h).sum(axis=0)[None] / e.sum())[0]), abs=1e-5)
    length = quality.CLASSES + quality.CLASSES**2 + 4  # the place of the length
    assert {round(float(v), 4) for _, x in quality.passages(pa.array([texts[3]])) for v in x[:, length]} == {round(math.log1p(600_000) / 10, 4)}


def test_attention_weighs_passages():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, quality.FEATURES)).astype(np.float32) * 0.1
    bag = np.repeat(np.arange(200), 3)
    label = (np.arange(200) % 2).astype(float)
    x[bag * 1 == bag, 0] += 0
    x[np.arange(200)[label == 1] * 3, 5] += 3.0  # one passage of a good document tells
    model = quality.fit(bag, x, label)
    h, s = model.embed(x)
    e = np.exp(s - s.max())
    z = np.add.reduceat(e[:, None] * h, np.arange(0, 600, 3)) / np.add.reduceat(e, np.arange(0, 600, 3))[:, None]
    assert ((model.score(z) > 0.5) == (label == 1)).mean() > 0.95


def test_lm_scores(spark, odd, none):
    rng = np.random.default_rng(11)
    kinds = {0: list("abcd"), 1: list("wxyz")}
    rows = [(i, " ".join("".join(rng.choice(kinds[i % 2], 4)) for _ in range(30)), "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = lm_scoring.score_documents(docs_of(spark, rows + [(500, None, "", "s"), (501, " \n", "", "s")]), labels).toPandas().set_index("doc_id")
    assert got.loc[[i for i in range(200) if i % 2]]["score"].max() < got.loc[[i for i in range(200) if not i % 2]]["score"].min()
    assert got.loc[500]["n_tokens"] == 0 and np.isnan(got.loc[501]["score"])
    assert got["n_tokens"].loc[0] == 30 * 5
    assert lm_scoring.score_documents(odd, labels).count() == 8 and lm_scoring.score_documents(none, labels).count() == 0


def full_losses(corpus, texts):
    """(target, background) mean losses of texts under models of all grams of the corpus (text, is_target)."""
    import pyarrow as pa

    from lexigrove.llm import bytes_kernel, char_lm

    def keys_of(text):
        chunk, starts, _ = next(bytes_kernel.chunks(pa.array([text])))
        return char_lm.gram_keys(char_lm.symbols(chunk, starts, char_lm.visible_table())[0])

    parts = [np.unique(keys_of(t), return_counts=True) + (flag,) for t, flag in corpus]
    keys, counts = char_lm._summed(np.concatenate([p[0] for p in parts]), np.concatenate([np.stack([n * flag, n], axis=1) for _, n, flag in parts]))
    model = char_lm.build(["target", "background"], keys, counts)
    return np.array([-model.log_prob(keys_of(t)).mean(axis=0, dtype=np.float64) for t in texts])


def test_lm_keeps_rare_grams_of_a_large_corpus(spark):
    """Over five million grams, so that a gram seen once has less than 2e-7 of them."""
    corpus = [("the cat sat on a mat " * 6000, False)] * 48 + [("zyx wvuq jkl", True), ("zyx wvuq fgh", False)]
    rows = [(i, t, "", "s") for i, (t, _) in enumerate(corpus)]
    labels = spark.createDataFrame([(48, 1)], "doc_id long, quality int")
    got = lm_scoring.score_documents(docs_of(spark, rows), labels).toPandas().set_index("doc_id")
    assert got["n_tokens"].sum() > 5_000_000
    expected = full_losses(corpus, [corpus[i][0] for i in (0, 48, 49)])
    assert np.allclose(got.loc[[0, 48, 49], ["loss_target", "loss_background"]], expected, rtol=1e-4)



def plain_losses(corpora, texts, words):
    """Summed losses of texts under an interpolated Kneser-Ney model of order 4 for each corpus, and their tokens, by plain counting.

    ``words`` splits a text into its runs; a token is a character or a run's end, and its
    context the (up to three) characters before it in the run.
    """

    def grams(text):
        return [tuple(("\0\0\0" + w + "\0")[i : i + 4]) for w in words(text) for i in range(len(w) + 1)]

    levels = [[Counter(g for t in c for g in grams(t)) for c in corpora]]
    for _ in range(3):
        levels.insert(0, [Counter(g[1:] for g in n) for n in levels[0]])
    kinds = max(1, len(set().union(*levels[0])))

    def p(model, gram):
        below = 1.0 / (kinds + 1) if len(gram) == 1 else p(model, gram[1:])
        n = levels[len(gram) - 1][model]
        follow = [k for g, k in n.items() if g[:-1] == gram[:-1]]
        ones, twos = sum(k == 1 for k in n.values()), sum(k == 2 for k in n.values())
        d = min(max((ones + 0.5) / (ones + 2 * twos + 1), 0.05), 0.95)
        return below if not follow else max(n[gram] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * below

    return [([-sum(math.log(p(m, g)) for g in grams(t)) for m in range(len(corpora))], len(grams(t))) for t in texts]


def test_lm_equals_plain_counting(spark):
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 6)))
    rows = [(i, text("abcé"[: 2 + i % 3]), "", "s") for i in range(24)] + [(30, None, "", "s"), (31, " \t\n", "", "s"), (2, "ab  ba\nab", "", "s")]
    docs = docs_of(spark, rows).selectExpr("*", "'x' part", "1 block", "2 gram", "'y' target_id", "3 background", "4 n_tokens")
    labels = [(i, i % 2) for i in range(20)] + [(1, 0), (None, 1), (99, 1)]
    got = lm_scoring.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    good = {i for i, q in labels if q == 1}
    texts = [r[1] or "" for r in rows]
    expected = plain_losses([[r[1] or "" for r in rows if r[0] in good], texts], texts, str.split)
    mine = sorted((r["doc_id"], r["n_tokens"], r["loss_target"] if r["n_tokens"] else -1.0, r["loss_background"] if r["n_tokens"] else -1.0) for r in got)
    want = sorted((r[0], n, *(x / n if n else -1.0 for x in losses)) for r, (losses, n) in zip(rows, expected))
    assert [m[:2] for m in mine] == [w[:2] for w in want] and np.allclose([m[2:] for m in mine], [w[2:] for w in want], rtol=1e-4)


def test_lm_without_a_target(spark):
    got = lm_scoring.score_documents(docs_of(spark, [(1, "ab", "", "s"), (2, "b", "", "s")]), spark.createDataFrame([(1, 0)], "doc_id long, quality int")).collect()
    assert [round(r["loss_target"], 4) for r in got] == [round(math.log(4), 4)] * 2  # two letters and the end of a run


def test_language_model_equals_plain_counting(spark):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 6)))
    corpora = {"xx": [text("abß") for _ in range(12)], "yy": [text("bÉd") for _ in range(12)]}
    rows = [(i, t, k, "s") for k in corpora for i, t in enumerate(corpora[k])]
    model = language_id.train(docs_of(spark, rows), F.lit(True), 100, 2).model
    asked = ["ab bd", "Bad-é7ß", "", "12 !", *corpora["xx"][:3], *corpora["yy"][:3]]
    total, n = language_id.losses(model, pa.array(asked))
    for (want, _), got in zip(plain_losses([corpora["xx"], corpora["yy"]], asked, lambda t: re.findall(r"[^\W\d_]+", t.lower())), total):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
    assert [bool(k) for k in n] == [True, True, False, False] + [True] * 6


# --- chat and tokens ----------------------------------------------------------------------------


def brute_views(rows, size):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, re.sub(r"\s+", "_", role or "unknown").replace("<|", "< |"), (text or "").replace("<|", "< |")))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        for who in {t[2] for t in turns} - {"system"}:
            for p in range(0, len(turns), size):
                text, mask = "", []
                for _, _, speaker, said in turns[p : p + size]:
                    head = speaker if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                    text += f"<|im_start|>{head}\n"
                    if speaker == who:
                        mask.append((len(text), len(text) + len(said) + 10))
                    text += said + "<|im_end|>\n"
                out.append((conv, who, p // size, len(turns[p : p + size]), text, mask))
    return out


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo é"), (1, 2, "bob b", "yo é"), (1, None, None, None), (2, 0, "system", "alone"), (None, 1, "ann", "x"), (None, 2, "user", "")]
    rows += [(3, i, ["user", "assistant", "critic"][i % 3], f"t{i}") for i in range(150)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = [(r["conv_id"], r["assistant"], r["part"], r["n_turns"], r["rendered"], [tuple(m) for m in r["mask"]]) for r in perspectives.rotate(df).collect()]
    assert sorted(got, key=str) == sorted(brute_views(rows, 64), key=str)
    for _, _, _, _, text, mask in got:
        assert all(text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>") for a, b in mask)
    assert perspectives.rotate(df.filter("conv_id < 0")).count() == 0


token_counts = pytest.importorskip("lexigrove.llm.token_counts")
PATH = token_counts.default_vocabulary()


@pytest.mark.skipif(PATH is None, reason="needs a vocabulary file")
def test_edited_counts(spark, odd, none):
    import random

    from hypothesis import given, settings
    from hypothesis import strategies as st

    tokenizer = token_counts.Tokenizer(PATH)
    text = st.text(alphabet="ab'slrve  \n\t1é.!  ", max_size=200)

    @settings(max_examples=150, deadline=None)
    @given(text, st.lists(st.tuples(st.integers(0, 220), st.integers(0, 12), st.text(alphabet="ab'sl \n1.", max_size=8)), max_size=6))
    def same(t, edits):
        tree = token_counts.TokenTree(t, tokenizer)
        for start, length, put in edits:
            start = min(start, len(t))
            t = t[:start] + put + t[start + length :]
            tree.edit(start, length, put)
            assert tree.text == t and tree.tokens == len(tokenizer._encode(t)) and tree.pretokens == len(tokenizer.split(t))

    same()
    tree = token_counts.TokenTree(LONG, tokenizer)
    random.seed(1)
    for _ in range(50):
        tree.edit(random.randrange(len(tree.text)), 5, " new words")
    assert tree.tokens == len(tokenizer._encode(tree.text)) and tree.encoded < 50 * 20
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit(None).cast("string").alias("replacement")), F.lit(None))
    got = token_counts.edited_counts(odd, edits, PATH).toPandas()
    assert len(got) == 8 and got[got["doc_id"] == 2]["n_tokens"].tolist() == [0] and got[got["doc_id"] == 1]["n_chars_after"].tolist() == [4, 4]
    assert token_counts.edited_counts(none, edits, PATH).count() == 0
    stated = token_counts.stated_edits(F.col("doc_id"), F.col("text"))
    rows = [(1, "It's 5 o'clock, isn't it?  Yes.\n\nNo"), (2, ""), (3, None), (4, "é" * 40 + " end"), (5, LONG[:3000])]
    d = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    asked = {r["doc_id"]: r["e"] for r in d.select("doc_id", stated.alias("e")).collect()}
    for r in token_counts.edited_counts(d, stated, PATH).collect():
        t = dict(rows)[r["doc_id"]] or ""
        assert (r["n_chars"], r["n_tokens"], r["n_pretokens"], r["n_edits"]) == (len(t), len(tokenizer._encode(t)), len(tokenizer.split(t)), 3)
        for e in asked[r["doc_id"]]:
            t = t[: e["start"]] + e["replacement"] + t[e["start"] + e["length"] :]
        assert (r["n_chars_after"], r["n_tokens_after"]) == (len(t), len(tokenizer._encode(t)))


def test_token_counts_need_a_vocabulary(spark, odd):
    for path in (None, "/nowhere/vocabulary"):
        with pytest.raises(ValueError, match="vocabulary"):
            token_counts.edited_counts(odd, F.lit(None), path)
