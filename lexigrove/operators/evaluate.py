"""Relevance evaluation: results against judged command prefixes, per query, slice and parameter set."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.channels import bounded
from lexigrove.operators.search import Search, search
from lexigrove.options import Bm25, Options

#: Parameter sets that one pass over the records scores.
PASS = 16


def is_relevant(command: Column, relevant: Column, boundary: bool = False) -> Column:
    """A prefix, word boundary or not, or equal leading words; J12 (``boundary``): equal, or a prefix followed by a space."""
    c = F.lower(F.trim(command))
    if boundary:
        return F.exists(relevant, lambda r: (c == F.lower(F.trim(r))) | c.startswith(F.concat(F.lower(F.trim(r)), F.lit(" "))))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")

    def one(r: Column) -> Column:
        r = F.lower(F.trim(r))
        n = F.size(words(r))
        return (r != "") & (c.startswith(r) | ((F.size(words(c)) >= n) & (F.slice(words(c), F.lit(1), n) == words(r))))

    return F.exists(relevant, one)


def judged(results: DataFrame, judgements: DataFrame, boundary: bool = False, configs: list[int] | None = None) -> DataFrame:
    """(qid, slice, n_relevant, rank, hit): results (qid, rank, command) with their judgement; queries without results keep one row of nulls.

    ``configs``: the parameter sets of results that have a column config; every set keeps every query.
    """
    sets = ["config"] if configs is not None else []
    j = judgements.select("qid", F.when(F.trim(F.coalesce("slice", F.lit(""))) == "", "unspecified").otherwise(F.trim("slice")).alias("slice"), "relevant")
    if sets:
        j = j.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    rows = j.join(results.select(*sets, "qid", "rank", "command"), [*sets, "qid"], "left")
    return rows.select(*sets, "qid", "slice", F.size("relevant").alias("n_relevant"), "rank", is_relevant(F.col("command"), F.col("relevant"), boundary).alias("hit"))


def per_query(rows: DataFrame, k: int = 3) -> DataFrame:
    """First relevant rank (0: none), reciprocal rank, top1, hit@k, NDCG@k of judged() rows.

    ``ndcg_ref`` divides by the gain of min(k, judged prefixes) hits and can exceed 1;
    ``ndcg`` is cut at 1.
    """
    hit = F.coalesce("hit", F.lit(False))
    first = F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0))
    gain = F.sum(F.when(hit & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    sets = ["config"] if "config" in rows.columns else []
    g = rows.groupBy(*sets, "qid", "slice", "n_relevant").agg(first.alias("first"), gain.alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_relevant")), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    ndcg = F.when(F.col("n_relevant") > 0, F.col("dcg") / best).otherwise(0.0)
    found = F.col("first") > 0
    return g.select(
        *sets, "qid", "slice", "first", F.when(found, 1.0 / F.col("first")).otherwise(0.0).alias("rr"), (F.col("first") == 1).cast("double").alias("top1"), (found & (F.col("first") <= k)).cast("double").alias("hit"),
        ndcg.alias("ndcg_ref"), F.least(ndcg, F.lit(1.0)).alias("ndcg"),
    )


def _means() -> list[Column]:
    return [F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("top1", "hit", "rr", "ndcg_ref", "ndcg")]]


def summarised(queries: DataFrame) -> DataFrame:
    """Means by slice, and over all with slice ``(all)``."""
    g = queries.rollup("slice").agg(*_means())
    return g.select(F.coalesce("slice", F.lit("(all)")).alias("slice"), "n", "top1", "hit", F.col("rr").alias("mrr"), "ndcg_ref", "ndcg")


def worst(queries: DataFrame, n: int = 15) -> DataFrame:
    """K5: the n queries of the lowest reciprocal rank."""
    return queries.orderBy("rr", "qid").limit(n)


def failures(summary: DataFrame, top1: float = -1, hit: float = -1, mrr: float = -1, ndcg: float = -1) -> DataFrame:
    """(metric, value, floor) that fall below their floors; a floor below 0 is off."""
    rows = [(m, f) for m, f in (("top1", top1), ("hit", hit), ("mrr", mrr), ("ndcg_ref", ndcg)) if f >= 0]
    overall = summary.filter("slice = '(all)'")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(f)).alias("floor")) for m, f in rows]) if rows else F.array().cast("array<struct<metric:string,value:double,floor:double>>")
    return overall.select(F.explode(pairs).alias("x")).select("x.*").filter("value < floor")


def grid(base: Options, **axes: list) -> list[Options]:
    """The product of value lists; axes are k1, min_idf, top_terms, and b_/w_ with cmd, desc, keys, tags."""
    fields, out = ("cmd", "desc", "keys", "tags"), []
    for values in itertools.product(*axes.values()):
        o, chosen = base, dict(zip(axes, values))
        bm: Bm25 = o.bm25
        b, w = list(bm.b), list(bm.weight)
        for name, value in chosen.items():
            if name[:2] == "b_":
                b[fields.index(name[2:])] = value
            elif name[:2] == "w_":
                w[fields.index(name[2:])] = value
        bm = bm.overridden(chosen.get("k1"), chosen.get("min_idf"), tuple(b), tuple(w))
        out.append(replace(o, bm25=bm, top_terms=chosen.get("top_terms", o.top_terms)))
    return out


def evaluate(corpus, queries: DataFrame, options: Options | None = None, k: int = 3, boundary: bool = False) -> DataFrame:
    """A8 for a judged query set (qid, text, slice, relevant)."""
    found = search(corpus, queries.select("qid", "text"), options).join(corpus.docs.select("doc_id", "command"), "doc_id")
    return per_query(judged(found, queries, boundary), k)


def sweep(corpus, queries: DataFrame, configs: list[Options], k: int = 3, boundary: bool = True) -> DataFrame:
    """One summary row per parameter set, best first (NDCG, hit, top1).

    Sets that differ in BM25 only share one search, which scores with up to PASS of them in
    a pass over the records; the corpus tables are shared by all sets.
    """
    like: dict[str, list[tuple[int, Options]]] = {}
    for at, o in enumerate(configs):
        o = o.normal()
        like.setdefault(str(at) if o.use_fuzzy else repr(replace(o, bm25=Bm25())), []).append((at, o))  # a fuzzy search falls back where its own parameters find nothing
    out = None
    for sets in like.values():
        shared = None if sets[0][1].use_fuzzy else Search(corpus, queries.select("qid", "text"), sets[0][1])
        for i in range(0, len(sets), PASS):
            part = dict(sets[i : i + PASS])
            if shared is None:
                rows = evaluate(corpus, queries, sets[0][1], k, boundary).withColumn("config", F.lit(sets[0][0]))
            else:
                found = bounded(shared.alternatives({at: o.bm25 for at, o in part.items()}), len(part) * shared.n_queries * shared.options.limit)
                rows = per_query(judged(corpus.docs.select("doc_id", "command").join(found, "doc_id"), queries, boundary, list(part)), k)
            one = rows.groupBy("config").agg(*_means()).withColumnRenamed("rr", "mrr")
            out = one if out is None else out.unionByName(one)
    out = out.select("n", "top1", "hit", "mrr", "ndcg_ref", "ndcg", "config")
    w = Window.orderBy(F.round("ndcg_ref", 6).desc(), F.round("hit", 6).desc(), F.round("top1", 6).desc(), "config")
    return out.withColumn("place", F.row_number().over(w))  # one row a parameter set


def report_markdown(summary: DataFrame, queries: DataFrame) -> str:
    """Totals, slices from the worst, and the 15 worst queries. Summaries are small by construction."""
    rows = {r["slice"]: r for r in summary.collect()}
    total = rows.pop("(all)")
    line = lambda r, name: f"| {name} | {r['n']} | {r['top1']:.4f} | {r['hit']:.4f} | {r['mrr']:.4f} | {r['ndcg_ref']:.4f} |"
    out = ["# Relevance", "", "| slice | n | top1 | hit@k | MRR | NDCG@k |", "|-|-|-|-|-|-|", line(total, "all")]
    out += [line(r, s) for s, r in sorted(rows.items(), key=lambda kv: (kv[1]["ndcg_ref"], kv[0]))]
    out += ["", "## Worst queries", ""] + [f"- {r['qid']}: first relevant rank {r['first'] or 'none'}" for r in worst(queries).collect()]
    return "\n".join(out) + "\n"


def report_json(summary: DataFrame) -> list[str]:
    """S20"""
    return [r[0] for r in summary.select(F.to_json(F.struct("*"))).collect()]
