"""Mixing sources to target weights by hash-threshold histograms (built-in functions only).

Every row gets a 60-bit hash. For each source the sizes are summed by hash bucket, the
bucket in which the budget runs out is found by a running sum over at most 1024 buckets,
and only that bucket is histogrammed again on the next ten bits, until one hash is left.
The row filter is then ``hash < threshold``: no sort of rows, no draw of random numbers.
Pass p of a source has a budget of its own, and the thresholds are nested: what pass
p + 1 takes, pass p has taken as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import materialize, small_side

HASH_BITS, LEVEL_BITS = 60, 10
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of md5 over seed, id and text. Rows alike in both share it and are decided together."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets of (source, source_size): ``share`` of all sizes split by weight, none above ``most`` x its size.

    ``weights`` repeat over the sources in code-point order, null last. Handing on what is
    above a cap, again and again, ends where one level fits all: sources with a cap below
    ``weight * level`` stop at it, the others get ``weight * level``. The level comes from
    running sums over the sources in the order of cap / weight. One row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.select("source", "source_size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    claims = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / claims)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    levelled = levelled.withColumn("level", F.min(open_level).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """For (source, size, hash) rows: per source the whole passes and the threshold of the partial one.

    The result has source, source_size, target, passes and cut: a row is taken ``passes``
    times, and once more if its hash is below ``cut``.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("passes", whole)
    edge = plan.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")).filter("left > 0")
    running = Window.partitionBy("source").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        e = small_side(edge.withColumnRenamed("source", "edge_source"), n_sources)
        inside = rows.join(e, rows["source"].eqNullSafe(e["edge_source"]) & (F.shiftright(rows["hash"], shift + LEVEL_BITS) == e["prefix"]))
        histogram = inside.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        summed = histogram.withColumn("upto", F.sum("mass").over(running))
        edge = summed.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("mass") < F.col("left")))
        edge = edge.select("source", (F.col("left") - (F.col("upto") - F.col("mass"))).alias("left"), F.col("bucket").alias("prefix"), "mass")
    last = edge.select(F.col("source").alias("edge_source"), (F.col("prefix") + F.when(F.col("left") * 2 > F.col("mass"), 1).otherwise(0)).alias("cut"))
    joined = plan.join(small_side(last, n_sources), plan["source"].eqNullSafe(last["edge_source"]), "left")
    return joined.select("source", "source_size", "target", "passes", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))


def mix_plan(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame, int]:
    """(rows, cuts, number of sources): the sized rows (doc_id, source, size, hash) and each source's thresholds."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"))
    rows = materialize(rows, "mix-rows")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources = sizes.count()
    targets = source_targets(sizes, list(weights), share, most)
    return rows, materialize(thresholds(rows, targets, n_sources), "mix-cuts"), n_sources


def mix_report(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``docs`` needs doc_id, text and source; other columns, whatever their names, are not
    looked at. Null or empty text has size 0 and takes 0 words; a null source is a source;
    rows alike in id and text are taken or left together; no rows give no rows. Each source's
    taken words differ from its target by at most half the size of one document (or of one
    set of rows alike in id and text).
    """
    rows, cuts, n = mix_plan(docs, weights, share, most, seed)
    c = small_side(cuts.withColumnRenamed("source", "cut_source"), n)
    taken = F.col("size") * (F.col("passes") + (F.col("hash") < F.col("cut")).cast("long"))
    return rows.join(c, rows["source"].eqNullSafe(c["cut_source"])).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with its columns as they are.

    Rows without words (null texts among them) cost nothing and stay once; a null source is a
    source; rows alike in id and text are taken alike; whole texts of any length count;
    columns may have any names; no rows give no rows.
    """
    _, cuts, n = mix_plan(docs, weights, share, most, seed)
    names = docs.columns
    boxed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"), word_count(F.col("text")).alias("size"))
    c = small_side(cuts, n)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + (F.col("hash") < F.col("cut")).cast("long")).cast("int")
    joined = boxed.join(c, boxed["row"]["source"].eqNullSafe(c["source"])).select("row", times.alias("times")).filter("times > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: DuckDB form of mix_report() with its standard parameters.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources),
levelled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
              - coalesce(sum(cap) OVER w, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM capped
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fitted AS (
  SELECT *, (SELECT arg_min(level, cap / weight) FROM levelled WHERE level * weight <= cap) AS fit FROM levelled),
targets AS (
  SELECT source, source_size, least(cap, coalesce(fit * weight, cap)) AS target FROM fitted),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets),
keyed AS (SELECT source, h, sum(size) AS mass FROM sized GROUP BY source, h),
summed AS (
  SELECT k.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS remain,
         sum(mass) OVER (PARTITION BY k.source ORDER BY h) AS upto
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source),
decided AS (
  SELECT *, CASE WHEN upto <= remain THEN 1
                 WHEN upto - mass < remain AND (remain - (upto - mass)) * 2 > mass THEN 1 ELSE 0 END AS extra
  FROM summed)
SELECT s.doc_id, s.size, d.source_size::BIGINT AS source_size, round(d.target, 6) AS target,
       (s.size * (d.passes + d.extra))::BIGINT AS taken
FROM sized s JOIN decided d ON s.source IS NOT DISTINCT FROM d.source AND s.h = d.h
"""
