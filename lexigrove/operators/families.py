"""Command families: what the corpus has learned about terms and the first words of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.channels import bounded, eligible_docs
from lexigrove.operators.corpus import Corpus, doc_bases
from lexigrove.options import Options

TOP_BASES, MAX_BONUS = 5, 25.0


def family_scores(corpus: Corpus, terms: DataFrame, n_terms: int) -> DataFrame:
    """(qid, base, family, place, n_terms): the five best families of a query over its different terms, the best at 1."""
    once = terms.groupBy("qid", "term", "n_terms").agg(F.first(F.col("weight") * F.col("entity")).alias("w"))
    total = Window.partitionBy("qid", "term")
    shares = corpus.family.withColumnRenamed("token", "term").join(bounded(once, n_terms), "term").withColumn("share", F.col("c") / F.sum("c").over(total))
    summed = shares.groupBy("qid", "base", "n_terms").agg(F.sum(F.col("w") * F.col("share")).alias("s"))
    w = Window.partitionBy("qid").orderBy(F.round("s", 6).desc(), "base")
    best = summed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= TOP_BASES)
    most = F.max("s").over(Window.partitionBy("qid"))
    return best.filter("s > 0").select("qid", "base", (F.col("s") / most).alias("family"), "place", "n_terms")


def clarity(scores: DataFrame) -> DataFrame:
    """(qid, clarity): 1 less the normalised entropy of the family scores; 1 for a single family."""
    n = F.count("*")
    p = F.col("family") / F.sum("family").over(Window.partitionBy("qid"))
    rows = scores.withColumn("e", -p * F.log(p))
    even = F.least(F.greatest(F.sum("e") / F.log(n.cast("double")), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy("qid").agg(F.when(n <= 1, 1.0).otherwise(1.0 - even).alias("clarity"))


def confidence(scores: DataFrame) -> DataFrame:
    """(qid, top, margin)."""
    first, second = F.max(F.when(F.col("place") == 1, F.col("family"))), F.max(F.when(F.col("place") == 2, F.col("family")))
    return scores.groupBy("qid").agg(first.alias("top"), (first - F.coalesce(second, F.lit(0.0))).alias("margin"))


def expansion_scores(corpus: Corpus, scores: DataFrame, options: Options) -> DataFrame:
    """(qid, doc_id, bonus) for queries of ten terms or more that are not clear about their family."""
    unclear = clarity(scores).filter(F.col("clarity") <= options.family_clarity).select("qid")
    allowed = scores.filter((F.col("n_terms") >= 10) & (F.col("place") <= options.family_bases)).join(unclear, "qid", "left_semi")
    bonus = F.least(MAX_BONUS * F.col("family") * options.family_blend, F.lit(MAX_BONUS))
    bases = doc_bases(corpus.docs).join(eligible_docs(corpus, options), "doc_id", "left_semi")
    return bases.join(F.broadcast(allowed) if options.family_bases <= TOP_BASES else allowed, "base").select("qid", "doc_id", bonus.alias("bonus"))


def family_boosts(scores: DataFrame) -> DataFrame:
    """(qid, base, family_boost); long queries need a clear lead and boost less."""
    rows = scores.join(confidence(scores), "qid")
    long = F.col("n_terms") >= 7
    sure = ~long | ((F.col("top") >= 0.65) & (F.col("margin") >= 0.20))
    boost = F.when(sure & (F.col("family") > 0), 1 + F.when(long, 0.35 * 0.45).otherwise(0.35) * F.col("family")).otherwise(1.0)
    return rows.select("qid", "base", boost.alias("family_boost"))
