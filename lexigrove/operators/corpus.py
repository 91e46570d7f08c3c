"""A corpus: records and the tables that searches join with.

All tables are long and narrow and keyed by term, gram or doc_id, so that a large corpus is
written once (``save``), bucketed by its key where that helps, and a search touches only
the terms of its queries.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.cluster import dealt_by
from lexigrove.functions import text as X
from lexigrove.schema import records
from lexigrove.sources.records import appended

FIELDS = ("cmd", "desc", "keys", "tags")
#: Rows of a vocabulary that may be broadcast.
VOCABULARY_ROWS = 500_000


def field_tokens(docs: DataFrame) -> DataFrame:
    """A2: (doc_id, cmd, desc, keys, tags) token arrays. Pairs of neighbours count in cmd and keys."""
    joined = lambda c: F.array_join(c, " ")
    one = docs.select("doc_id", X.terms(F.lower("command")).alias("cmd"), X.terms(F.lower("description")).alias("desc"), X.terms(F.lower(joined("keywords"))).alias("keys"), X.terms(F.lower(joined("tags"))).alias("tags"))
    return one.select("doc_id", X.with_bigrams(F.col("cmd")).alias("cmd"), "desc", X.with_bigrams(F.col("keys")).alias("keys"), "tags")


def postings(tokens: DataFrame) -> DataFrame:
    """A1: (term, doc_id, tf_cmd, tf_desc, tf_keys, tf_tags)."""
    tag = lambda name: lambda t: F.struct(t.alias("term"), F.lit(name).alias("field"))
    tagged = F.concat(*[F.transform(f, tag(f)) for f in FIELDS])
    rows = tokens.select("doc_id", F.explode(tagged).alias("t")).select("doc_id", "t.term", "t.field")
    return rows.groupBy("term", "doc_id").agg(*[F.count_if(F.col("field") == f).alias(f"tf_{f}") for f in FIELDS])


def doc_stats(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, len_cmd, ..., n_grams)."""
    grams = docs.select("doc_id", F.size(X.char_grams(gram_text())).alias("n_grams"))
    return tokens.select("doc_id", *[F.size(f).alias(f"len_{f}") for f in FIELDS]).join(grams, "doc_id")


def gram_text() -> Column:
    return F.concat_ws(" ", F.lower("command"), F.lower(F.array_join("keywords", " ")))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n and the mean field lengths over all records."""
    return stats.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(f"len_{f}"), F.lit(0.0)).alias(f"avg_{f}") for f in FIELDS])


def document_frequency(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    """R5"""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def char_postings(docs: DataFrame) -> DataFrame:
    """(gram, doc_id) over command and keywords."""
    return docs.select("doc_id", F.explode(X.char_grams(gram_text())).alias("gram"))


def tfidf_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): share of the term among all terms and pairs of command, description and keywords."""
    words = docs.select("doc_id", X.weighted_terms(F.concat_ws(" ", "command", "description", F.array_join("keywords", " "))).alias("words"))
    rows = words.select("doc_id", F.size("words").alias("n_words"), F.explode("words").alias("term"))
    return rows.groupBy("doc_id", "n_words", "term").agg(F.count("*").alias("c")).select("doc_id", "term", (F.col("c") / F.col("n_words")).alias("tf"))


def tfidf_vocabulary(tf: DataFrame, n: int) -> DataFrame:
    """A4: (term, df, idf) of the terms in at most 80 % of the records (at least one)."""
    counted = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= max(1, n * 8 // 10))
    return counted.withColumn("idf", F.log((1.0 + F.lit(float(n))) / (1.0 + F.col("df"))) + 1.0)


def tfidf_weights(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, doc_id, w)."""
    return tf.join(vocabulary, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def vocabulary_stats(vocabulary: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """Vocabulary size, records, mean number of different vocabulary terms in a record."""
    per = weights.agg(F.count("*").alias("pairs"))
    return vocabulary.agg(F.count("*").alias("vocabulary_size")).crossJoin(per).select("vocabulary_size", F.lit(n).cast("long").alias("total_documents"), (F.col("pairs") / F.lit(max(n, 1))).alias("avg_terms"))


def doc_bases(docs: DataFrame) -> DataFrame:
    """(doc_id, base): the command family of each record."""
    return docs.select("doc_id", X.base_of(F.lower("command")).alias("base"))


def family_counts(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """A3: (token, base, c): in how many records of the family the token occurs; pairs of neighbours do not count."""
    every = F.array_distinct(F.filter(F.concat(*FIELDS), lambda t: ~F.contains(t, F.lit("_"))))
    rows = tokens.select("doc_id", every.alias("every")).join(doc_bases(docs), "doc_id").select("base", F.explode("every").alias("token"))
    return rows.groupBy("token", "base").agg(F.count("*").alias("c"))


@dataclass
class Corpus:
    """Records and their tables. Tables are built on first use and kept by Spark (memory, then disk).

    The records are dealt out by doc_id and sorted by it once; the tables are made of them
    and lie with them, so that joins and groups by doc_id move nothing.
    """

    docs: DataFrame

    @classmethod
    def of(cls, df: DataFrame, *, keep: bool = True) -> Corpus:
        """S3: from any DataFrame that has doc_id and some of the record columns."""
        docs = dealt_by(records(df), "doc_id")
        docs = docs if docs.isStreaming else docs.sortWithinPartitions("doc_id")
        return cls(docs.persist(StorageLevel.MEMORY_AND_DISK) if keep else docs)

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def tokens(self) -> DataFrame:
        return self._kept(field_tokens(self.docs))

    @cached_property
    def postings(self) -> DataFrame:
        return self._kept(postings(self.tokens))

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept(doc_stats(self.docs, self.tokens))

    @cached_property
    def summary(self) -> DataFrame:
        return corpus_stats(self.stats)

    @cached_property
    def totals(self) -> dict:
        """The one row of ``summary``; constants of every search."""
        return self.summary.first().asDict()

    @cached_property
    def df(self) -> DataFrame:
        return self._kept(document_frequency(self.postings))

    @cached_property
    def grams(self) -> DataFrame:
        return self._kept(char_postings(self.docs))

    @cached_property
    def tf(self) -> DataFrame:
        return self._kept(tfidf_terms(self.docs))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._kept(tfidf_vocabulary(self.tf, self.totals["n"]))

    @cached_property
    def weights(self) -> DataFrame:
        words = self.vocabulary
        return self._kept(tfidf_weights(self.tf, F.broadcast(words) if words.count() <= VOCABULARY_ROWS else words))

    @cached_property
    def norms(self) -> DataFrame:
        return self._kept(tfidf_norms(self.weights))

    @cached_property
    def family(self) -> DataFrame:
        return self._kept(family_counts(self.docs, self.tokens))

    def size(self) -> int:
        """S5"""
        return self.docs.count()

    def with_personal(self, personal: DataFrame | None) -> Corpus:
        """Personal records after the main ones, ids going on; nothing is taken for a duplicate."""
        if personal is None:
            return self
        return Corpus.of(appended(self.docs, personal))

    def release(self) -> None:
        """Give back what Spark keeps of the tables."""
        for name in ("tokens", "postings", "stats", "df", "grams", "tf", "vocabulary", "weights", "norms", "family"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        for name in ("summary", "totals"):
            self.__dict__.pop(name, None)

    _SAVED = ("docs", "tokens", "postings", "stats", "df", "grams", "tf", "vocabulary", "weights", "norms", "family")

    def save(self, path: str, buckets: int = 64) -> None:
        """Write all tables below ``path``; those keyed by a term or gram sorted by it, so that a search reads few row groups."""
        for name in self._SAVED:
            table = getattr(self, name)
            key = next((k for k in ("term", "gram", "token") if k in table.columns), None)
            if key:
                table = table.repartitionByRange(buckets, key).sortWithinPartitions(key)
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        """The corpus that save() wrote; its tables are read, not built."""
        corpus = cls(spark.read.parquet(f"{path}/docs"))
        for name in cls._SAVED[1:]:
            corpus.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        return corpus


assert [f.name for f in fields(Corpus)] == ["docs"]


def snapshot_hash(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """SHA-256 over the first records in the order of doc_id, one row with column ``hash``.

    A record is normal(command) 0x1F normal(description) 0x1F its normal keywords joined by
    0x1E, then 0x1D, where normal() trims and lower-cases. The digest needs all bytes in one
    place: use it on record collections, not on a web corpus.
    """
    n = lambda c: F.lower(F.trim(c))
    line = F.concat(n(F.col("command")), F.lit("\x1f"), n(F.col("description")), F.lit("\x1f"), F.array_join(F.transform("keywords", n), "\x1e"), F.lit("\x1d"))
    chosen = docs.select("doc_id", line.alias("line"))
    if limit is not None:
        chosen = chosen.orderBy("doc_id").limit(limit)
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "line")))
    return chosen.agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["line"]), "").cast("binary"), 256).alias("hash"))
