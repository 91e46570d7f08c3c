"""Helpers shared by the operators: durable intermediate tables, size-checked
broadcasts and column plumbing that cannot clash with the caller's columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs, and tasks that are run again after an executor
    was lost, read these files and do not compute ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written() -> int:
    """How many intermediate tables there are; release(written()) later deletes those written from then on."""
    return len(_written)


def release(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the intermediate tables written after the first ``since`` of them, but for ``keep``, results of materialize().

    Results that read the deleted ones become unusable.
    """
    kept = {df._written_at for df in keep}
    left = []
    while len(_written) > since:
        spark, path = _written.pop()
        if path in kept:
            left.append((spark, path))
            continue
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
    _written.extend(reversed(left))


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``rows``, the counted size of ``df``, is within ``bound``.

    Beyond it the join stays a shuffled one, whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if rows <= bound else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: What separates words: every ASCII character but letters (lower case) and digits.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), WORD_BREAK), ""), F.array().cast("array<string>"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")
