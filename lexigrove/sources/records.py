"""Record collections: YAML and JSON files, Parquet, the personal notebook, and what to do when they cannot be read."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.cluster import ship
from lexigrove.errors import CorpusNotFound, CorpusUnreadable
from lexigrove.schema import RECORD, records

_PLAIN = "path string, nth long, command string, description string, keywords array<string>, tags array<string>, niche string, platform array<string>, pipeline boolean"


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows = yaml.load(bytes(content).decode("utf-8"), Loader=loader) or []
            if not isinstance(rows, list):
                raise ValueError(f"{path}: a list of records is expected at the top level")
            text = lambda r, k: str(r.get(k) or "")
            many = lambda r, k: [str(x) for x in (r.get(k) or [])]
            yield pd.DataFrame(
                [(path, i, text(r, "command"), text(r, "description"), many(r, "keywords"), many(r, "tags"), text(r, "niche"), many(r, "platform"), bool(r.get("pipeline"))) for i, r in enumerate(rows)],
                columns=["path", "nth", "command", "description", "keywords", "tags", "niche", "platform", "pipeline"],
            )


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML files that hold a list of records each; unknown keys are ignored. Ids follow the order of the files and lists."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except Exception as e:
        raise CorpusNotFound(f"no corpus at {path}", context={"path": path}) from e
    ship(spark)
    rows = files.mapInPandas(_parsed, _PLAIN)
    numbered = rows.groupBy("path").agg(F.count("*").alias("n"))
    offsets, at = {}, 0
    for r in sorted(numbered.collect()):  # one row a file
        offsets[r["path"]], at = at, at + r["n"]
    if not offsets:
        return spark.createDataFrame([], RECORD)
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("path")]
    return records(rows.withColumn("doc_id", base + F.col("nth")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines with doc_id."""
    return records(spark.read.schema(RECORD).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.parquet(path))


def write_yaml(df: DataFrame, path: str) -> None:
    """A small collection (a personal notebook) as one YAML list; overwrites the file."""
    import yaml

    names = [f.name for f in RECORD if f.name != "doc_id"]
    with open(path, "w", encoding="utf-8") as out:
        yaml.safe_dump([{k: r[k] for k in names if r[k] not in ("", [], None, False)} for r in records(df).orderBy("doc_id").toLocalIterator()], out, allow_unicode=True, sort_keys=False)


def upsert(notebook: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries take the place of records with an equal command, else follow them with new ids."""
    old, new = records(notebook), records(entries)
    kept_ids = old.groupBy("command").agg(F.min("doc_id").alias("old_id"))
    last = old.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("last"))
    placed = new.join(kept_ids, "command", "left").join(F.broadcast(last))
    placed = placed.withColumn("doc_id", F.coalesce("old_id", F.col("last") + 1 + F.col("doc_id"))).drop("old_id", "last")
    return old.join(new.select("command"), "command", "left_anti").select(*[f.name for f in RECORD]).unionByName(placed.select(*[f.name for f in RECORD]))


def appended(docs: DataFrame, more: DataFrame) -> DataFrame:
    """Further records after those of ``docs``, ids going on; nothing is taken for a duplicate."""
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
    return records(docs).unionByName(records(more).withColumn("doc_id", F.col("doc_id") + F.lit(last + 1)))


# The records that are there when no file can be read.
EMBEDDED = [
    ("ls -la", "list all files in long format", ["list", "files"]), ("cd", "change directory", ["directory", "navigate"]), ("pwd", "print working directory", ["directory", "path"]),
    ("mkdir", "create directory", ["create", "directory"]), ("rm", "remove files", ["delete", "remove"]), ("cp", "copy files", ["copy", "files"]), ("mv", "move or rename files", ["move", "rename"]),
    ("grep", "search text in files", ["search", "text"]), ("find", "find files and directories", ["find", "search"]), ("git status", "show the working tree status", ["git", "status"]), ("git commit", "record changes to the repository", ["git", "commit"]),
]
MINIMAL = [("help", "show help", ["help"]), ("man", "show the manual of a command", ["manual", "help"])]


def _literal(spark: SparkSession, rows: list) -> DataFrame:
    return records(spark.createDataFrame([(i, c, d, k) for i, (c, d, k) in enumerate(rows)], "doc_id long, command string, description string, keywords array<string>"))


def embedded(spark: SparkSession) -> DataFrame:
    """S25"""
    return _literal(spark, EMBEDDED)


def minimal(spark: SparkSession) -> DataFrame:
    """S26"""
    return _literal(spark, MINIMAL)


def delay(attempt: int, base: float = 0.1, factor: float = 2.0, most: float = 5.0) -> float:
    """Seconds before a further attempt (counted from 1)."""
    return min(base * factor ** (attempt - 1), most)


def retried(read: Callable[[], DataFrame], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Try again with growing delays, but not what another attempt cannot mend."""
    for attempt in range(1, attempts + 1):
        try:
            df = read()
            df.limit(1).count()
            return df
        except (CorpusNotFound, PermissionError, ValueError):
            raise
        except Exception as e:
            if attempt == attempts:
                raise CorpusUnreadable("the corpus cannot be read", context={"attempts": attempts}) from e
            sleep(delay(attempt))
    raise CorpusUnreadable("no attempt was made")


def with_fallback(
    spark: SparkSession, read: Callable[[], DataFrame], backup: Callable[[], DataFrame] | None = None, personal: Callable[[], DataFrame] | None = None, sleep: Callable[[float], None] = time.sleep
) -> tuple[DataFrame, str]:
    """(records, where they come from): the corpus, its backup, the embedded records.

    Each source has its attempts and delays (S23, S24). The personal records follow those of the
    corpus; where there is no personal file the corpus stands alone, and one that cannot be read
    counts as a failure of the corpus. Backup and embedded records come without personal ones.
    """

    def whole() -> DataFrame:
        docs = records(read())
        try:
            more = personal() if personal is not None else None
        except CorpusNotFound:
            more = None
        return docs if more is None else appended(docs, more)

    for name, attempt in (("primary", whole), ("backup", backup)):
        if attempt is not None:
            try:
                return retried(attempt, sleep=sleep), name
            except Exception as e:  # the next source is tried, and the reason is told
                logging.getLogger(__name__).warning("the %s corpus cannot be read: %s", name, e)
    return embedded(spark), "embedded"
