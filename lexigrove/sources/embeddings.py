"""Binary and text formats of word and record vectors."""

from __future__ import annotations

import struct
import sys
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.cluster import ship

MAGIC, VERSION = b"WTFE", 1  # fixed values: the record vectors' header


def find_asset(name: str, folders: tuple[str, ...] = (".", "assets")) -> str | None:
    """The first of these folders of the driver, and of those beside the running program, that has the file; None if none has."""
    program = Path(sys.argv[0] or ".").resolve().parent
    places = [Path(f) / name for f in folders] + [program / "assets" / name, program / name]
    return next((str(p) for p in places if p.is_file()), None)


def word_rows(data: bytes, dimension: int) -> pd.DataFrame:
    """Little-endian count, then for each word its length (two bytes), bytes and floats. A later copy of a word wins."""
    (n,), at, found = struct.unpack_from("<I", data, 0), 4, {}
    for rank in range(n):
        (size,) = struct.unpack_from("<H", data, at)
        word = data[at + 2 : at + 2 + size].decode("utf-8")
        at += 2 + size
        found[word] = (rank, np.frombuffer(data, "<f4", dimension, at).astype(float).tolist())
        at += 4 * dimension
    return pd.DataFrame([(w, r, v) for w, (r, v) in found.items()], columns=["word", "rank", "vec"])


def read_word_vectors(spark: SparkSession, path: str, dimension: int = 100) -> DataFrame:
    """(word, rank, vec) of binary files; convert large ones to Parquet once."""

    def run(frames):
        for f in frames:
            for content in f["content"]:
                yield word_rows(bytes(content), dimension)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string, rank int, vec array<double>")


def pack_word_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    """The bytes of S6 for (word, vector) rows in their order."""
    out = [struct.pack("<I", len(rows))]
    for word, vec in rows:
        raw = word.encode("utf-8")
        out += [struct.pack("<H", len(raw)), raw, np.asarray(vec, "<f4").tobytes()]
    return b"".join(out)


def header(data: bytes) -> tuple[int, int, int, str, int]:
    """(records, dimension, version, hash, where the floats begin); without the magic the legacy form, count and dimension."""
    if data[:4] == MAGIC:
        version, _, n, dimension, size = struct.unpack_from("<HHIIH", data, 4)
        if version != VERSION:
            raise ValueError(f"unsupported version {version}")
        return n, dimension, version, data[18 : 18 + size].decode("utf-8"), 18 + size
    n, dimension = struct.unpack_from("<II", data, 0)
    return n, dimension, 0, "", 8


def pack_record_vectors(vectors: list[list[float]], digest: str) -> bytes:
    """Record vectors in the order of doc_id, with the digest of the records."""
    raw = digest.encode("utf-8")
    head = MAGIC + struct.pack("<HHIIH", VERSION, 0, len(vectors), len(vectors[0]) if vectors else 0, len(raw)) + raw
    return head + np.asarray(vectors, "<f4").tobytes()


def read_record_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((doc_id, vec), header): vectors at unit length, doc_id their place."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    n, dimension, version, digest, at = header(data)
    m = np.frombuffer(data, "<f4", n * dimension, at).reshape(n, dimension).astype(float)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.where(length > 0, m / np.where(length > 0, length, 1), m)
    df = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "vec": m.tolist()}), "doc_id long, vec array<double>")
    return df, {"n": n, "dimension": dimension, "version": version, "hash": digest}


def aligned(vectors: DataFrame, head: dict, docs: DataFrame, digest: str) -> DataFrame | None:
    """The vectors if they belong to these records: not more than there are, and the same digest (an empty one is accepted)."""
    if head["n"] > docs.count() or (head["hash"] and head["hash"] != digest):
        return None
    return vectors


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of text files, counted from 0 by file and place, whatever the splits.

    Only one row for each split reaches the driver: how many lines it has.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = read.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    rows, before = [], 0
    for r in sorted(splits, key=lambda r: (r["file"], r["start"])):
        rows.append((r["file"], r["start"], before - r["first"]))
        before += r["n"]
    shifts = F.broadcast(spark.createDataFrame(rows, "file string, start long, shift long"))  # a row a split
    return read.join(shifts, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def read_glove(spark: SparkSession, path: str, top: int = 100_000, dimension: int = 100) -> DataFrame:
    """(word, rank, vec) of a text file with a word and its numbers a line: those of the first ``top`` lines that have the right width.

    The rank counts the different words in order; of a word's copies the first gives the place and the last the vector.
    """
    first = numbered_lines(spark, path).filter(F.col("line") < top)
    rows = first.select("line", F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == dimension + 1)
    words = rows.groupBy(F.col("p")[0].alias("word")).agg(F.min("line").alias("place"), F.max_by(F.slice("p", 2, dimension), "line").alias("x"))
    rank = F.row_number().over(Window.orderBy("place")) - 1  # at most ``top`` rows
    return words.select("word", rank.alias("rank"), F.transform("x", lambda v: v.cast("double")).alias("vec"))
