"""Manual pages in Markdown (name, description, examples) to records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove import lexicon
from lexigrove.cluster import ship
from lexigrove.functions.text import words_literal
from lexigrove.schema import records

OBJECTS = 8
#: Pages of an archive that go on together.
ARCHIVE_ROWS = 256


def token(c: Column) -> Column:
    """S35"""
    return F.btrim(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "")), F.lit("-_"))


def words(c: Column, least: int = 3) -> Column:
    """The different words of a text that are long enough and say something, in order."""
    parts = F.transform(F.split(F.lower(c), "[^a-zA-Z0-9_-]+"), token)
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(*lexicon.PAGE_STOP_WORDS)))


def family(c: Column) -> Column:
    """S36"""
    first = F.split(F.trim(c), r"\s+")[0]
    return F.coalesce(F.nullif(token(F.element_at(F.split(first, "/"), -1)), F.lit("")), F.lit("general"))


def aliases(description: Column, name: Column) -> Column:
    """Back-ticked commands of up to three words whose family is another."""
    spans = F.regexp_extract_all(description, F.lit("`([^`]+)`"), F.lit(1))
    short = F.filter(F.transform(spans, lambda x: F.trim(x)), lambda s: (F.size(F.split(s, r"\s+")) <= 3) & (s != ""))
    return F.array_distinct(F.filter(F.transform(short, family), lambda f: f != family(name)))


def examples(content: Column) -> Column:
    """(text, command): ``- text`` and the back-ticked line after it."""
    text = F.regexp_extract_all(content, F.lit(r"(?m)^- ([^\n]*)\n+\s*`[^\n]*`"), F.lit(1))
    command = F.regexp_extract_all(content, F.lit(r"(?m)^- [^\n]*\n+\s*`([^\n]*)`"), F.lit(1))
    return F.zip_with(text, command, lambda t, c: F.struct(F.trim(F.regexp_replace(t, ":$", "")).alias("text"), c.alias("command")))


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (folder, path, content) to (path, folder, command, description, keywords, tags, niche)."""
    lines = F.split("content", "\n")
    name = F.trim(F.regexp_replace(lines[0], "^#+", ""))
    before = F.split("content", r"(?m)^-\s")[0]
    about = F.trim(F.array_join(F.transform(F.filter(F.split(before, "\n"), lambda x: x.startswith("> ")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x)))), " "))
    p = pages.withColumn("command", name).withColumn("description", about).withColumn("examples", examples(F.col("content")))
    verb = lambda t: words(F.split(F.trim(t), r"\s+")[0], 2)
    each = lambda f: F.array_distinct(F.flatten(F.transform("examples", f)))
    p = p.withColumn("verbs", each(lambda e: verb(e["text"]))).withColumn("objects", F.array_sort(F.array_except(each(lambda e: words(e["text"])), F.col("verbs")))).withColumn("used", each(lambda e: words(e["command"], 2)))
    tagged = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    fam = family(F.col("command"))
    tags = F.concat(F.array(F.concat(F.lit("family:"), fam)), tagged("alias:", aliases(F.col("description"), F.col("command"))), tagged("verb:", F.array_sort("verbs")), tagged("object:", F.slice("objects", 1, OBJECTS)))
    keywords = F.array_sort(F.array_distinct(F.concat(words(F.col("command"), 2), words(F.col("description")), F.col("verbs"), F.col("used"))))
    return p.select("path", "folder", "command", "description", keywords.alias("keywords"), F.array_distinct(tags).alias("tags"), fam.alias("niche")).filter(F.col("command") != "")


def merged(pages: DataFrame) -> DataFrame:
    """One record a command: the first page's description and niche, all platforms, keywords and tags in order."""
    known = F.create_map(*[x for k, v in lexicon.PAGE_PLATFORMS.items() for x in (F.lit(k), words_literal(v))])
    rows = parsed(pages).withColumn("platform", F.coalesce(F.try_element_at(known, F.col("folder")), F.array().cast("array<string>")))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.groupBy("command").agg(F.min_by("description", "path").alias("description"), F.min_by("niche", "path").alias("niche"), every("platform").alias("platform"), every("keywords").alias("keywords"), every("tags").alias("tags"))
    return records(out.withColumn("doc_id", F.abs(F.xxhash64("command"))))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (folder, path, content) of a directory tree ``<folder>/<page>.md``."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "path", F.col("value").alias("content"))


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                names = [n for n in archive.namelist() if n.endswith(".md")]
                for at in range(0, len(names), ARCHIVE_ROWS):
                    rows = [((["", *n.split("/")])[-2], n, archive.read(n).decode("utf-8", "replace")) for n in names[at : at + ARCHIVE_ROWS]]
                    yield pd.DataFrame(rows, columns=["folder", "path", "content"])


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Pages (folder, path, content) of zip archives of such trees; other members are left out. An archive is one task's work, of at most 2 GB."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unpacked, "folder string, path string, content string")


def html_title(html: Column) -> Column:
    """The text of a web page's title, with its entities as they are."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """A web page without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_links(html: Column) -> Column:
    """Targets and texts of a web page's links."""
    target = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    label = F.regexp_extract_all(html, F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return F.zip_with(target, label, lambda t, s: F.struct(t.alias("target"), s.alias("label")))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)
