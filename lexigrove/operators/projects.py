"""Projects from their files: types, language, build system, scripts, targets, and the term boosts they give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove import lexicon

LISTED = 1.3


def project_types(files: DataFrame) -> DataFrame:
    """Q15: (project_id, type, language, build_system, nth): one row for each file and rule that fits; files (project_id, filename)."""
    rules = [F.when(F.col("filename").rlike(p), F.struct(F.lit(i).alias("nth"), F.lit(t).alias("type"), F.lit(lang).cast("string").alias("language"), F.lit(b).cast("string").alias("build_system"))) for i, (t, p, lang, b) in enumerate(lexicon.PROJECT_FILES)]
    hits = files.select("project_id", "filename", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    return hits.select("project_id", "filename", "r.*")


def contexts(files: DataFrame) -> DataFrame:
    """One row a project: types (in the order of the file names), language and build_system of the first and last file that say so, has_git, has_docker."""
    hits = project_types(files)
    at = F.struct("filename", "nth")
    first = hits.groupBy("project_id", "type").agg(F.min(at).alias("at"))
    types = first.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]).alias("types"))
    facts = hits.groupBy("project_id").agg(F.min_by("language", F.when(F.col("language").isNotNull(), at)).alias("language"), F.max_by("build_system", F.when(F.col("build_system").isNotNull(), at)).alias("build_system"))
    rows = files.select("project_id").distinct().join(types, "project_id", "left").join(facts, "project_id", "left")
    types = F.coalesce("types", F.array(F.lit("generic")))
    return rows.select("project_id", types.alias("types"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("build_system", F.lit("")).alias("build_system"), F.array_contains(types, "git").alias("has_git"), F.array_contains(types, "docker").alias("has_docker"))


def package_scripts(files: DataFrame) -> DataFrame:
    """Q16: (project_id, term) of the scripts in package.json contents."""
    scripts = F.map_keys(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>"))
    return files.filter("filename = 'package.json'").select("project_id", F.explode(scripts).alias("term"))


def make_targets(files: DataFrame) -> DataFrame:
    """Q17: (project_id, term) of the targets in makefiles."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")) & ~x.startswith("#"))
    names = F.filter(F.transform(lines, lambda x: F.trim(F.split(x, ":")[0])), lambda t: (t != "") & ~F.contains(t, F.lit("=")) & ~t.startswith("."))
    return files.filter(F.col("filename").isin("Makefile", "makefile")).select("project_id", F.explode(names).alias("term"))


def context_boosts(files: DataFrame) -> DataFrame:
    """Q14: (project_id, term, boost): later types win over earlier ones, scripts and targets over types."""
    listed = {t: [{"term": k, "boost": v} for k, v in b.items()] for t, b in lexicon.PROJECT_BOOSTS.items()}
    of = F.from_json(F.lit(json.dumps(listed)), "map<string,array<struct<term:string,boost:double>>>")
    typed = contexts(files).select("project_id", F.posexplode("types").alias("at", "type")).select("project_id", "at", F.explode(F.try_element_at(of, F.col("type"))).alias("b"))
    rows = typed.select("project_id", "at", "b.term", "b.boost")
    if "content" in files.columns:
        own = package_scripts(files).union(make_targets(files)).select("project_id", F.lit(1000).alias("at"), "term", F.lit(LISTED).alias("boost"))
        rows = rows.unionByName(own)
    w = Window.partitionBy("project_id", "term").orderBy(F.col("at").desc())
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("project_id", "term", "boost")


def description(ctx: DataFrame) -> DataFrame:
    """Q18: (project_id, text): the types and the build system in words."""
    types = F.array_join(F.transform("types", lambda t: F.concat(F.initcap(t), F.lit(" project"))), ", ")
    return ctx.select("project_id", F.concat(types, F.when(F.col("build_system") != "", F.concat(F.lit(" ("), F.col("build_system"), F.lit(")"))).otherwise("")).alias("text"))
