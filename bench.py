"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lexigrove.plans import queries as plans

HEADLINE = [
    "index_postings", "bm25_topk", "bm25f_topk", "char_ngram_topk", "tfidf_cosine_topk", "hybrid_fusion_topk", "universal_search", "query_intent", "stem_terms",
    "legacy_score_topk", "vector_cosine_topk", "eval_by_slice", "history_stats", "metric_percentiles", "pii_mask", "page_parse", "search_revenue",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables, hard work on each row
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["history_top"](spark, folder).collect()  # the JVM is warm
    taken = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
