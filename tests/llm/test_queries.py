"""The registered queries of the subpackage, and the pipeline, on the smallest table."""

import os

import pytest

import corpus_pipeline
from lexigrove.llm import queries
from lexigrove.llm.common import materialize
from tests.llm.test_operators import brute_classes, brute_hits
from tests.oracle import assert_same, connection

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), connection(FOLDER).execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_a_document(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "test-stage")
        seen.append([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
        assert docs.columns == columns + ["shard"] * (name == "sharding")
    good, once, clean, mixed, sharded = seen
    known = [(i, labels[i]) for i, _ in good if i in labels]
    assert sum(q for _, q in known) / len(known) > 0.97
    classes = brute_classes(good)
    assert [i for i, _ in once] == sorted({min(j for j, _ in good if classes[j] == c) for c in set(classes.values())})
    dirty = {h[0] for h in brute_hits(once, items) if h[-1]}
    assert [i for i, _ in clean] == [i for i, _ in once if i not in dirty]
    assert {i for i, _ in mixed} <= {i for i, _ in clean} and len(mixed) == len(sharded)
    assert {r["shard"] for r in docs.select("shard").distinct().collect()} <= set(range(40))
