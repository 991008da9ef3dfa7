"""Queries run over all of their input."""

from pyspark.sql import functions as F

from tessera.plans import graph_queries
from tessera.plans.catalogue import QUERIES
from tessera.plans.registry import Tables


def items(spark, sf_dir):
    return {r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}


def test_ranked_and_graded_rows_are_retrieved(spark, sf_dir):
    ranked = QUERIES["rerank_retrieved"](spark, sf_dir).collect()
    assert {r.query_id for r in ranked} == items(spark, sf_dir) and any((r.id - r.query_id) % 10 for r in ranked)
    assert {r.query_id for r in QUERIES["crag_retrieved"](spark, sf_dir).collect()} == items(spark, sf_dir)
    assert any((r.id - r.query_id) % 40 for r in QUERIES["selfrag_retrieved"](spark, sf_dir).collect())


def test_graph_has_all_edges(spark, sf_dir):
    read = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    n = {r.id: r.degree for r in QUERIES["specificity_all"](spark, sf_dir).collect()}
    assert len(n) == read("supplier").count() + read("part").count() and sum(n.values()) == 2 * read("lineitem").count()
    found = QUERIES["community_detection"](spark, sf_dir).groupBy("level").agg(F.countDistinct("id").alias("n")).collect()
    assert [r.n for r in found] == [sum(x > 0 for x in n.values())] * 3
    # ids of no test table reach this far
    part = spark.createDataFrame([(1, 5_000, 1.0), (2, 5_000, 2.0), (60, 7_000, 1.0)], "l_suppkey long, l_partkey long, l_quantity double")
    tables = Tables(spark, sf_dir)
    tables.lineitem = part
    assert {r.id for r in graph_queries.community_detection(tables).collect()} == {1, 2, 60, -5_001, -7_001}


def test_pipeline_takes_whole_texts_of_all_items(spark, sf_dir):
    log = {r.query_id: r.query_text for r in QUERIES["query_log"](spark, sf_dir).collect()}
    assert log == {r.item_id: r.text[:2000] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}


def test_vector_query_set(spark, sf_dir):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    for name in ("vector_topk_hundreds", "vector_topk_filtered_hundreds"):
        assert {r.query_id for r in QUERIES[name](spark, sf_dir).collect()} == {i for i in ids if i % 100 == 0}
