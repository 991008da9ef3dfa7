"""Work that has to grow no faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, graph, mixture, retrieval, state


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_new_files_joins_a_hash_once(spark):
    files = spark.range(8).select(F.lit("c").alias("collection"), F.col("id").cast("string").alias("content"))
    left = state.new_files(files, files.select("collection", F.lit("").alias("file_hash")))
    assert left.count() == 8 and "Aggregate" in plan(left).split("Join LeftAnti")[1]


def test_communities_of_parts_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_EDGES", 4)
    rng = np.random.default_rng(3)
    pairs = {(int(p), int(x), int(y)) for p in range(9) for x, y in rng.integers(0, 3 + p, (2 * p + 1, 2))}
    edges = [(c, 100 * p + x, 100 * p + y, float(1 + (x * y + p) % 7)) for c in ("g", "h") for p, x, y in pairs if c == "g" or p % 3]
    nodes = [(c, x) for c, a, b, _ in edges for x in (a, b)] + [("g", 50), ("g", 2000), ("two", 1), ("two", 2)]
    found = graph.communities(spark.createDataFrame(nodes, "collection string, id long").distinct(), spark.createDataFrame(edges, "collection string, a long, b long, weight double")).collect()
    for c in ("g", "h"):
        e, ids = sorted(x for x in edges if x[0] == c), np.array(sorted({x for k, x in nodes if k == c}))
        for level, r in enumerate((0.5, 1.0, 2.0)):
            want = graph.louvain(ids, np.array([x[1] for x in e]), np.array([x[2] for x in e]), np.array([x[3] for x in e]), r)
            assert {x.id: x.community for x in found if (x.collection, x.level) == (c, level)} == dict(zip(ids.tolist(), want.tolist()))
    assert {x.collection for x in found} == {"g", "h"}


def test_mixture_is_that_of_spark_where_components_are_left_out(spark, monkeypatch):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    monkeypatch.setattr(mixture, "FEW", 4)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 2) + 6 * np.array([i % 5, i % 3])).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(1).select("id", array_to_vector("x").alias("features")).localCheckpoint()
    model = GaussianMixture(k=40, seed=42, maxIter=200, featuresCol="features", probabilityCol="p").fit(df)
    want = {(r.id, c): p for r in model.transform(df).select("id", vector_to_array("p").alias("p")).collect() for c, p in enumerate(r.p) if p >= 0.1}
    got = {(r.id, r.cluster): r.p for r in mixture.soft_members(df, 40, threshold=0.1, seed=42).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_similar_pairs_shuffle_floats(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<float>")
    found = graph.similar_pairs(df, 0.9)
    assert "array<double>" not in plan(found) and {(r.a, r.b) for r in found.collect()} == {(i, j) for i in range(5) for j in range(i + 1, 5) if round((1 + i * j) / ((1 + i * i) * (1 + j * j)) ** 0.5, 6) >= 0.9}


def test_chunks_leave_a_task_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [("| a |\n| --- |\n" + "one two three\n" * 40 * i, "table")]) for i in range(4)], "doc_id long, blocks array<struct<content:string,content_type:string>>")
    want = sorted(chunking.chunk_blocks(docs, limits={"table": 60}).collect())
    monkeypatch.setattr(chunking, "BATCH_CHARS", 100)
    assert len(want) > 10 and sorted(chunking.chunk_blocks(docs, limits={"table": 60}).collect()) == want


def test_keyword_search_joins_other_terms_to_holders_of_the_rarest_only(spark):
    docs = spark.createDataFrame([(i, "often " * (1 + i % 3) + ("rare" if i % 10 == 0 else "")) for i in range(40)], "id long, content string")
    queries = spark.createDataFrame([(1, "often rare"), (2, "often"), (3, "often never")], "query_id long, query_text string")
    found = retrieval.keyword_search(queries, docs, 100)
    assert {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 40}
    assert "min_by" in plan(found)
