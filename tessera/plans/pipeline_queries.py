"""Queries that run whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.pipeline import Corpus, run_queries
from tessera.plans.registry import Tables, query
from tessera.plans.search_queries import benchmark_queries, text_chunks


def _run(t: Tables) -> dict[str, DataFrame]:
    utility = t.events.groupBy(F.col("user_id").alias("chunk_id")).agg(F.round(F.avg("value") / 100, 4).alias("utility_ema"))
    links = t.documents.select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 10").alias("parent_id"))
    parents = t.documents.filter("doc_id % 10 = 0").select(F.expr("doc_id div 10").alias("id"), F.col("source").alias("content"))
    return run_queries(benchmark_queries(t), Corpus(text_chunks(t), utility, links, parents))


@query()
def query_pipeline(t: Tables) -> DataFrame:
    return _run(t)["results"].select("query_id", "id", "rank", "score", "parent_content")


@query()
def query_log(t: Tables) -> DataFrame:
    return _run(t)["log"]
