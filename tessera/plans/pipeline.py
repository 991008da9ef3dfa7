"""The query and ingest pipelines: chains of functions on tables, for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import feedback, model_steps, retrieval
from tessera.operators.storage import cut
from tessera.plans import strategies
from tessera.providers import Provider, embeddings


@dataclass
class Corpus:
    chunks: DataFrame  # id, content, embedding
    utility: DataFrame  # chunk_id, utility_ema
    chunk_parents: DataFrame  # chunk_id, parent_id
    parents: DataFrame  # id, content
    entities: DataFrame | None = None  # id, specificity, embedding
    edges: DataFrame | None = None  # source_id, target_id, weight
    mentions: DataFrame | None = None  # chunk_id, entity_id
    communities: DataFrame | None = None  # id, summary, summary_embedding
    summaries: DataFrame | None = None  # id, text, embedding


#: Kinds of rows that strategies find. A row's number is its id for a chunk, and below zero for the others, so that kinds never meet.
SOURCES = ("chunk", "community", "summary")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with source and id -> id as one number for all kinds."""
    n = len(SOURCES) - 1
    kind = F.when(F.col("source") == "community", 1).otherwise(2)
    return rows.withColumn("id", F.when(F.col("source") == "chunk", F.col("id")).otherwise(-(F.col("id") * n + kind))).drop("source")


def contents(corpus: Corpus) -> DataFrame:
    """id (of numbered()), content of all that can be found."""
    parts = [("chunk", corpus.chunks, "content"), ("community", corpus.communities, "summary"), ("summary", corpus.summaries, "text")]
    out = [numbered(df.select(F.lit(kind).alias("source"), "id", F.col(text).alias("content"))) for kind, df, text in parts if df is not None]
    return reduce(DataFrame.unionByName, out)


def strategies_of(corpus: Corpus, k: int, provider: Provider) -> dict[str, strategies.Strategy]:
    """What the corpus has tables for. A strategy that lacks its tables is not there, and its queries go to hybrid search."""
    chunk = strategies.hybrid(corpus.chunks, k)
    found = {"hybrid": chunk}
    found["hyde"] = lambda q: strategies.hyde(corpus.chunks, k, chunk)(model_steps.hypotheses(q, provider))
    if corpus.entities is not None and corpus.edges is not None and corpus.mentions is not None:
        found["kg_local"] = strategies.kg_local(corpus.entities, corpus.edges, corpus.mentions, corpus.utility, k, chunk)
    if corpus.communities is not None:
        found["kg_global"] = strategies.kg_global(corpus.communities, chunk, k)
    if corpus.summaries is not None:
        found["tree"] = strategies.tree(corpus.summaries, k)

    def parts(q: DataFrame) -> DataFrame:
        """Sub-queries with vectors of their own; without a model that embeds, the query's."""
        subs = embeddings(model_steps.decomposed(q, provider), F.col("query"), provider, "_own")
        return subs.join(q.select("query_id", "query_text", "query_vec"), "query_id").withColumn("query_vec", F.coalesce("_own", "query_vec")).select("query_id", "query_text", "pos", "query", "query_vec")

    found["multi_hop"] = strategies.multi_hop(parts, chunk, k)
    found["compound"] = strategies.compound(parts, dict(found), k)
    return found


def run_queries(queries: DataFrame, corpus: Corpus, k: int = 5, provider: Provider | None = None) -> dict[str, DataFrame]:
    """queries: query_id, query_text, query_vec -> results (with parent text and score parts), log and provenance. Each query goes the way
    that the log tells: its class picks the strategy, and one without its tables is hybrid. Candidates carry no text until it is needed."""
    ways = strategies_of(corpus, 3 * k, provider or Provider())
    routed = queries.select("*", *[c.alias(n) for n, c in S.query_class(F.col("query_text")).items()])
    routed = routed.withColumn("strategy", F.when(F.col("strategy").isin(list(ways)), F.col("strategy")).otherwise("hybrid"))
    asked = routed.select(*queries.columns, "strategy")
    found = cut(numbered(strategies.dispatch(asked, strategies.present(asked, ways))))
    rows = found.join(queries.select("query_id", "query_text"), "query_id").join(contents(corpus), "id")
    reranked = cut(retrieval.rerank(rows, 2 * k))
    verdicts = cut(feedback.graded(reranked))
    second = retrieval.hybrid_search(queries.join(verdicts.filter("action <> 'use_as_is'"), "query_id", "left_semi"), corpus.chunks, 2 * k)
    kept = feedback.corrected(reranked.select("query_id", "id", F.col("rerank_rank").alias("rank")), second.select("query_id", "id", "rank"), verdicts)
    scored = kept.join(reranked.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left").withColumn("score", F.coalesce("rerank_score", F.lit(0.0)))
    final = feedback.boosted(scored, corpus.utility, k)
    results = cut(retrieval.expand_parents(final, corpus.chunk_parents, corpus.parents))
    log = routed.join(verdicts, "query_id", "left").join(results.groupBy("query_id").agg(F.count("*").alias("result_count")), "query_id", "left")
    log = log.select("query_id", F.substring("query_text", 1, 2000).alias("query_text"), "strategy", F.round("quality", 4).alias("quality_score"), F.col("action").alias("corrective_action"), F.coalesce("result_count", F.lit(0)).alias("result_count"))
    parts = F.to_json(F.struct("rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"), F.col("utility_ema").alias("utility_score"), F.col("strategy").alias("source"), F.lit("text").alias("content_type")))
    steps = results.join(routed.select("query_id", "strategy"), "query_id").select("query_id", F.col("id").alias("chunk_id"), F.col("rank").alias("rank_position"), parts.alias("score_components"))
    return {"results": results, "log": log, "steps": steps, "chains": feedback.confidence(results)}


#: Ingest stages in order; those of the second set need a model.
STAGES = ("parse", "embed", "contextual", "parents", "kg", "communities", "raptor")
MODEL_STAGES = {"contextual", "kg", "communities", "raptor"}


def stages(names: str | None = None, *, no_llm: bool = False) -> list[str]:
    """Stages asked for, in order; a name that isn't one is a ValueError."""
    asked = [n.strip() for n in names.split(",")] if names else list(STAGES)
    if unknown := [n for n in asked if n not in STAGES]:
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    return [s for s in STAGES if s in asked and not (no_llm and s in MODEL_STAGES)]


def ingest(tables: dict[str, DataFrame], steps: dict[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], names: str | None = None, *, no_llm: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Runs the stages over the tables; a stage that fails leaves the tables as they were, and its error is returned."""
    errors: dict[str, str] = {}
    for name in stages(names, no_llm=no_llm):
        if name not in steps:
            continue
        try:
            tables = tables | steps[name](tables)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return tables, errors
