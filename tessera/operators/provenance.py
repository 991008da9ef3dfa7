"""Provenance of answers: chains and their steps as snapshots, and their rendering as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import clamp

# Parts of a score in the order they are shown, with their labels.
PARTS = {"keyword_rrf": "keyword", "vector_rrf": "vector", "kg_diffusion": "kg", "utility_boost": "utility", "rerank_score": "rerank"}
_PARTS_DDL = ", ".join(f"{p} double" for p in [*PARTS, "composite"])


def started(answers: DataFrame) -> DataFrame:
    """answers: id, query_log_id, answer_text -> new chains; a query log id of 0 is none."""
    log = F.when(F.col("query_log_id") != 0, F.col("query_log_id"))
    return answers.select("id", log.alias("query_log_id"), "answer_text", F.lit(None).cast("double").alias("overall_confidence"))


def with_steps(steps: DataFrame, added: DataFrame) -> DataFrame:
    """steps and the added ones (chain_id, chunk_id, entity_id, rank_position and the parts of the score as columns), whose ids go on
    from the largest."""
    last = steps.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    parts = F.to_json(F.struct(*[c for c in [*PARTS, "composite"] if c in added.columns]))
    numbered = added.withColumn("_order", F.monotonically_increasing_id()).crossJoin(F.broadcast(last))
    new = numbered.select((F.col("_last") + 1 + F.col("_order")).alias("id"), "chain_id", "chunk_id", "entity_id", parts.alias("score_components"), "rank_position")
    return steps.unionByName(new)


def finalized(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """scores: chain_id, confidence -> chains with it, cut to [0, 1] and rounded; chains without one stay as they are."""
    s = scores.select(F.col("chain_id").alias("id"), F.round(clamp(F.col("confidence")), 6).alias("_c"))
    return chains.join(s, "id", "left").withColumn("overall_confidence", F.coalesce("_c", "overall_confidence")).drop("_c")


def truncated(text: Column, n: int) -> Column:
    """The first n characters on one line, with dots where there were more."""
    return F.concat(F.regexp_replace(F.substring(text, 1, n), "\n", " "), F.when(F.length(text) > n, "...").otherwise(""))


def rendered(chains: DataFrame, steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """chain_id, report: a chain as lines of text, its steps in the order of their rank, those without one last."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.substring("content", 1, 300).alias("_s"))
    p = F.from_json("score_components", _PARTS_DDL)
    of = lambda name: F.coalesce(F.col(f"_p.{name}"), F.lit(0.0))
    total = F.coalesce("_p.composite", of("keyword_rrf") + of("vector_rrf") + of("rerank_score"))
    shown = F.concat_ws(" + ", *[F.format_string(f"{label}:%.4f", of(name)) for name, label in PARTS.items()])
    what = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("chunk #"), "chunk_id")).when(F.col("entity_id").isNotNull(), F.concat(F.lit("entity #"), "entity_id")).otherwise("unknown")
    line = F.concat(F.lit("Result "), F.coalesce(F.col("rank_position").cast("string"), F.lit("?")), F.lit(" ("), what, F.lit("): score="), F.format_string("%.4f", total), F.lit(" ["), shown, F.lit("]"))
    snippet = F.when(F.coalesce(F.trim("_s"), F.lit("")) != "", F.concat(F.lit("\nContent: "), F.substring(F.trim("_s"), 1, 200))).otherwise("")
    rows = steps.join(c, "chunk_id", "left").withColumn("_p", p)
    rows = rows.select("chain_id", F.struct(F.coalesce("rank_position", F.lit(2147483647)).alias("r"), "id", F.concat(line, snippet).alias("line")).alias("x"))
    per = rows.groupBy("chain_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("_lines"))
    head = F.format_string("Provenance chain #%d — confidence: %.4f", "chain_id", F.coalesce("overall_confidence", F.lit(0.0)))
    answer = F.when(F.coalesce("answer_text", F.lit("")) != "", F.concat(F.lit("\nAnswer: "), truncated(F.col("answer_text"), 120))).otherwise("")
    joined = chains.withColumnRenamed("id", "chain_id").join(per, "chain_id", "left")
    body = F.when(F.col("_lines").isNull(), "\n(no steps recorded)").otherwise(F.concat(F.lit("\n\n"), "_lines"))
    return joined.select("chain_id", F.concat(head, answer, body).alias("report"))
