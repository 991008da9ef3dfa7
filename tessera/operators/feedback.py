"""Utility of chunks learned from use, decay, correction and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import clamp, corrective_action, quality_level, utility_boost
from tessera.operators.retrieval import overlap_score, top_k


def record_retrievals(events: DataFrame) -> DataFrame:
    """events: chunk_id -> chunk_id, retrieve_count."""
    return events.groupBy("chunk_id").agg(F.count("*").alias("retrieve_count"))


def utility_ema(uses: DataFrame, alpha: float = 0.15, start: float = 0.5) -> DataFrame:
    """uses: chunk_id, ts, seq, contribution (null: 1) -> chunk_id, utility_ema, use_count, last_used. The fold
    e <- (1 - alpha) e + alpha c has the closed form of a weighted sum, whose weights follow from the number of later uses; only the sums
    by chunk are kept, so a chunk with many uses needs no list of them in one place."""
    w = W.partitionBy("chunk_id").orderBy(F.desc("ts"), F.desc("seq"))
    aged = uses.withColumn("_later", F.row_number().over(w) - 1)
    term = alpha * F.pow(F.lit(1 - alpha), F.col("_later")) * clamp(F.coalesce("contribution", F.lit(1.0)))
    sums = aged.groupBy("chunk_id").agg(F.sum(term).alias("_s"), F.count("*").alias("use_count"), F.max("ts").alias("last_used"))
    return sums.select("chunk_id", (F.col("_s") + start * F.pow(F.lit(1 - alpha), F.col("use_count"))).alias("utility_ema"), "use_count", "last_used")


def with_utility(rows: DataFrame, utility: DataFrame, default: float = 0.5) -> DataFrame:
    return rows.join(utility.select(F.col("chunk_id").alias("id"), F.col("utility_ema")), "id", "left").withColumn("utility_ema", F.coalesce("utility_ema", F.lit(default)))


def boosted(rows: DataFrame, utility: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """rows: query_id, id, score -> score by utility, ranked again."""
    scored = with_utility(rows, utility).withColumn("score", utility_boost(F.col("score"), F.col("utility_ema"), weight))
    return top_k(scored, [F.desc("score"), F.asc("id")], k, keys=["query_id"])


def decayed(state: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Utility of what wasn't used for so many days moves a tenth towards a half."""
    limit = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    old = (F.col("last_used") < limit) | (F.col("last_used").isNull() & (F.col("updated_at") < limit))
    return state.withColumn("decayed", F.coalesce(old, F.lit(False))).withColumn("utility_ema", F.when(F.col("decayed"), 0.9 * F.col("utility_ema") + 0.1 * 0.5).otherwise(F.col("utility_ema")))


def utility_stats(state: DataFrame) -> DataFrame:
    """One row; the neutral half where there is no state."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.5)), 4)
    return state.agg(
        F.count("*").alias("chunks"), r(F.avg("utility_ema")).alias("avg_ema"), r(F.max("utility_ema")).alias("max_ema"), r(F.min("utility_ema")).alias("min_ema"),
        F.coalesce(F.sum("retrieve_count"), F.lit(0)).alias("retrieves"), F.coalesce(F.sum("use_count"), F.lit(0)).alias("uses"),
    )


def graded(rows: DataFrame, chars: int = 500, score=overlap_score) -> DataFrame:
    """rows: query_id, query_text, id, content -> by query: quality, level and action."""
    s = rows.groupBy("query_id").agg(F.round(F.avg(clamp(score(F.col("query_text"), F.substring("content", 1, chars)))), 4).alias("quality"))
    return s.select("query_id", "quality", quality_level(F.col("quality")).alias("level"), corrective_action(F.col("quality")).alias("action"))


def corrected(initial: DataFrame, second: DataFrame, verdicts: DataFrame) -> DataFrame:
    """initial, second: query_id, id, rank. use_as_is: the first list; supplement: followed by the second one's new rows; rewrite_query:
    the second list, or the first where there is none."""
    a = initial.join(verdicts.select("query_id", "action"), "query_id")
    b = second.join(verdicts.select("query_id", "action"), "query_id")
    has = b.select("query_id").distinct().withColumn("_has", F.lit(True))
    first = a.join(has, "query_id", "left").filter("action <> 'rewrite_query' OR _has IS NULL").select("query_id", "id", "action", F.lit(0).alias("_part"), "rank")
    fresh = b.filter("action = 'supplement'").join(initial.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = fresh.unionByName(b.filter("action = 'rewrite_query'")).select("query_id", "id", "action", F.lit(1).alias("_part"), "rank")
    w = W.partitionBy("query_id").orderBy("_part", "rank", "id")
    return first.unionByName(more).withColumn("position", F.row_number().over(w)).drop("_part", "rank")


def relevant(rows: DataFrame, threshold: float = 0.6, chars: int = 300, batch: int = 5, score=overlap_score) -> DataFrame:
    """rows: query_id, query_text, id, content, rank -> those over the threshold, with relevance_score (0 to 10) and their batch."""
    s = F.round(10 * clamp(score(F.col("query_text"), F.substring("content", 1, chars))), 4)
    return rows.withColumn("relevance_score", s).withColumn("batch", F.expr(f"(rank - 1) div {batch}").cast("int")).filter(F.col("relevance_score") >= threshold * 10)


def adaptive(rows: DataFrame, search, *, threshold: float = 0.6, least: int = 3, easier: float = 0.8) -> DataFrame:
    """rows: query_id, query_text, id, content, rank; search: (query_id, query_text) -> such rows. A query that needs no facts keeps its
    first three rows; one with fewer than three relevant rows searches again with its first words, for rows not seen, at a lower
    threshold."""
    facts = T.needs_facts(F.col("query_text"))
    plain = rows.filter(~facts & (F.col("rank") <= 3)).select("query_id", "query_text", "id", "content", "rank", F.lit(None).cast("double").alias("relevance_score"))
    good = relevant(rows.filter(facts), threshold).select(*plain.columns)
    n = good.groupBy("query_id").agg(F.count("*").alias("_n"))
    asked = rows.filter(facts).select("query_id", "query_text").distinct().join(n, "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < least)
    found = search(asked.select("query_id", T.simplified(F.col("query_text")).alias("query_text")))
    again = found.drop("query_text").join(asked.select("query_id", "query_text"), "query_id").join(rows.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = relevant(again, threshold * easier).withColumn("rank", F.col("rank") + 1_000_000).select(*plain.columns)
    return plain.unionByName(good).unionByName(more)


def provenance_chain(chains: DataFrame, steps: DataFrame, chunks: DataFrame, chars: int = 300) -> DataFrame:
    """Steps of each chain with a snippet of their chunk, in the order of their rank; steps without a rank come last."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.substring("content", 1, chars).alias("content_snippet"))
    w = W.partitionBy("chain_id").orderBy(F.asc_nulls_last("rank_position"), "step_id")
    joined = steps.join(chains.select(F.col("id").alias("chain_id"), "overall_confidence"), "chain_id").join(c, "chunk_id", "left")
    return joined.withColumn("position", F.row_number().over(w))


def confidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.round(clamp(F.avg("score")), 6).alias("overall_confidence"))
