"""Ranks, scores and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query classes with the retrieval strategy of each.
STRATEGIES = {"specific_factoid": "hybrid", "entity_focused": "kg_local", "global_thematic": "kg_global", "multi_hop": "multi_hop", "vague_exploratory": "hyde", "compound": "compound"}
# Phrases that tell a query's class, on lower-cased text.
MULTI_HOP = ["how does .+ relate", "connection between", "relationship between", "how .+ affect", "difference between .+ and", "what happens when .+ and", "link between"]
THEMATIC = ["^overview", "summary of", "what are (all|the main|the key|the primary)", "give me an overview", "explain the (concept|system|process) of", "describe the (workflow|process|stages)"]
FACTOID = [r"^what is\b", r"^what are\b", r"^define\b", "^what does .+ stand for", "^which field", "^what field", "^list the", "^what error", "^what code"]


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def quality_level(q: Column) -> Column:
    return F.when(q >= 0.8, "correct").when(q >= 0.5, "ambiguous").otherwise("incorrect")


def corrective_action(q: Column) -> Column:
    return F.when(q >= 0.8, "use_as_is").when(q >= 0.5, "supplement").otherwise("rewrite_query")


def score_components(keyword_rank: Column, vector_rank: Column, kg: Column, utility: Column, rerank: Column) -> dict[str, Column]:
    """Rounded parts and their weighted sum; a missing rank is a large one."""
    part = lambda r: F.round(1.0 / (60 + F.greatest(F.lit(1), F.coalesce(r, F.lit(999)))), 8)
    unit = lambda x: F.round(clamp(F.coalesce(x, F.lit(0.0))), 6)
    kw, vec, k, u, r = part(keyword_rank), part(vector_rank), unit(kg), unit(utility), unit(rerank)
    total = 0.15 * 1000 * kw + 0.15 * 1000 * vec + 0.10 * k + 0.10 * u + 0.50 * r
    return {"keyword_rrf": kw, "vector_rrf": vec, "kg_score": k, "utility_score": u, "rerank_score": r, "composite": F.round(total, 6)}


def utility_boost(score: Column, ema: Column, weight: float = 0.3) -> Column:
    """Around the neutral utility of a half."""
    return F.round(score * (1 + F.lit(weight) * (F.coalesce(ema, F.lit(0.5)) - 0.5)), 6)


def rerank_boost(score: Column, ema: Column, weight: float = 0.3) -> Column:
    """Above the score; what was never used gets none."""
    return score * (1 + F.lit(weight) * F.coalesce(ema, F.lit(0.0)))


def query_class(query: Column) -> dict[str, Column]:
    """query_type, strategy and confidence by phrasing; the first rule that fits."""
    from tessera.functions.text import any_of, strip

    q = strip(F.lower(query))
    blank = strip(query) == ""
    multi, theme, fact = any_of(q, MULTI_HOP), any_of(q, THEMATIC), any_of(q, FACTOID)
    compound = (F.regexp_count(query, F.lit(r"\?")) >= 2) | q.contains("and also") | q.contains(" and how ")
    kind = F.when(blank, "specific_factoid").when(multi, "multi_hop").when(theme, "global_thematic").when(compound, "compound").otherwise("specific_factoid")
    confidence = F.when(blank, 1.0).when(multi, 0.70).when(theme, 0.70).when(compound, 0.72).when(fact, 0.68).otherwise(0.50)
    strategy = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), kind)
    return {"query_type": kind, "strategy": strategy, "confidence": confidence}
