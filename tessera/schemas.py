"""Schemas of the engine's tables. collection is the partition column of each dataset that has it."""

from __future__ import annotations

from pyspark.sql.types import StructType

_TABLES = {
    "documents": "id long, collection string, file_path string, file_name string, file_type string, file_size long, file_hash string, title string, chunk_count int, doc_metadata string, ingested_at timestamp",
    "chunks": "id long, document_id long, collection string, chunk_index int, content string, content_hash string, context_prefix string, content_type string, heading_path array<string>, page_number int, token_count int, chunk_metadata string, stable_id string, embedding array<float>, embed_model string, tokens array<string>",
    "entities": "id long, collection string, name string, entity_type string, description string, embedding array<float>, specificity double, aliases array<string>, created_at timestamp",
    "relationships": "id long, collection string, source_id long, target_id long, rel_type string, weight double, context string, context_embedding array<float>",
    "synonymy_edges": "entity_a_id long, entity_b_id long, cosine_sim double",
    "chunk_entities": "chunk_id long, entity_id long, mention_text string",
    "communities": "id long, collection string, level int, parent_id long, title string, summary string, summary_embedding array<float>, entity_count int",
    "community_members": "community_id long, entity_id long",
    "summaries": "id long, collection string, level int, parent_id long, text string, embedding array<float>, source_chunk_ids array<long>, token_count int",
    "contextual_contexts": "chunk_id long, context_text string, context_embedding array<float>, model_used string",
    "parent_chunks": "id long, document_id long, collection string, content string, heading_path array<string>, token_count int, embedding array<float>",
    "chunk_parents": "chunk_id long, parent_id long",
    "query_log": "id long, query_text string, collection string, strategy string, quality_score double, latency_ms long, corrective_action string, result_count int, created_at timestamp",
    "chunk_utility": "chunk_id long, utility_ema double, retrieve_count long, use_count long, last_used timestamp, updated_at timestamp",
    "eval_questions": "id long, collection string, question string, ground_truth string, difficulty string, source_chunk_ids array<long>",
    "eval_runs": "id long, collection string, run_name string, faithfulness double, answer_relevancy double, context_precision double, context_recall double, n_questions int, created_at timestamp",
    "provenance_chains": "id long, query_log_id long, answer_text string, overall_confidence double, created_at timestamp",
    "provenance_steps": "id long, chain_id long, chunk_id long, entity_id long, score_components string, rank_position int",
}
BLOCK = "content string, content_type string, heading_path array<struct<level int, text string>>, context_prefix string, inherited_screens array<string>, atomic boolean, preserve_ws boolean"


def schema(table: str) -> StructType:
    return StructType.fromDDL(_TABLES[table])


def tables() -> list[str]:
    return list(_TABLES)
