"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, html_extraction, line_dedup, lm, minhash, packing, quality_rules, token_counts, url_filters

#: Vocabulary files of public tokenizers: a parameter, the same folder on every executor.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS") or (os.path.dirname(found.origin) if (found := find_spec("public_tokenizers")) and found.origin else "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_read(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_read(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(_read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_line_dedup, op3_token_counts, op4_minhash, op5_lm_scoring, op6_exact_dedup, op7_quality_rules, op8_best_fit_packing, op9_bpe, op10_html_extraction, pipeline]
    return {f.__name__: f for f in found}


_OP2 = """
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
keys AS (SELECT key, max(doc_id) AS stays FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, (k.key IS NOT NULL AND l.doc_id <> k.stays) AS gone FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, (-length(text), doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""

_OP7 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 6),
win AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS x FROM w),
rep AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) >= 2),
cover AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM win JOIN rep USING (doc_id, x), range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, unnest([{", ".join(f"sum(({r})::INT)" for r in quality_rules.RULES.values())}]) AS failed, unnest(range({len(quality_rules.RULES)})) AS rule FROM judged WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT rule, sum(failed) / sum(n) AS mean, var_pop(failed / n) AS var FROM hosts GROUP BY rule),
prior AS (SELECT rule, mean, CASE WHEN coalesce(var, 0) = 0 THEN {quality_rules.PRIOR_MAX} ELSE least({quality_rules.PRIOR_MAX}, greatest({quality_rules.PRIOR_MIN}, mean * (1 - mean) / var - 1)) END AS strength FROM m),
verdict AS (SELECT source, bool_and((failed + mean * strength) / (n + strength) < {quality_rules.REJECT_RATE}) AS host_kept FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, TRUE) AS kept
FROM judged LEFT JOIN verdict USING (source)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op6_exact_dedup": _OP6, "op7_quality_rules": _OP7}
