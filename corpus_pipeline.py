"""The corpus pipeline: quality rules, line dedup, near-dedup, packing. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, packing, quality_rules
from tessera.llm.common import materialise, quoted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stay elsewhere; n_chars counts what is left."""
    kept = line_dedup.drop_lines(docs)
    return kept.select(*[quoted(c) if c != "n_chars" else F.length("text").cast("long").alias("n_chars") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: where each document goes."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("minhash_near_dedup", near_dedup_stage), ("best_fit_packing", packing_stage)]
#: Near-dedup and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
