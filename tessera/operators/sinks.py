"""Writers: appended logs, JSON lines, reports, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, characters as they are."""
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """One report a folder of its own, never overwritten."""
    report.coalesce(1).write.mode("error").json(f"{folder}/{name}")


def newest_reports(spark: SparkSession, folder: str, n: int, pattern: str = "*.json") -> DataFrame:
    """file_path, modified and text of the n newest report files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.orderBy(F.desc("modificationTime"), "path").limit(n).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"))


def swap(df: DataFrame, root: str, version: int) -> str:
    """A snapshot under root; readers take the newest version. Returns its path."""
    path = f"{root}/v={version:08d}"
    df.write.mode("error").parquet(path)
    return path


def inserted_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones. Parallel edges are kept, and diffusion adds them up."""
    return edges.unionByName(new.select(*edges.columns))
