"""What a service over the tables answers: counts, look-ups, browsing, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of a collection, by the table that each is of.
COUNTS = {"chunks": "chunks", "documents": "documents", "entities": "entities", "relationships": "relationships", "communities": "communities", "parent_chunks": "parent_chunks", "eval_questions": "eval_questions"}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """A row a collection: eight counts, of rows of each table and of chunks with an embedding; -1 for a table that is not there.
    Each table is counted before it is joined, so what is shuffled is a row a collection and task."""
    out = None
    for name, table in COUNTS.items():
        if table not in tables:
            continue
        found = [F.count("*").alias(name)]
        if name == "chunks":
            found.append(F.count("embedding").alias("embedded_chunks"))
        n = tables[table].groupBy("collection").agg(*found)
        out = n if out is None else out.join(n, "collection", "full")
    names = ["chunks", "documents", "embedded_chunks", *list(COUNTS)[2:]]
    missing = lambda c: "chunks" not in tables if c == "embedded_chunks" else COUNTS[c] not in tables
    return out.select("collection", *[F.lit(-1).cast("long").alias(c) if missing(c) else F.coalesce(c, F.lit(0)).alias(c) for c in names])


def context_of(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """chunk_id, context_text of the asked chunks; null where there is none."""
    return chunks.select("chunk_id").join(contexts.select("chunk_id", "context_text"), "chunk_id", "left")


def entity_ids(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names: collection, name -> with entity_id, by the exact name; null where there is none."""
    return names.join(entities.select("collection", "name", F.col("id").alias("entity_id")), ["collection", "name"], "left")


def entity_details(ids: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """ids: id -> name, type and description of each entity, and the number of its relations."""
    ends = relationships.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("relations"))
    rows = ids.join(entities.select("id", "name", "entity_type", "description"), "id").join(ends, "id", "left")
    return rows.withColumn("relations", F.coalesce("relations", F.lit(0)))


def newest(rows: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    """The newest n rows, as reports list them."""
    return rows.orderBy(F.desc(at), key).limit(n)


def ingest_summary(documents: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """documents: collection, id, skipped; chunks: document_id, token_count; errors: collection, file_name -> a row a collection: files,
    ingested, skipped, errors, chunks, tokens."""
    of = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    done = documents.join(of, "id", "left").groupBy("collection").agg(F.count("*").alias("read"), F.count(F.when(~F.col("skipped"), 1)).alias("ingested"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    failed = errors.groupBy("collection").agg(F.count("*").alias("errors"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return done.join(failed, "collection", "full").select("collection", (n("read") + n("errors")).alias("files"), n("ingested").alias("ingested"), n("skipped").alias("skipped"), n("errors").alias("errors"), n("chunks").alias("chunks"), n("tokens").alias("tokens"))
