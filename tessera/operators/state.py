"""State as snapshots: each function gives the next snapshot from the last one and a delta. Parquet has no in-place update, so a
caller writes the result to a new path and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def new_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files with file_hash (of content) that documents of the collection don't have yet. Each hash is joined once, whatever its copies:
    where the keys are constants, the planner compares every file with every row that is left."""
    hashed = files.withColumn("file_hash", F.sha2("content", 256))
    return hashed.join(documents.select("collection", "file_hash").distinct(), ["collection", "file_hash"], "left_anti")


def replace_documents(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document with a known (collection, file_hash) takes the old one's place, whose chunks go; a changed file is a new document."""
    keys = ["collection", "file_hash"]
    old = documents.join(new_documents.select(*keys), keys, "left_semi")
    left = documents.join(new_documents.select(*keys), keys, "left_anti").unionByName(new_documents, allowMissingColumns=True)
    return left, chunks.join(old.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def identified_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: collection, file_path, document_id, chunk_index, content -> with content_hash and stable_id; of equal contents of a
    document the first stays."""
    hashed = chunks.withColumn("content_hash", F.sha2("content", 256))
    hashed = hashed.withColumn("stable_id", F.sha2(F.concat_ws(":", "collection", "file_path", "chunk_index", "content_hash"), 256))
    return first_rows(hashed, ["document_id", "content_hash"], ["chunk_index"])


def keep_longest(rows: DataFrame, keys: list[str], text: str, kind: str, order: str) -> DataFrame:
    """Merged entities: the newest kind; the longest text, of equally long ones the earliest."""
    return rows.groupBy(*keys).agg(F.max_by(kind, order).alias(kind), F.max_by(text, F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(order))).alias(text))


def upsert(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta's rows over state's; columns that delta lacks stay."""
    new = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in delta.columns if c not in keys], F.lit(True).alias("_new"))
    joined = state.join(new, keys, "full")
    cols = [c for c in state.columns if c not in keys]
    return joined.select(*keys, *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in delta.columns else F.col(c) for c in cols])


def insert_ignore(state: DataFrame, delta: DataFrame, keys: list[str], order: list) -> DataFrame:
    """What is there stays; of new rows with one key the first."""
    fresh = first_rows(delta.join(state.select(*keys), keys, "left_anti"), keys, order)
    return state.unionByName(fresh)


def heal(chunks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes: chunk_id, prefix. A healed chunk gets the prefix and loses its embedding."""
    p = prefixes.select(F.col("chunk_id").alias("id"), F.col("prefix").alias("_p"))
    joined = chunks.join(p, "id", "left")
    healed = F.col("_p").isNotNull()
    out = {"context_prefix": F.coalesce("_p", "context_prefix"), "embedding": F.when(~healed, F.col("embedding"))}
    return joined.withColumns(out).select(*chunks.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """Rows of parents with an id in keys go, and so do children that point at them."""
    return parents.join(keys, "id", "left_anti"), children.join(keys.select(F.col("id").alias(fk)), fk, "left_anti")


def delete_set_null(parents: DataFrame, children: DataFrame, keys: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    gone = keys.select(F.col("id").alias(fk), F.lit(True).alias("_gone"))
    kept = children.join(gone, fk, "left").withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk)))
    return parents.join(keys, "id", "left_anti"), kept.select(*children.columns)


def without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The unprocessed rows: those of left that right has no row for."""
    return left.join(right.select(*on), on, "left_anti")


def contains(column: Column, literal) -> Column:
    """JSON containment: every key of an object, every item of an array, equal scalars. The literal is expanded while the plan is built."""

    def at(path: str, value) -> Column:
        here = F.get_json_object(column, path)
        if isinstance(value, dict):
            out = here.isNotNull()
            for k, v in value.items():
                out = out & at(f"{path}.{k}", v)
            return out
        if isinstance(value, list):
            items = F.from_json(here, "array<string>")
            return F.coalesce(F.size(F.array_except(F.array(*[F.lit(str(x)) for x in value]), items)) == 0, F.lit(False))
        return F.coalesce(here == F.lit(str(value).lower() if isinstance(value, bool) else str(value)), F.lit(False))

    return at("$", literal)
