"""Files as tables: discovery, text and markdown parsing, optional readers for other formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.documents import table_markdown  # noqa: F401  a part of this module's interface

#: File suffixes and their parsers.
PARSERS = {".docx": "docx", ".doc": "docx", ".pdf": "pdf", ".txt": "text", ".md": "text", ".rst": "text"}


def discover(spark: SparkSession, base: str, *, exclude_dirs: list[str] = (), skip_files: list[str] = ()) -> DataFrame:
    """path, content, length, file_name, file_type, parser of files under base that a parser knows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return known_files(files, exclude_dirs=exclude_dirs, skip_files=skip_files)


def known_files(files: DataFrame, *, exclude_dirs: list[str] = (), skip_files: list[str] = ()) -> DataFrame:
    parts = F.split("path", "/")
    named = files.withColumns({"file_name": F.element_at(parts, -1), "_dirs": F.slice(parts, 1, F.size(parts) - 1)})
    named = named.withColumn("file_type", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    kept = named.filter(~F.col("file_name").isin(list(skip_files)) & F.col("file_type").isin(list(PARSERS)))
    if exclude_dirs:
        kept = kept.filter(~F.arrays_overlap("_dirs", F.array(*map(F.lit, exclude_dirs))))
    return kept.withColumn("parser", parser_of(F.col("file_type"))).drop("_dirs")


def parser_of(suffix: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, p in PARSERS.items():
        out = F.when(suffix == s, p).otherwise(out)
    return out


def decoded(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """files: doc_id, stem, text -> doc_id, block_index, content, heading_path (level, text), context_prefix. Lines are folded in order
    with a heading stack: a heading of level n keeps the first n - 1 entries of the stack (first of all the file's stem)."""
    stack0 = F.array(F.col("stem"))
    lines = F.split("text", "\n")
    shape = "struct<stack:array<string>,buf:array<string>,out:array<struct<stack:array<string>,content:string>>>"
    start = F.struct(stack0.alias("stack"), F.array().cast("array<string>").alias("buf"), F.array().cast("array<struct<stack:array<string>,content:string>>").alias("out")).cast(shape)
    pattern = r"^(#{1,6})\s+(.+)$"

    def flushed(acc):
        content = T.strip(F.array_join(acc["buf"], "\n"))
        return F.when((content != "") & ~T.is_parser_noise(content), F.concat(acc["out"], F.array(F.struct(acc["stack"].alias("stack"), content.alias("content"))))).otherwise(acc["out"])

    def step(acc, line):
        level = F.length(F.regexp_extract(line, pattern, 1))
        heading = F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(T.strip(F.regexp_extract(line, pattern, 2))))
        is_heading = level > 0
        return F.struct(
            F.when(is_heading, heading).otherwise(acc["stack"]).alias("stack"),
            F.when(is_heading, F.array().cast("array<string>")).otherwise(F.concat(acc["buf"], F.array(line))).alias("buf"),
            F.when(is_heading, flushed(acc)).otherwise(acc["out"]).alias("out"),
        )

    blocks = files.select("doc_id", F.aggregate(lines, start, step, flushed).alias("blocks"))
    rows = blocks.select("doc_id", F.posexplode("blocks").alias("block_index", "b"))
    path = F.transform("b.stack", lambda h, i: F.struct((i + 1).cast("int").alias("level"), h.alias("text")))
    return rows.select("doc_id", "block_index", F.col("b.content").alias("content"), path.alias("heading_path"), F.array_join("b.stack", " > ").alias("context_prefix"))


BLOCKS = "path string, block_index int, content string, content_type string, heading string, heading_path array<struct<level:int,text:string>>, context_prefix string, atomic boolean, preserve_ws boolean"


def binary_blocks(files: DataFrame) -> DataFrame:
    """files: path, content, parser -> path, block_index and the block of each part of a DOCX or PDF document; heading is the last one."""
    import pyarrow as pa

    from tessera.sources.documents import parse_binary

    level = pa.struct([("level", pa.int32()), ("text", pa.string())])
    shape = pa.schema([("path", pa.string()), ("block_index", pa.int32()), ("content", pa.string()), ("content_type", pa.string()), ("heading", pa.string()), ("heading_path", pa.list_(level)), ("context_prefix", pa.string()), ("atomic", pa.bool_()), ("preserve_ws", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = []
            for path, content, parser in zip(*(c.to_pylist() for c in b.columns)):
                stem = path.rpartition("/")[2].rpartition(".")[0]
                for i, x in enumerate(parse_binary(content, parser, stem)):
                    rows.append({"path": path, "block_index": i, "heading": x["heading_path"][-1]["text"] if x["heading_path"] else "", **x})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return files.filter(F.col("parser").isin("pdf", "docx")).select("path", "content", "parser").mapInArrow(run, BLOCKS)


def decoded_text(content: Column) -> Column:
    """Text of bytes of unknown encoding."""
    from tessera.sources.documents import decoded

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(decoded, na_action="ignore")

    # nearly all files are UTF-8, which needs no Python
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(decode(content))


def document_images(files: DataFrame) -> DataFrame:
    """files: document_id, content (DOCX) -> document_id, name, content of each image."""
    from tessera.sources.documents import images_of

    def run(batches):
        for pdf in batches:
            rows = [(d, n, c) for d, content in zip(pdf["document_id"], pdf["content"]) for n, c in images_of(content)]
            yield pd.DataFrame(rows, columns=["document_id", "name", "content"])

    return files.select("document_id", "content").mapInPandas(run, "document_id long, name string, content binary")


def base64_of(content: Column) -> Column:
    return F.coalesce(F.base64(content), F.lit(""))
