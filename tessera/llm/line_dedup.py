"""Line dedup: range-partitioned line hashes, first occurrences streamed, keep bitmaps instead of text.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least MIN_CHARS code points that is
found in at least MIN_DOCS documents keeps its lines only in the largest doc_id holding it.

Rows (hash, doc_id, positions) are range-partitioned by hash and falling doc_id, so the rows of a very common line spread over
as many partitions as they fill, and one (hash, doc_id) never straddles two. A partition is then read as a stream: of each
hash the first document is the one that stays, and later ones are dropped once three have been seen. Only the runs at the two
ends of a partition can go on in its neighbours, and a hash whose undecided rows (of one doc_id that repeats) exceed HELD is left
open too; their totals are joined back. What comes out is a compressed bitmap of kept lines for each document.

Defined cases: null or empty text is one empty line; rows with a null doc_id keep all lines and count as no document; rows
that repeat a doc_id count as one document, each with its own bitmap; a very long text is read whole in one task, its rows are
one a distinct line; an empty table gives an empty table; columns other than doc_id and text pass through, whatever their names
(n_lines and n_dropped get an underscore where the table has these already).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_TABLE, WS_BYTES, fresh, lookup, materialise, packed, release, shuffle_partitions, unpacked

MIN_CHARS, MIN_DOCS = 20, 3
#: Undecided rows of one hash that a task holds.
HELD = 1000
_ROWS = "hash binary, doc_id long, text_key long, positions array<int>"


def line_key(line: bytes) -> bytes:
    return line.strip(WS_BYTES).translate(LOWER_TABLE)


def _line_rows(batches):
    for b in batches:
        out = ([], [], [], [])
        for doc, text_key, text in zip(*(c.to_pylist() for c in b.columns)):
            if doc is None or not text:
                continue
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                if len(line) >= MIN_CHARS:
                    key = line_key(line)
                    if len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
            for h, at in found.items():
                for o, x in zip(out, (h, doc, text_key, at)):
                    o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int32()))], names=["hash", "doc_id", "text_key", "positions"])


DROP, OPEN, TOTAL = 0, 1, 2


def _stream(batches):
    """Rows in order of hash and falling doc_id -> three kinds of rows: DROP, a row that goes; OPEN, a row of a hash that is decided
    by its totals (the partition's first and last hash, and hashes with too many undecided rows); TOTAL, how many documents such a
    hash has here (n), how many OPEN rows (text_key) and the largest of the documents. Holds HELD rows at most."""
    first, now, n, n_open, last_doc, keeper = None, None, 0, 0, None, None
    held: list[tuple] = []  # rows of the current hash that go if a third document comes
    out: list[tuple] = []

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["hash", "doc_id", "text_key", "positions", "kind", "n"])

    for b in batches:
        for h, doc, key, at in zip(*(c.to_pylist() for c in b.columns)):
            if h != now:
                if now is None:
                    first = h
                elif n_open:
                    out.append((now, keeper, n_open, None, TOTAL, n))
                now, n, n_open, last_doc, keeper, held = h, 0, 0, None, doc, []
            if doc != last_doc:
                n, last_doc = n + 1, doc
            if h == first or n_open:
                out.append((h, doc, key, at, OPEN, None))
                n_open += 1
            elif n < MIN_DOCS:
                held.append((h, doc, key, at))
                if len(held) > HELD:
                    out += [(*x, OPEN, None) for x in held]
                    n_open, held = len(held), []
            else:
                out += [(*x, DROP, None) for x in held if x[1] != keeper]
                held = []
                out.append((h, doc, key, at, DROP, None))
        if len(out) >= 4096:
            yield batch(out)
            out = []
    if now is not None:
        out += [(*x, OPEN, None) for x in held]
        # rows that were dropped here count for the neighbours' totals too
        out.append((now, keeper, n_open + len(held), None, TOTAL, n))
    yield batch(out)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text, for rows that repeat a doc_id) and the positions of the lines that go."""
    spark = docs.sparkSession
    rows = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_line_rows, _ROWS), "line-rows")
    order = [F.col("hash"), F.col("doc_id").desc()]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    seen = materialise(dealt.mapInArrow(_stream, _ROWS + ", kind int, n long"), "line-drops")
    release(rows)
    totals = seen.filter(F.col("kind") == TOTAL).groupBy("hash").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("largest"), F.sum("text_key").alias("n_open"))
    opened = seen.filter(F.col("kind") == OPEN).select("hash", "doc_id", "text_key", "positions")
    decided = lookup(opened, materialise(totals, "line-totals"), "hash", "n_open").filter((F.col("n_docs") >= MIN_DOCS) & (F.col("doc_id") < F.col("largest")))
    cols = ["doc_id", "text_key", "positions"]
    return seen.filter(F.col("kind") == DROP).select(*cols).unionByName(decided.select(*cols))


def _bitmaps(batches):
    for b in batches:
        out = []
        for parts, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            bits = np.ones(n, dtype=bool)
            for at in parts:
                bits[at] = False
            out.append((int(n - bits.sum()), zlib.compress(np.packbits(bits).tobytes())))
        cols = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped and keep_bitmap (zlib of packed bits, first line first) of each document that
    loses a line; the others keep all. Texts don't move."""
    # a set, as rows that repeat have the same positions
    per_doc = dropped_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_set("positions").alias("parts"))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_lines(F.col("text")).alias("n_lines")).distinct()
    found = per_doc.join(sizes, ["doc_id", "text_key"]).select("doc_id", "text_key", "parts", "n_lines")
    return found.mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep_bitmap binary")


def n_lines(text):
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")


def _apply(batches):
    """Over text, row, bitmap (null: all lines stay), number of lines and of dropped ones."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, bitmap in enumerate(b.column(2).to_pylist()):
            if bitmap is not None:
                lines = texts[i].split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
                texts[i] = "\n".join(x for x, keep in zip(lines, bits) if keep)
        yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(0).type), b.column(1), b.column(3), b.column(4)], names=["text", "row", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs, text without its dropped lines, with n_lines and n_dropped (under fresh names where docs has those)."""
    at = [c for c in docs.columns if c != "text"].index("doc_id")
    keyed = packed(docs, "text").select("text", "row", F.col(f"row.c{at}").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    joined = keyed.join(bitmaps.select("doc_id", "text_key", "n_dropped", "keep_bitmap"), ["doc_id", "text_key"], "left")
    out = joined.select("text", "row", "keep_bitmap", n_lines(F.col("text")).alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    applied = out.mapInArrow(_apply, out.select("text", "row", "n_lines", "n_dropped").schema)
    lines, lost = fresh(docs.columns, "n_lines", "n_dropped")
    return applied.select(*unpacked(docs.columns, "text"), F.col("n_lines").alias(lines), F.col("n_dropped").alias(lost))


def drop_lines(docs: DataFrame) -> DataFrame:
    return apply_bitmaps(docs, line_keep_bitmaps(docs))
