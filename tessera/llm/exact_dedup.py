"""Exact dedup on an extendible-hash index.

Texts are equal when their bytes without white space are. A 64-bit key of those bytes addresses the index. The directory
starts with one bucket; an overfull bucket is split at its next bit, and where it is as deep as the directory, the directory
doubles. What decides is the weight of each key prefix, read by levels: a first histogram of the leading bits, then
finer ones inside the prefixes that are still overfull, down to whole keys. The directory is kept as the sorted first keys of its
buckets (a slot run each).

Each scan task collapses its own equal texts to one entry with its members, so a hot text comes once a task. Each owner task gets
the entries of its buckets in key order, chains the distinct texts of a key, tells them apart by comparing their bytes, and writes two
kinds of rows to the shared folder: the place (key, chain position) of each entry's members at once, and the head of each
chained text when its key is over. Documents get their result by that place in the index.

Defined cases: null text counts as empty and all empty texts are one group; a null doc_id stays only if its whole group has
no other id; repeated rows are members of their group like any other; a very long text is one entry, its bytes are moved once; an
empty table gives an empty table; other columns are ignored, never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS_BYTES, lookup, materialise, shuffle_partitions

#: A bucket splits while the distinct texts in its key range weigh more: a quarter of an even share, within these bounds.
BUCKET_BYTES = (2 << 20, 64 << 20)
#: Bits of the first histogram and of each finer one, so the driver holds 2**16 counts and 2**6 for each overfull prefix.
FIRST_BITS, MORE_BITS = 16, 6
#: A scan task flushes its own collapsed texts when they hold this many bytes.
COMBINE_BYTES = 32 << 20
#: Members of an entry that travel in one row.
MEMBERS = 50_000


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WS_BYTES)


def _key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)  # as a signed long, in the order of the unsigned one


class Directory:
    """Buckets as (prefix, local depth) of the unsigned key."""

    def __init__(self):
        self.leaves: set[tuple[int, int]] = {(0, 0)}
        self.depth = 0

    def split(self, weights: dict[int, int], bits: int, capacity: int, known: int = 0) -> list[int]:
        """Split overfull buckets of known bits or more by the weights of prefixes of so many bits; prefixes that are overfull
        themselves come back."""
        total: dict[tuple[int, int], int] = {}
        for x, w in weights.items():
            for d in range(known, bits + 1):
                at = (x >> (bits - d), d)
                total[at] = total.get(at, 0) + w
        over, work = [], [x for x in self.leaves if total.get(x, 0) > capacity]
        while work:
            prefix, local = work.pop()
            if total.get((prefix, local), 0) <= capacity:
                continue
            if local == bits:
                over.append(prefix)
                continue
            if local == self.depth:
                self.depth += 1  # the directory doubles
            self.leaves.remove((prefix, local))
            halves = [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
            self.leaves.update(halves)
            work += halves
        return over

    def starts(self) -> np.ndarray:
        """The first unsigned key of each bucket, sorted."""
        return np.array(sorted(p << (64 - d) if d else 0 for p, d in self.leaves), np.uint64)


def build_directory(entries: DataFrame, capacity: int) -> np.ndarray:
    """First keys of the buckets; entries: key, n_bytes."""
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    found, bits, step, over = Directory(), FIRST_BITS, 0, None
    while over != []:
        cell = F.shiftrightunsigned(unsigned, 64 - bits) if bits < 64 else unsigned
        rows = entries
        if over is not None:  # only inside prefixes that are still overfull
            before = entries.sparkSession.createDataFrame([(x,) for x in over], "up long")
            rows = entries.withColumn("up", F.shiftrightunsigned(unsigned, 64 - bits + step)).join(F.broadcast(before), "up", "left_semi")
        weights = rows.groupBy(cell.alias("cell")).agg(F.sum(F.col("n_bytes") + 100).alias("w")).toArrow()
        over = found.split({x & ((1 << 64) - 1): w for x, w in zip(weights["cell"].to_pylist(), weights["w"].to_pylist())}, bits, capacity, bits - step if over is not None else 0)
        if bits == 64:
            break
        step = min(MORE_BITS, 64 - bits)
        bits += step
    return found.starts()


def _better(n: int, doc, best: tuple) -> bool:
    """More code points first, then the smaller id; null ids last."""
    return (-n, doc is None, doc or 0) < (-best[0], best[1] is None, best[1] or 0)


_ENTRY = "key long, norm binary, n_bytes long, n_cp long, best long, members array<long>"


def _collapsed(batches):
    """An entry for each distinct text of this task: its bytes, its best document and all its documents."""
    held, size = {}, 0

    def flush():
        rows = []
        for x, (n, best, members) in held.items():
            key = _key(x)
            rows += [(key, x, len(x), n, best, members[i : i + MEMBERS]) for i in range(0, len(members), MEMBERS)]
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _ENTRY.split(", ")])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, n = normalised(text), len(text or "")
            old = held.get(x)
            if old is None:
                held[x] = [n, doc, [doc]]
                size += len(x) + 100
            else:
                if _better(n, doc, old):
                    old[:2] = n, doc
                old[2].append(doc)
                size += 8
            if size > COMBINE_BYTES:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


PLACE, HEAD = 0, 1
_INDEX = "kind int, key long, place int, members array<long>, keep_id long, n long, digest binary"


def _own(batches):
    """Over entries in key order: the chain of the current key holds its distinct texts. Members leave at once."""
    now, chain = None, []

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])

    def heads():
        return [(HEAD, now, i, None, best, n, hashlib.sha256(norm).digest()) for i, (norm, _, best, n) in enumerate(chain)]

    out = []
    for b in batches:
        for key, norm, n_cp, best, members in zip(*(b.column(x).to_pylist() for x in ("key", "norm", "n_cp", "best", "members"))):
            if key != now:
                out += heads()
                now, chain = key, []
            for place, x in enumerate(chain):
                if x[0] == norm:  # bytes against bytes
                    if _better(n_cp, best, (x[1], x[2])):
                        x[1:3] = n_cp, best
                    x[3] += len(members)
                    break
            else:
                place = len(chain)
                chain.append([norm, n_cp, best, len(members)])
            out.append((PLACE, key, place, members, None, len(members), None))
        if len(out) > 10_000:
            yield batch(out)
            out = []
    yield batch(out + heads())


def _buckets(starts: np.ndarray):
    def run(batches):
        for b in batches:
            unsigned = b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            at = np.searchsorted(starts, unsigned, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])

    return run


def exact_groups(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    entries = materialise(docs.select("doc_id", "text").mapInArrow(_collapsed, _ENTRY), "dedup-entries")
    # a text that several tasks hold weighs once
    weights = entries.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    n = shuffle_partitions(docs.sparkSession)
    if capacity is None:
        weights = materialise(weights, "dedup-weights")
        total = weights.agg(F.sum("n_bytes")).first()[0] or 0
        capacity = min(BUCKET_BYTES[1], max(BUCKET_BYTES[0], total // (4 * n)))
    starts = build_directory(weights, capacity)
    # a bucket's number is its partition's: a hash of it would put several into some tasks
    dealt = entries.mapInArrow(_buckets(starts), "bucket int, " + _ENTRY).repartitionById(max(n, len(starts)), "bucket").sortWithinPartitions("key")
    index = materialise(dealt.mapInArrow(_own, _INDEX), "dedup-index")
    heads = index.filter(F.col("kind") == HEAD).select(F.struct("key", "place").alias("at"), "keep_id", F.col("n").alias("group_size"), "digest", F.col("n").alias("weight"))
    placed = index.filter(F.col("kind") == PLACE).select(F.struct("key", "place").alias("at"), F.explode("members").alias("doc_id"))
    found = lookup(placed, heads, "at", "weight")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
