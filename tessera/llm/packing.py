"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most CAPACITY tokens; full pieces are bins of their own. The remainders are packed into
bins that never hold two pieces of one source or of one duplicate cluster. Bins are ordered by what they have left; each
carries a bitmap of its sources and one of its clusters, and the search starts at the tightest bin that is large enough and
goes on to the next larger one until it finds a bin without conflict.

The order is a segment tree over the amounts left. An inner node holds the bits that all bins below it have in common, so a
subtree in which every bin has the source (say, a source with a third of all rows) is passed over in one step.

Bins are local to shards: documents are dealt by a hash to as many shards as there are SHARD_ROWS documents, whatever their
source, so no task's share grows with the input or with a hot source.

Defined cases: null and wordless texts have no tokens and get no bin (bin null); a null source or cluster conflicts with
nothing; equal pieces are placed in order of doc_id and piece; rows that repeat are packed each; a very long text is cut into
full bins and one remainder; an empty table gives an empty result; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, WS, materialise

CAPACITY = 2048
SHARD_ROWS = 8192
_OUT = "doc_id long, source string, cluster long, n_tokens long, piece int, start long, length int, shard int, bin int, left_over int"


class BinTree:
    """Bins by what they have left (0 to capacity), with the bits that all bins of a subtree share."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.at: list[list] = [[] for _ in range(self.size)]
        # of an empty subtree: all ones (-1), so that it is always passed over
        self.sources, self.clusters = [-1] * (2 * self.size), [-1] * (2 * self.size)

    def _update(self, left: int) -> None:
        s = c = -1
        for b in self.at[left]:
            s, c = s & b[1], c & b[2]
        i = left + self.size
        self.sources[i], self.clusters[i] = s, c
        while i > 1:
            i >>= 1
            self.sources[i] = self.sources[2 * i] & self.sources[2 * i + 1]
            self.clusters[i] = self.clusters[2 * i] & self.clusters[2 * i + 1]

    def add(self, left: int, b: list) -> None:
        self.at[left].append(b)
        self._update(left)

    def take(self, need: int, source: int, cluster: int) -> tuple[int, list] | None:
        """Remove and return the tightest bin with room for need and neither bit: (left, bin). Ties: the oldest bin."""
        full = lambda i: self.sources[i] == -1 or self.sources[i] & source or self.clusters[i] & cluster
        stack = []
        lo, hi = need + self.size, 2 * self.size - 1
        right = []
        while lo <= hi:  # the subtrees that make up [need, size), from the left
            if lo & 1:
                stack.append(lo)
                lo += 1
            if not hi & 1:
                right.append(hi)
                hi -= 1
            lo, hi = lo >> 1, hi >> 1
        stack = (stack + right[::-1])[::-1]
        while stack:
            i = stack.pop()
            if full(i):
                continue
            if i < self.size:
                stack += (2 * i + 1, 2 * i)
                continue
            bins = self.at[i - self.size]
            for k, b in enumerate(bins):
                if not (b[1] & source or b[2] & cluster):
                    del bins[k]
                    self._update(i - self.size)
                    return i - self.size, b
        return None


def pack(pieces: list[tuple], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """pieces: (length, source, cluster), longest first -> for each the number of its bin and what that has left at the end."""
    tree, bits, bins, placed = BinTree(capacity), ({}, {}), [], []
    bit = lambda table, x: 0 if x is None else 1 << table.setdefault(x, len(table))
    for length, source, cluster in pieces:
        if length >= capacity:
            bins.append(0)
            placed.append(len(bins) - 1)
            continue
        s, c = bit(bits[0], source), bit(bits[1], cluster)
        found = tree.take(length, s, c)
        if found is None:
            bins.append(capacity)
            found = (capacity, [len(bins) - 1, 0, 0])
        left, b = found
        b[1] |= s
        b[2] |= c
        bins[b[0]] = left - length
        placed.append(b[0])
        tree.add(left - length, b)
    return [(b, bins[b]) for b in placed]


def _packed(capacity: int):
    def run(batches):
        def shard_rows(shard, rows):
            rows.sort(key=lambda r: (-r[5], r[0] is None, r[0] or 0, r[4]))
            where = pack([(r[5], r[1], r[2]) for r in rows], capacity)
            out = [(doc, source, cluster, n, piece, piece * capacity if n else 0, length, shard, b, left) for (doc, source, cluster, n, piece, length), (b, left) in zip(rows, where)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            names = [x.split()[0] for x in _OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        now, rows = None, []
        for b in batches:
            for doc, source, cluster, n, shard in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    if rows:
                        yield shard_rows(now, rows)
                    now, rows = shard, []
                for piece in range(max(1, -(-n // capacity))):
                    rows.append((doc, source, cluster, n, piece, min(capacity, n - piece * capacity)))
        if rows:
            yield shard_rows(now, rows)

    return run


def best_fit(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """items: doc_id, source, cluster (long), n_tokens. One row a piece: its document's columns, piece, start, length, shard,
    bin (in the shard) and left_over (of the bin)."""
    items = items.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    items = materialise(items, "pack-items")  # narrow; texts are read once
    shards = max(1, -(-items.count() // shard_rows))
    # mixes source in, so that a source's rows spread even where ids follow a pattern, and the place, so that repeated rows do
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    # a shard's number is its partition's
    some = dealt.filter("n_tokens > 0").repartitionById(shards, "shard").sortWithinPartitions("shard")
    packed = some.mapInArrow(_packed(capacity), _OUT)
    none = dealt.filter("n_tokens = 0").select("doc_id", "source", "cluster", "n_tokens", *(F.lit(None).cast(k).alias(x) for x, k in (y.split() for y in _OUT.split(", ")[4:])))
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokens are words; a cluster is the documents whose texts are equal but for white space."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return best_fit(docs.select("doc_id", "source", F.xxhash64(F.translate(text, WS, "")).alias("cluster"), words.alias("n_tokens")), capacity)
