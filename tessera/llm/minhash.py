"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct shingles of five words (64-bit hashes); its signature has COMPONENTS min-hashes of b = 16
bits. At similarity 0.75 a component differs with probability 1/4, so a pair over the threshold differs in more than
MAX_DISTANCE = 35 of 72 components with probability under 1e-5, and the index guarantees every pair within that distance:
the signature is split into 18 chunks of four components, two signatures within 35 = 2 * 18 - 1 differences have a chunk
with one difference at most (pigeonhole), and each chunk is indexed under the four keys that leave one component out (the
allowed error, enumerated). Links are confirmed on full sets.

No bucket is turned into all its pairs. Equal sets are collapsed to one node first. Round 1 pairs each member of a bucket
with the bucket's first node only, round 2 with its most central one. Confirmed links give components, and a bucket whose
members are all in one is done. The members of other buckets, which an index on signatures alone can't keep from meeting (texts
around one common text or passage), are compared in round 3 by the exact prefix filter: pairs in different components that share
one of their rarest shingles, at a place and with sizes that allow the threshold. Where more texts than a task takes share a rare
shingle, they are dealt to blocks, and each pair of blocks is a task of its own that counts shared shingles and gives links only;
of shingles with the same holders one is taken.

What a task holds does not grow with a bucket, a hub or a component: buckets are read as streams, a hub's pairs are dealt over
parts with its text once each, and joins on labels are of narrow rows that Spark splits where they are skewed.

Defined cases: a text with fewer than five words is one shingle; null and wordless texts have the empty set and are linked with
nothing; a null doc_id is linked with nothing and stays; rows that repeat a doc_id are one document; a very long text is hashed whole
in one task; an empty table gives an empty table; columns other than doc_id and text pass through or are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, lowered, materialise, mix, quoted, release, shuffle_partitions, word_hashes

SHINGLE, PERCENT = 5, 75
CHUNKS, PER_CHUNK = 18, 4
COMPONENTS = CHUNKS * PER_CHUNK
MAX_DISTANCE = 2 * CHUNKS - 1
_rng = np.random.RandomState(20240501)
_A = _rng.randint(0, 1 << 62, COMPONENTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.randint(0, 1 << 62, COMPONENTS, dtype=np.int64).astype(np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 16_384
#: Members that tell a bucket's most central one, and bits of the sketch that tells rare shingles.
PROBES, SKETCH_BITS = 32, 17
#: Members of a bucket of which the central one is chosen, pairs of a hub in one part, and texts in a block.
CHOICE, PART, BLOCK_ROWS = 256, 128, 1000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = word_hashes(lowered(text))[2]
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    k = min(n, SHINGLE)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + w[i : n - k + 1 + i]
    return np.unique(mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    best = np.full(COMPONENTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _BLOCK):
        np.minimum(best, (_A[:, None] * s[None, i : i + _BLOCK] + _B[:, None]).min(axis=1), out=best)
    return (mix(best) >> np.uint64(48)).astype(np.uint16)


def _sets(batches):
    seen: set[bytes] = set()
    for b in batches:
        n_shingles, ids, sigs = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = shingles(text)
            n_shingles.append(len(s))
            if not len(s) or doc is None:
                ids.append(None)
                sigs.append(None)
                continue
            set_id = xxhash.xxh3_128_digest(s.tobytes())
            ids.append(set_id)
            # the signature goes with the set's first document in this task only
            sigs.append(None if set_id in seen else signature(s).tobytes())
            if len(seen) > 500_000:
                seen.clear()
            seen.add(set_id)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_shingles, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "signature"])


def _postings(batches):
    left_out = [[c for c in range(PER_CHUNK) if c != v] for v in range(PER_CHUNK)]
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
        for v, rest in enumerate(left_out):
            packed = (sig[:, :, rest[0]] << 32) | (sig[:, :, rest[1]] << 16) | sig[:, :, rest[2]]
            packed |= (np.arange(CHUNKS) * PER_CHUNK + v)[None, :] << 48
            yield pa.RecordBatch.from_arrays([pa.array(packed.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), CHUNKS))], names=["key", "node"])


PAIR, MEMBER = 0, 1


def _stars(batches):
    """Over (key, node) in order: a pair of each member with the first of its bucket, and the members of buckets with three
    or more. A stream: what is held doesn't grow with a bucket."""
    now, hub, held = None, None, []
    tried: set[tuple[int, int]] = set()
    out: list[tuple] = []

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["kind", "key", "a", "b"])

    for b in batches:
        for key, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key != now:
                now, hub, held = key, node, [node]
                continue
            if (hub, node) not in tried:
                if len(tried) > 1_000_000:
                    tried.clear()
                tried.add((hub, node))
                out.append((PAIR, None, hub, node))
            if len(held) == 1:
                held.append(node)
            else:
                out += [(MEMBER, key, x, None) for x in (*held, node)]
                held = []
        if len(out) > 20_000:
            yield batch(out)
            out = []
    yield batch(out)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
    return same > 0 and 100 * same >= PERCENT * (len(x) + len(y) - same)


def _confirmed(batches):
    """Over (a, part, b, text), sorted, a's own text first with a null b: the pairs that are similar enough. Of a doc_id that repeats,
    any of its texts may be."""
    now, hubs = None, {}
    for batch in batches:
        out = []
        for a, part, b, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, part) != now:
                now, hubs = (a, part), {}
            s = shingles(text)
            if b is None:
                hubs[xxhash.xxh3_128_digest(s.tobytes())] = s
            elif any(_similar(x, s) for x in hubs.values()):
                out.append((a, b))
        cols = list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. a's text goes once to each part of its pairs; texts are never broadcast."""
    spark = pairs.sparkSession
    large = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PART).select("a", F.ceil(F.col("n") / PART).cast("int").alias("parts"), "n")
    known = lookup(pairs.select("a", "b"), materialise(large, "large-hubs"), "a", "n")
    dealt = known.select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b")
    others = dealt.join(texts.select(F.col("doc_id").alias("b"), "text").hint("merge"), "b").select("a", "part", "b", "text")
    hubs = dealt.select("a", "part").distinct().join(texts.select(F.col("doc_id").alias("a"), "text").hint("merge"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = hubs.unionByName(others).repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirmed, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable): smallest label of neighbours, then of the label, until nothing changes."""
    edges = edges.select("a", "b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        hop = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_hop"))
        jump = labels.select(F.col("node").alias("_hop"), F.col("label").alias("_jump"))
        new = materialise(hop.join(jump, "_hop").select("node", F.least("_hop", "_jump").alias("label"), (F.least("_hop", "_jump") != F.col("label")).alias("_moved")), "labels")
        release(before)
        before, labels = new, new.select("node", "label")
        if new.filter("_moved").isEmpty():
            release(both)
            return labels


def _hubs(batches):
    """Over (key, node, label, signature), sorted by key: pairs (hub, member) of each member of a bucket with its most central one, if they
    are in different components and within MAX_DISTANCE. Central: of the first CHOICE members, close to most of a few; members come
    in the order of a hash, so these are a fair choice."""
    now, first, hub = None, [], None
    tried: set[tuple[int, int]] = set()

    def of(rows):
        node, label = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return node, label, np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, COMPONENTS)

    def chosen(rows):
        node, label, sig = of(rows)
        some = sig[np.linspace(0, len(rows) - 1, min(len(rows), PROBES)).astype(int)]
        close = sum((np.count_nonzero(sig != x, axis=1) <= COMPONENTS * (100 - PERCENT) // 100).astype(int) for x in some)
        at = int(np.argmax(close))
        return int(node[at]), int(label[at]), sig[at]

    def pairs(rows, hub):
        node, label, sig = of(rows)
        at = np.flatnonzero((label != hub[1]) & (np.count_nonzero(sig != hub[2], axis=1) <= MAX_DISTANCE))
        return {(hub[0], int(node[i])) for i in at}

    def ended(rows, hub):
        return pairs(rows, hub or chosen(rows)) if hub and rows or len(rows) > 1 else set()

    for b in batches:
        found: set[tuple[int, int]] = set()
        for key, *row in zip(*(c.to_pylist() for c in b.columns)):
            if key != now:
                found |= ended(first, hub)
                now, first, hub = key, [], None
            first.append(row)
            if len(first) >= CHOICE:
                hub = hub or chosen(first)
                found |= pairs(first, hub)
                first = []
        yield _new(found, tried)
    yield _new(ended(first, hub), tried)


def _new(found: set, tried: set):
    """A batch of the pairs that this task has not given already."""
    new = found - tried
    if len(tried) > 1_000_000:
        tried.clear()
    tried.update(new)
    cols = list(zip(*new)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketched(batches):
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            np.add.at(counts, _cells(shingles(text)), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])


def _prefixes(counts):
    """(token, node, label, size, place) of the rarest shingles of each set: two sets over the threshold share one of these."""

    def run(batches):
        n_of = counts.value
        for b in batches:
            out = [[], [], [], [], []]
            for node, label, text in zip(*(c.to_pylist() for c in b.columns)):
                s = shingles(text)
                n = len(s)
                first = s[np.lexsort((s, n_of[_cells(s)]))][: n - -(-PERCENT * n // 100) + 1]
                for o, x in zip(out, (first.view(np.int64), np.full(len(first), node), np.full(len(first), label), np.full(len(first), n), np.arange(len(first)))):
                    o.append(x)
            cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["token", "node", "label", "size", "place"])

    return run


def _sharing(batches):
    """Over (token, node, label, size, place), sorted by token: pairs in different components that may be similar enough if this is the
    first shingle they share: sizes allow it, and so does what comes after it. A token with more than BLOCK_ROWS rows gives one row, with a
    null a: b is the token."""
    now, rows, n = None, [], 0
    tried: set[tuple[int, int]] = set()

    def pairs(rows):
        node, label, size, place = (np.array(x, np.int64) for x in zip(*rows))
        names, n = np.unique(label, return_counts=True)
        if len(names) == 1:
            return set()
        out = set()
        left = size - place - 1
        # every pair of different components has a member outside the largest one
        for i in np.flatnonzero(label != names[np.argmax(n)]):
            both = 100 + PERCENT
            ok = (label != label[i]) & ((1 + np.minimum(left, left[i])) * both >= PERCENT * (size + size[i]))
            out.update((min(node[i], node[j]), max(node[i], node[j])) for j in np.flatnonzero(ok))
        return out

    def ended():
        return {(None, now)} if n > BLOCK_ROWS else pairs(rows) if len(rows) > 1 else set()

    for b in batches:
        found: set = set()
        for token, *row in zip(*(c.to_pylist() for c in b.columns)):
            if token != now:
                found |= ended()
                now, rows, n = token, [], 0
            n += 1
            if n <= BLOCK_ROWS:
                rows.append(row)
            else:
                rows = []
        yield _new(found, tried)
    yield _new(ended(), tried)


def _across(batches):
    """Over (token, i, j, block, node, label, text), sorted by the first three: links between the texts of blocks i and j of one token in
    different components (within the block where i is j), by the shingles they share."""
    now, rows = None, []

    def links(rows):
        sets = [shingles(r[3]) for r in rows]
        block, node, label = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        size = np.array([len(x) for x in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(whole := np.concatenate(sets), kind="stable")
        whole, of = whole[order], of[order]
        split = block.min() != block.max()
        found = set()
        for i in np.flatnonzero(block == block.min()) if split else range(len(sets)):
            lo, hi = np.searchsorted(whole, sets[i]), np.searchsorted(whole, sets[i], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            same = np.bincount(of[at], minlength=len(sets))
            ok = (label != label[i]) & (100 * same >= PERCENT * (size + size[i] - same)) & (block != block[i] if split else True)
            found.update((min(node[i], node[j]), max(node[i], node[j])) for j in np.flatnonzero(ok))
        return found

    for b in batches:
        found: set = set()
        for token, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (token, i, j) != now:
                found |= links(rows) if len(rows) > 1 else set()
                now, rows = (token, i, j), []
            rows.append(row)
        yield _new(found, set())
    yield _new(links(rows) if len(rows) > 1 else set(), set())


def _in_blocks(prefixes: DataFrame, open_tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the texts that share one of these tokens, which too many share for one task. A pair of blocks is a task."""
    spark = prefixes.sparkSession
    rows = prefixes.join(open_tokens, "token").select("token", "node", "label").distinct()
    of = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("holders"), F.countDistinct("label").alias("labels")).filter("labels > 1")
    of = materialise(of.groupBy("n", "holders").agg(F.min("token").alias("token")).select("token", "n"), "open-tokens")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = lookup(rows, of.select("token", blocks.alias("blocks"), "n"), "token", "n").filter("blocks IS NOT NULL")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
    full = met.join(texts.select(F.col("doc_id").alias("node"), "text").hint("merge"), "node").select("token", "i", "j", "block", "node", "label", "text")
    full = full.repartition(shuffle_partitions(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return full.mapInArrow(_across, "a long, b long").distinct()


def _rest(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: node, label -> candidate pairs and links that make up all pairs of members in different components over the threshold,
    by shared rare shingles. Rare is what a sketch of fixed size says; any order would give whole results, this one keeps common
    passages out."""
    spark = members.sparkSession
    placed = materialise(members.join(texts.hint("merge"), members["node"] == texts["doc_id"]).select("node", "label", "text"), "rest")
    cells = placed.select("text").mapInArrow(_sketched, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2**SKETCH_BITS rows at most
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    prefixes = placed.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts)), "token long, node long, label long, size long, place long")
    found = prefixes.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token").mapInArrow(_sharing, "a long, b long")
    found = materialise(found.distinct(), "sharing")
    opened = found.filter("a IS NULL").select(F.col("b").alias("token"))
    links = texts.sparkSession.createDataFrame([], "a long, b long") if opened.isEmpty() else _in_blocks(prefixes, opened, texts)
    return found.filter("a IS NOT NULL"), links


def near_groups(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = materialise(docs.mapInArrow(_sets, "doc_id long, n_shingles long, set_id binary, signature binary"), "sets")
    by_set = sets.filter(F.col("set_id").isNotNull()).groupBy("set_id")
    nodes = materialise(
        by_set.agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("signature").isNotNull(), F.col("doc_id"))).alias("node"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "nodes"
    )
    # each node has its signature once, even where a doc_id repeats
    signed = materialise(
        sets.filter(F.col("signature").isNotNull()).join(nodes.select(F.col("node").alias("doc_id"), "set_id"), ["doc_id", "set_id"]).select(F.col("doc_id").alias("node"), "signature", "n_shingles").distinct(), "signed"
    )
    order = ["key", "node"]
    postings = signed.select("node", "signature").mapInArrow(_postings, "key long, node long")
    dealt = postings.repartition(shuffle_partitions(spark), "key").sortWithinPartitions(*order)
    stars = materialise(dealt.mapInArrow(_stars, "kind int, key long, a long, b long"), "stars")

    tried = materialise(stars.filter(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    involved = tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = materialise(docs.hint("merge").join(involved, "doc_id"), "texts")
    links = materialise(confirm(tried, texts), "links")
    labels = components(links)
    members = stars.filter(F.col("kind") == MEMBER).select("key", F.col("a").alias("node")).distinct()
    for last in (False, True):
        placed = materialise(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
        open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
        open_keys = materialise(open_keys.select("key", F.lit(True).alias("is_open"), "n"), "open-keys")
        before, members = members, materialise(lookup(placed, open_keys, "key", "n").filter("is_open").drop("is_open"), "open-buckets")
        release(placed, open_keys, before)
        if members.isEmpty():
            break
        sure = None
        if last:
            found, sure = _rest(members.select("node", "label").distinct(), texts)
        else:
            full = members.join(signed, "node").select("key", "node", "label", "signature")
            found = full.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", F.xxhash64("node")).mapInArrow(_hubs, "a long, b long").distinct()
        known = tried.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
        found = materialise(found.join(known, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti"), "pairs")
        new = confirm(found, texts)
        new = materialise(new.unionByName(sure).distinct() if last else new, "links")
        members = members.drop("label")
        if not new.isEmpty():
            tried, links = tried.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), links.unionByName(new)
            labels = components(links)

    placed = materialise(nodes.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("label"), "least", "n"), "placed")
    heads = materialise(placed.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_sets")), "heads")
    by_set = materialise(lookup(placed, heads, "label", "_sets").select("set_id", "component_id", "n"), "components")
    out = lookup(sets.select("doc_id", "n_shingles", "set_id"), by_set, "set_id", "n")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with their own columns."""
    gone = near_groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    # an anti-join gives columns of docs only, so no names can clash
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
