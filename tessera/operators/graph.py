"""The entity graph: degrees, diffusion, neighbourhoods, similarity edges and communities.

Edges are a table (source_id, target_id, weight); nodes are ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.retrieval import small, top_k
from tessera.operators.storage import cut

#: Vectors of a block; a task multiplies one block by another, some rows at a time. Each vector is shuffled once for each block.
BLOCK, BLOCK_ROWS = 4000, 256


def accumulate(edges: DataFrame) -> DataFrame:
    """Parallel edges summed; a null or zero weight counts 1."""
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return edges.groupBy("source_id", "target_id").agg(F.sum(w).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge a pair, the first one's weight, no loops. edges has id."""
    a, b = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    return edges.filter("source_id <> target_id").groupBy(a.alias("a"), b.alias("b")).agg(F.min_by("weight", "id").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) with degree and specificity 1 / max(1, degree). A loop counts once. Two equi-joins stand for the disjunction
    `source or target`: counts by end, added up."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.filter("source_id <> target_id").select(F.col("target_id").alias("id")))
    n = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("specificity", 1.0 / F.greatest(F.lit(1), F.col("degree")))


def seeds_by_text(entities: DataFrame, pattern: str, k: int) -> DataFrame:
    like = f"%{pattern}%"
    return entities.filter(F.col("name").ilike(like) | F.col("description").ilike(like)).orderBy(F.desc("specificity"), "id").limit(k)


def pagerank(edges: DataFrame, seeds: DataFrame, *, alpha: float = 0.85, iterations: int = 30, tolerance: float | None = 1e-6, cut_every: int = 5) -> DataFrame:
    """Personalised PageRank of all queries together. seeds: query_id, id -> query_id, id, rank mass.

    Every edge counts in both directions; a query's mass starts even on its seeds that have an edge. Without a tolerance exactly
    `iterations` rounds; with one, stops at the round that moves less than it for all queries and keeps the round before."""
    one = accumulate(edges)
    both = one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")).groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    out = both.groupBy("source_id").agg(F.sum("weight").alias("_out"))
    # steps is used in every round
    steps = cut(both.join(out, "source_id").select("source_id", "target_id", (F.col("weight") / F.col("_out")).alias("share")))
    here = seeds.select("query_id", "id").distinct().join(steps.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    start = here.withColumn("p", 1.0 / F.count("*").over(W.partitionBy("query_id")))
    start = cut(start.select("query_id", "id", "p"))
    r = start
    for i in range(iterations):
        moved = r.join(steps, r["id"] == steps["source_id"]).groupBy("query_id", F.col("target_id").alias("id")).agg((alpha * F.sum(F.col("p") * F.col("share"))).alias("p"))
        new = moved.unionByName(start.select("query_id", "id", ((1 - alpha) * F.col("p")).alias("p"))).groupBy("query_id", "id").agg(F.sum("p").alias("p"))
        if tolerance is not None or (i + 1) % cut_every == 0:
            new = cut(new)
        if tolerance is not None:
            diff = new.withColumnRenamed("p", "n").join(r, ["query_id", "id"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))).alias("d"))
            if (diff.agg(F.max("d")).first()[0] or 0.0) < tolerance:
                return r
        r = new
    return r


def ppr(edges: DataFrame, seeds: DataFrame, entities: DataFrame, k: int = 20, **kw) -> DataFrame:
    """query_id, id, score, rank; the score is the mass times 1 + specificity."""
    r = pagerank(edges, seeds, **kw).join(entities.select("id", "specificity"), "id", "left")
    scored = r.select("query_id", "id", F.round(F.col("p") * (1 + F.coalesce("specificity", F.lit(0.0))), 8).alias("score"))
    return top_k(scored, [F.desc("score"), F.asc("id")], k, keys=["query_id"])


def entity_chunks(found: DataFrame, mentions: DataFrame, utility: DataFrame, k: int) -> DataFrame:
    """found: query_id, id (entities); mentions: chunk_id, entity_id; utility: chunk_id, utility_ema. Of each query the first 3 k
    chunks by id, then the k best of those by utility."""
    hit = found.join(mentions, found["id"] == mentions["entity_id"]).select("query_id", "chunk_id").distinct()
    first = top_k(hit, [F.asc("chunk_id")], 3 * k, keys=["query_id"], rank="_by_id").drop("_by_id")
    rated = first.join(utility.select("chunk_id", "utility_ema"), "chunk_id", "left").withColumn("utility_ema", F.coalesce("utility_ema", F.lit(0.5)))
    return top_k(rated, [F.desc("utility_ema"), F.asc("chunk_id")], k, keys=["query_id"])


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within so many hops of the seeds, and the edges touched on the way."""
    ends = edges.select("id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    ways = ends.unionByName(ends.select("id", F.col("b").alias("a"), F.col("a").alias("b")))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier, touched = seen, None
    for h in range(1, hops + 1):
        step = ways.withColumnRenamed("id", "edge_id").join(frontier.select(F.col("id").alias("a")), "a")
        used = step.select("edge_id").distinct()
        touched = used if touched is None else touched.unionByName(used).distinct()
        frontier = cut(step.select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen, edges.join(touched.withColumnRenamed("edge_id", "id"), "id", "left_semi")


def similar_pairs(vectors: DataFrame, threshold: float, *, id_col: str = "id", group_col: str | None = None, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """Pairs a < b of vectors with a cosine of at least the threshold; with group_col only pairs of different groups.

    All vectors are dealt to blocks; each pair of blocks is one task's matrix product, so no row is made for a pair that falls short,
    and a task holds two blocks whatever the number of vectors. Vectors are shuffled as they come (floats stay floats)."""
    v = vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v"), (F.col(group_col).cast("string") if group_col else F.lit("")).alias("g"))
    n = max(1, -(-v.count() // block))
    dealt = v.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # block k meets blocks 0 to n-1; the key names the unordered pair
    sides = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"x": F.least("k", "o"), "y": F.greatest("k", "o")})

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), np.float64)
        length = np.linalg.norm(m, axis=1)
        pdf, m = pdf[length > 0], m[length > 0] / length[length > 0][:, None]
        x, y = int(pdf["x"].iloc[0]) if len(pdf) else 0, int(pdf["y"].iloc[0]) if len(pdf) else 0
        left, right = np.flatnonzero(pdf["k"].to_numpy() == x), np.flatnonzero(pdf["k"].to_numpy() == y)
        ids, groups = pdf["id"].to_numpy(), pdf["g"].to_numpy()
        other, out = m[right].T, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(left), BLOCK_ROWS):
            sims = np.round(m[left[at : at + BLOCK_ROWS]] @ other, digits)
            i, j = np.nonzero(sims >= threshold)
            a, b = left[at + i], right[j]
            keep = (ids[a] < ids[b]) if x == y else np.ones(len(a), bool)
            if group_col:
                keep &= groups[a] != groups[b]
            out.append((np.minimum(ids[a], ids[b])[keep], np.maximum(ids[a], ids[b])[keep], sims[i, j][keep]))
        lo, hi, sims = map(np.concatenate, zip(*out))
        return pd.DataFrame({"a": lo, "b": hi, "cosine_sim": sims})

    return sides.groupBy("x", "y").applyInPandas(product, "a long, b long, cosine_sim double")


def _summed(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links from i to j, parallel ones summed, by row: where each row starts, columns, weights."""
    key = i.astype(np.int64) * n + j
    at = np.argsort(key, kind="stable")
    key, w = key[at], w[at]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    w = np.add.reduceat(w, first) if len(first) else w
    key = key[first]
    return np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * n), (key % n).astype(np.int32), w


def _moved(start: np.ndarray, to: np.ndarray, w: np.ndarray, resolution: float, total: float) -> tuple[np.ndarray, bool]:
    """The community of each node, once no move to a neighbour's gains, and whether any node moved."""
    n = len(start) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
    degree = np.bincount(row, w, n) + np.bincount(row[row == to], w[row == to], n)
    keep = row != to
    start, to, w = np.concatenate([[0], np.cumsum(keep)])[start], to[keep], w[keep]
    com, tot, links = np.arange(n), degree.copy(), np.zeros(n)
    bounds, degrees = start.tolist(), degree.tolist()
    moved_any, moved = False, True
    while moved:
        moved = False
        for i in range(n):
            a, b, own, d = bounds[i], bounds[i + 1], int(com[i]), degrees[i]
            if a == b:
                continue
            tot[own] -= d
            c = com[to[a:b]]
            np.add.at(links, c, w[a:b])
            gain = links[c] - resolution * tot[c] * d / (2 * total)
            stay = float(links[own] - resolution * tot[own] * d / (2 * total))
            top = float(gain.max())
            best = own
            if top > stay - 1e-9:  # near ones are compared as rounded; of equal ones the own comes first, then the first
                near = {int(x): float(g) for x, g in zip(c[gain > top - 1e-9], gain[gain > top - 1e-9])} | {own: stay}
                best = max(sorted(near), key=lambda x: (round(near[x], 12), x == own))
            links[c] = 0.0
            com[i] = best
            tot[best] += d
            if best != own:
                moved = moved_any = True
    return com, moved_any


def louvain_first(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, passes: int = 10, total: float | None = None) -> np.ndarray:
    """Communities by greedy modularity (the published Louvain method), nodes visited in order, so the result is deterministic: for each
    of the sorted nodes the index of the one that its community started from. total: the weight of the whole graph where this is a
    part of it; parts that no edge joins don't touch one another otherwise."""
    n = len(nodes)
    i, j = np.searchsorted(nodes, a).astype(np.int32), np.searchsorted(nodes, b).astype(np.int32)
    w = np.asarray(w, np.float64)
    if total is None:
        total = float(w.sum() - w[i == j].sum() / 2)
    other = i != j
    start, to, w = _summed(np.concatenate([i, j[other]]), np.concatenate([j, i[other]]), np.concatenate([w, w[other]]), n)
    at, first = np.arange(n), np.arange(n)  # each node's community, and the node that a community started from
    for _ in range(passes):
        com, moved = _moved(start, to, w, resolution, total or 1.0)
        if not moved:
            break
        names, com = np.unique(com, return_inverse=True)
        row = np.repeat(np.arange(len(start) - 1, dtype=np.int32), np.diff(start))
        x, y = com[row], com[to]
        start, to, w = _summed(x, y, np.where((x != y) | (row == to), w, w / 2), len(names))
        at, first = com[at], first[names]
    return first[at]


def louvain(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, passes: int = 10) -> np.ndarray:
    """Communities of the sorted nodes, numbered from 0."""
    return np.unique(louvain_first(nodes, a, b, w, resolution, passes), return_inverse=True)[1]


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b -> id, label, the same for all nodes that edges join. First each b is drawn into the least of its a, so that few edges
    are left; of these the smallest label of neighbours, then of the label, until nothing changes."""
    to = cut(edges.groupBy("b").agg(F.min("a").alias("m")))
    few = edges.join(to, "b").select("a", F.col("m").alias("b")).unionByName(to.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    both = cut(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        hop = labels.join(near, "id").select("id", "label", F.least("label", "_near").alias("_hop"))
        jump = labels.select(F.col("id").alias("_hop"), F.col("label").alias("_jump"))
        new = cut(hop.join(jump, "_hop").select("id", F.least("_hop", "_jump").alias("label"), (F.least("_hop", "_jump") != F.col("label")).alias("_moved")))
        labels = new.select("id", "label")
        if new.filter("_moved").isEmpty():
            return labels


#: Edges of a task's parts of a graph; a part that has more is a task of its own.
PART_EDGES = 300_000


def _in_order(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with n, their place from 0 in each key; no task gets all rows of a key."""
    dealt = cut(rows.repartitionByRange(*keys, by).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_p").count()  # a row a partition and key
    before = counts.withColumn("_before", F.sum("count").over(W.partitionBy(*keys).orderBy("_p")) - F.col("count")).drop("count")
    placed = dealt.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(by)))
    return placed.join(before, [*keys, "_p"]).select(*keys, by, (F.col("_before") + F.col("_n") - 1).alias("n"))


def communities(nodes: DataFrame, edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """nodes: collection, id; edges: collection, a, b, weight -> collection, level, community, id. Each connected part of a collection's graph
    is one task's work, as is each resolution, with the same communities as over all of it; nodes without edges are communities of
    their own; fewer than three nodes give none."""
    key = lambda end: F.xxhash64("collection", end)  # noqa: E731  where two keys meet, parts are one task's work together, no more
    nodes, edges = nodes.filter("id IS NOT NULL"), cut(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("collection", "a", "b", F.col("weight").cast("double").alias("weight")))
    ends = edges.groupBy("collection", F.col("a").alias("id")).agg(F.count("*").alias("_n"))
    every = cut(nodes.select("collection", "id").unionByName(edges.select("collection", F.col("b").alias("id")).distinct()).withColumn("_n", F.lit(0).cast("long")).unionByName(ends).groupBy("collection", "id").agg(F.sum("_n").alias("_n")))
    labels = connected(edges.select(key("a").alias("a"), key("b").alias("b")))
    known = every.withColumn("_key", key("id")).join(labels.withColumnRenamed("id", "_key"), "_key", "left")
    sizes = cut(known.filter("label IS NOT NULL").groupBy("label").agg(F.sum("_n").alias("_size")))
    buckets = max(1, -(-(sizes.filter(F.col("_size") < PART_EDGES).agg(F.sum("_size")).first()[0] or 0) // PART_EDGES))
    part = sizes.select("label", F.when(F.col("_size") < PART_EDGES, F.pmod("label", F.lit(buckets))).otherwise(F.col("label")).alias("part"))
    of = known.filter("_n > 0").join(part, "label").select("collection", F.col("id").alias("a"), "part")
    total = F.sum(F.when(F.col("a") == F.col("b"), F.col("weight") / 2).otherwise(F.col("weight")))
    whole = every.groupBy("collection").agg(F.count("*").alias("_nodes")).filter("_nodes >= 3").select("collection").join(edges.groupBy("collection").agg(total.alias("total")), "collection", "left")
    whole = small(cut(whole))
    rows = edges.join(of, ["collection", "a"]).join(whole, "collection")
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(resolutions) - 1))).alias("level")
    shape = pa.schema([("collection", pa.string()), ("level", pa.int32()), ("first", pa.int64()), ("id", pa.int64())])

    def detect(key: tuple, table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
        ids, level = np.unique(np.concatenate([np.unique(a), np.unique(b)])), key[1].as_py()
        first = ids[louvain_first(ids, a, b, w, resolutions[level], total=table.column("total")[0].as_py())]
        n = len(ids)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), pa.array(np.full(n, level, np.int32)), pa.array(first), pa.array(ids)], schema=shape)

    found = rows.select("collection", levels, "part", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight", "total")
    found = found.groupBy("collection", "level", "part").applyInArrow(detect, "collection string, level int, first long, id long")
    alone = known.filter("label IS NULL").join(whole, "collection").select("collection", levels, F.col("id").cast("long").alias("first"), F.col("id").cast("long").alias("id"))
    found = cut(found.unionByName(alone))
    named = _in_order(found.select("collection", "level", "first").distinct(), ["collection", "level"], "first")
    return found.join(named, ["collection", "level", "first"]).select("collection", "level", F.col("n").alias("community"), "id")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """edges: a, b, weight, each pair once; labels: id, community -> modularity, one row."""
    e = edges.join(labels.select(F.col("id").alias("a"), F.col("community").alias("_ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("_cb")), "b")
    inside = e.agg(F.sum(F.when(F.col("_ca") == F.col("_cb"), F.col("weight")).otherwise(0.0)).alias("_in"), F.sum("weight").alias("_m"))
    ends = e.select(F.col("_ca").alias("c"), "weight").unionByName(e.select(F.col("_cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return ends.agg(F.sum(F.col("d") * F.col("d")).alias("_dd")).crossJoin(inside).select((F.col("_in") / F.col("_m") - resolution * F.col("_dd") / (4 * F.col("_m") * F.col("_m"))).alias("modularity"))


def extracted(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: chunk_id, answer (JSON) -> entities (chunk_id, pos, name, entity_type, description) and relations (chunk_id, pos,
    source, target, rel_type, context); items without their names are dropped."""
    from tessera.functions.text import json_answer, strip

    shape = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,type:string,context:string>>>"
    parsed = answers.select("chunk_id", F.from_json(json_answer(F.col("answer")), shape).alias("j"))
    e = parsed.select("chunk_id", F.posexplode("j.entities").alias("pos", "x")).filter(strip(F.coalesce("x.name", F.lit(""))) != "")
    e = e.select("chunk_id", "pos", strip(F.col("x.name")).alias("name"), F.coalesce("x.type", F.lit("concept")).alias("entity_type"), F.coalesce("x.description", F.lit("")).alias("description"))
    r = parsed.select("chunk_id", F.posexplode("j.relationships").alias("pos", "x")).filter((strip(F.coalesce("x.source", F.lit(""))) != "") & (strip(F.coalesce("x.target", F.lit(""))) != ""))
    return e, r.select("chunk_id", "pos", strip(F.col("x.source")).alias("source"), strip(F.col("x.target")).alias("target"), F.coalesce("x.type", F.lit("RELATED_TO")).alias("rel_type"), F.coalesce("x.context", F.lit("")).alias("context"))


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations: collection, source, target, ... -> source_id and target_id by name; ends without an entity drop the relation."""
    by = entities.select("collection", "name", "id")
    s = by.select("collection", F.col("name").alias("source"), F.col("id").alias("source_id"))
    t = by.select("collection", F.col("name").alias("target"), F.col("id").alias("target_id"))
    return relations.join(s, ["collection", "source"]).join(t, ["collection", "target"])
