"""Queries on graphs, summary trees and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import graph, summary_tree
from tessera.operators.retrieval import top_k
from tessera.operators.storage import shared_dir
from tessera.plans.registry import Tables, query
from tessera.plans.search_queries import literal_rows
from tessera.streaming import utility as stream

_E = "(SELECT l_suppkey AS source_id, l_partkey AS target_id, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS weight FROM lineitem)"


def _edges(t: Tables) -> DataFrame:
    w = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity"))
    return t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), w.alias("weight"))


@query(f"SELECT source_id, target_id, sum(CASE WHEN weight = 0 THEN 1.0::DOUBLE ELSE weight END) AS weight FROM {_E} GROUP BY 1, 2")
def edge_accumulate(t: Tables) -> DataFrame:
    return graph.accumulate(_edges(t))


@query("""SELECT a, b, arg_min(w, id) AS weight FROM (SELECT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b, l_orderkey * 10 + l_linenumber AS id, l_quantity AS w FROM lineitem) WHERE a <> b GROUP BY a, b""")
def edge_dedup_undirected(t: Tables) -> DataFrame:
    e = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 100 + 1).alias("target_id"), F.col("l_quantity").alias("weight"))
    return graph.undirected(e)


@query("""WITH e AS (SELECT l_suppkey AS s, l_partkey % 200 + 1 AS d FROM lineitem WHERE l_linenumber = 1)
SELECT p_partkey AS id, coalesce(n, 0) AS degree, round(1.0::DOUBLE / greatest(1, coalesce(n, 0)), 8) AS specificity FROM part LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT s AS id FROM e UNION ALL SELECT d FROM e WHERE s <> d) GROUP BY id) x ON p_partkey = id""")
def specificity(t: Tables) -> DataFrame:
    e = t.lineitem.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 200 + 1).alias("target_id"))
    return graph.degrees(t.part.select(F.col("p_partkey").alias("id")), e).select("id", "degree", F.round("specificity", 8).alias("specificity"))


@query("""WITH e AS (SELECT l_suppkey AS s, -1 - l_partkey AS d FROM lineitem), x AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM e UNION ALL SELECT d FROM e) GROUP BY id)
SELECT v.id, coalesce(n, 0) AS degree, round(1.0::DOUBLE / greatest(1, coalesce(n, 0)), 8) AS specificity FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT -1 - p_partkey FROM part) v LEFT JOIN x USING (id)""")
def specificity_all(t: Tables) -> DataFrame:
    """Of all suppliers and parts (ids below zero), over all edges."""
    e = t.lineitem.select(F.col("l_suppkey").alias("source_id"), (-1 - F.col("l_partkey")).alias("target_id"))
    nodes = t.supplier.select(F.col("s_suppkey").alias("id")).unionByName(t.part.select((-1 - F.col("p_partkey")).alias("id")))
    return graph.degrees(nodes, e).select("id", "degree", F.round("specificity", 8).alias("specificity"))


_NODES = "SELECT s_suppkey AS s, 10000000 + s_nationkey AS d FROM supplier UNION ALL SELECT 10000000 + n_nationkey, 20000000 + n_regionkey FROM nation"


def _tree_edges(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").cast("long").alias("source_id"), (F.lit(10_000_000) + F.col("s_nationkey")).cast("long").alias("target_id"))
    b = t.nation.select((F.lit(10_000_000) + F.col("n_nationkey")).cast("long").alias("source_id"), (F.lit(20_000_000) + F.col("n_regionkey")).cast("long").alias("target_id"))
    return a.unionByName(b).withColumn("weight", F.lit(1.0))


@query(f"""WITH RECURSIVE e AS ({_NODES}), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e), o AS (SELECT s, count(*) AS n FROM b GROUP BY s),
st AS (SELECT b.s, b.d, 1.0::DOUBLE / o.n AS w FROM b JOIN o USING (s)), seeds(q, id) AS (VALUES (1, 1), (1, 2), (2, 3)), p0 AS (SELECT q, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY q) AS p FROM seeds),
r AS (SELECT 0 AS i, q, id::BIGINT AS id, p FROM p0 UNION ALL
  SELECT i, q, id, sum(p) FROM (SELECT r.i + 1 AS i, r.q, st.d AS id, 0.85::DOUBLE * r.p * st.w AS p FROM r JOIN st ON r.id = st.s WHERE r.i < 10 UNION ALL SELECT x.i + 1, p0.q, p0.id, 0.15::DOUBLE * p0.p FROM p0 JOIN (SELECT DISTINCT i, q FROM r) x ON x.q = p0.q WHERE x.i < 10) GROUP BY i, q, id)
SELECT q::BIGINT AS query_id, id, round(p, 6) AS p FROM r WHERE i = 10""")
def ppr_mass(t: Tables) -> DataFrame:
    seeds = literal_rows(t, [(1, 1), (1, 2), (2, 3)], "query_id long, id long")
    return graph.pagerank(_tree_edges(t), seeds, iterations=10, tolerance=None).select("query_id", "id", F.round("p", 6).alias("p"))


@query()
def ppr_topk(t: Tables) -> DataFrame:
    seeds = literal_rows(t, [(1, 1), (2, 3)], "query_id long, id long")
    e = _tree_edges(t)
    nodes = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct()
    return graph.ppr(e, seeds, graph.degrees(nodes, e), 20)


@query("""WITH h0 AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey <= 3), e AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
h1 AS (SELECT DISTINCT b AS id FROM w JOIN h0 ON a = id WHERE b NOT IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT b AS id FROM w JOIN h1 ON a = id WHERE b NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1))
SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def subgraph_2hop(t: Tables) -> DataFrame:
    e = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("source_id"), (F.lit(1_000_000) + F.col("l_partkey")).alias("target_id"))
    return graph.neighbourhood(e, t.supplier.filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("id")), 2)[0].select("id", "hop")


@query("""WITH h AS (SELECT DISTINCT l_suppkey % 5 AS query_id, l_orderkey AS chunk_id FROM lineitem WHERE l_suppkey <= 20), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM h) WHERE n <= 30),
u AS (SELECT user_id, round(avg(value) / 100, 6) AS e FROM events GROUP BY user_id)
SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(e, 0.5) DESC, chunk_id)::INT AS rank FROM f LEFT JOIN u ON user_id = chunk_id) WHERE rank <= 10""")
def entity_chunks(t: Tables) -> DataFrame:
    found = t.supplier.filter("s_suppkey <= 20").select((F.col("s_suppkey") % 5).alias("query_id"), F.col("s_suppkey").alias("id"))
    mentions = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("entity_id"))
    u = t.events.groupBy(F.col("user_id").alias("chunk_id")).agg(F.round(F.avg("value") / 100, 6).alias("utility_ema"))
    return graph.entity_chunks(found, mentions, u, 10).select("query_id", "chunk_id", "rank")


@query("SELECT p_partkey AS id, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part WHERE p_name ILIKE '%an%') WHERE rank <= 8")
def seed_entities_text(t: Tables) -> DataFrame:
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.col("p_retailprice").alias("specificity"))
    found = graph.seeds_by_text(e, "an", 8).withColumn("k", F.lit(0))
    return top_k(found, [F.desc("specificity"), F.asc("id")], 8, keys=["k"]).select("id", "rank")


_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_SIM} >= 0.3")
def synonymy_edges(t: Tables) -> DataFrame:
    return graph.similar_pairs(t.embeddings, 0.3, id_col="vec_id").select("a", "b")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND a.label <> b.label AND {_SIM} >= 0.3")
def collection_bridges(t: Tables) -> DataFrame:
    return graph.similar_pairs(t.embeddings, 0.3, id_col="vec_id", group_col="label").select("a", "b")


@query()
def community_detection(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.lit("g").alias("collection"), F.col("l_suppkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"), F.col("l_quantity").alias("weight")).groupBy("collection", "a", "b").agg(F.sum("weight").alias("weight"))
    nodes = e.select("collection", F.col("a").alias("id")).unionByName(e.select("collection", F.col("b").alias("id"))).distinct()
    return graph.communities(nodes, e)


@query("""WITH e AS (SELECT s_suppkey AS a, 10000000 + s_nationkey AS b FROM supplier UNION ALL SELECT 10000000 + n_nationkey, 20000000 + n_regionkey FROM nation),
c AS (SELECT 10000000 + n_nationkey AS id, n_regionkey AS c FROM nation UNION ALL SELECT 20000000 + r_regionkey, r_regionkey FROM region UNION ALL SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT ca.c AS p, cb.c AS q FROM e JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b), d AS (SELECT c, count(*) AS d FROM (SELECT p AS c FROM x UNION ALL SELECT q FROM x) GROUP BY c)
SELECT round((SELECT avg((p = q)::INT::DOUBLE) FROM x) - sum(d * d)::DOUBLE / (4.0::DOUBLE * pow((SELECT count(*) FROM x), 2)), 6) AS modularity FROM d""")
def community_modularity(t: Tables) -> DataFrame:
    e = _tree_edges(t).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight")
    n = t.nation.select((F.lit(10_000_000) + F.col("n_nationkey")).cast("long").alias("id"), F.col("n_regionkey").alias("community"), "n_nationkey")
    r = t.region.select((F.lit(20_000_000) + F.col("r_regionkey")).cast("long").alias("id"), F.col("r_regionkey").alias("community"))
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), "community")
    return graph.modularity(e, n.select("id", "community").unionByName(r).unionByName(s)).select(F.round("modularity", 6).alias("modularity"))


EXTRACTED = [
    (1, '{"entities": [{"name": " Pump ", "type": "part", "description": "d"}, {"name": "", "type": "x"}, {"name": "Valve"}], "relationships": [{"source": "Pump", "target": "Valve"}, {"source": "Pump", "target": " "}]}'),
    (2, "nothing"), (3, '```json\n{"entities": [{"name": "Line"}], "relationships": [{"source": "Line", "target": "Ghost", "type": "FEEDS"}]}\n```'),
]


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 'Pump', 'part'), (1, 2, 'Valve', 'concept'), (3, 0, 'Line', 'concept')) v(chunk_id, pos, name, entity_type)")
def extraction_entities(t: Tables) -> DataFrame:
    return graph.extracted(literal_rows(t, EXTRACTED, "chunk_id long, answer string"))[0].select("chunk_id", "pos", "name", "entity_type")


@query("SELECT 'c' AS collection, 'Pump' AS source, 'Valve' AS target, 'RELATED_TO' AS rel_type")
def extraction_relations(t: Tables) -> DataFrame:
    e, r = graph.extracted(literal_rows(t, EXTRACTED, "chunk_id long, answer string"))
    named = e.select(F.lit("c").alias("collection"), "name", F.xxhash64("name").alias("id"))
    return graph.resolve_relations(r.withColumn("collection", F.lit("c")), named).select("collection", "source", "target", "rel_type")


_P = "(SELECT vec_id AS id, list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE) AS w FROM embeddings)"


@query(f"SELECT (i - 1)::INT AS cluster, id, round(p, 6) AS p FROM (SELECT id, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) AS i FROM {_P}) WHERE p >= 0.1")
def soft_assign(t: Tables) -> DataFrame:
    w = F.transform(F.slice(V.as_double(F.col("embedding")), 1, 8), lambda x: x * x)
    p = t.embeddings.select(F.col("vec_id").alias("id"), w.alias("w")).select("id", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    return summary_tree.assign(p).select("cluster", "id", F.round("p", 6).alias("p"))


@query("SELECT label AS cluster, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS sources, count(*) AS n FROM embeddings GROUP BY label")
def tree_source_ids(t: Tables) -> DataFrame:
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("x").alias("text"), "embedding", F.array("vec_id").alias("source_ids"), F.col("label").alias("cluster"))
    s = summary_tree.summarise(items.select("cluster", "id"), items.drop("cluster"))
    return s.select("cluster", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("sources"), F.size("source_ids").cast("long").alias("n"))


@query()
def summary_tree_levels(t: Tables) -> DataFrame:
    leaves = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select(F.col("vec_id").alias("id"), "text", "embedding")
    return summary_tree.build_tree(leaves, 2).groupBy("level").agg(F.count("*").alias("summaries"))


def _replayed(t: Tables, table: str, plan, keys: list[str]) -> DataFrame:
    """The rows a stream over a table leaves in its table, once all is read."""
    spark, df = t.spark, getattr(t, table)
    updates = plan(spark.readStream.schema(df.schema).parquet(f"{t.folder}/{table}.parquet*"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.upserted(updates, keys, f"{at}/table", f"{at}/progress").awaitTermination()
    return stream.current(spark, f"{at}/table", updates.schema)


@query("SELECT user_id AS chunk_id, round(0.5::DOUBLE * pow(0.85::DOUBLE, count(*)) + sum(0.15::DOUBLE * pow(0.85::DOUBLE, later) * least(1, greatest(0, value / 100))), 6) AS utility_ema, count(*) AS use_count FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS later FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def utility_stream(t: Tables) -> DataFrame:
    uses = lambda e: e.filter("event_type = 'purchase'").select(F.col("user_id").alias("chunk_id"), "ts", F.col("event_id").alias("seq"), (F.col("value") / 100).alias("contribution"))
    return _replayed(t, "events", lambda e: stream.running_utility(uses(e)), ["chunk_id"]).select("chunk_id", F.round("utility_ema", 6).alias("utility_ema"), "use_count")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_stream(t: Tables) -> DataFrame:
    return _replayed(t, "events", lambda e: stream.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "40 days"), ["window", "event_type"]).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT count(DISTINCT text) AS files, sum(length(text)) FILTER (WHERE n = 1)::BIGINT AS chars FROM (SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)")
def watch_stream(t: Tables) -> DataFrame:
    fresh = lambda d: d.select(F.sha2("text", 256).alias("file_hash"), F.length("text").alias("chars")).dropDuplicates(["file_hash"])
    return _replayed(t, "documents", fresh, ["file_hash"]).agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))
