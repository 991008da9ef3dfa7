"""Queries on strategies, provenance, look-ups, reports and model steps (offline)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, feedback, model_steps, provenance, retrieval, service, sinks, state
from tessera.plans import strategies as P
from tessera.plans.registry import Tables, query
from tessera.plans.search_queries import _COS, _ROUTED, _questions, _vector_queries
from tessera.providers import Provider

_HUNDREDS = "(SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)"
_LABELS = "(SELECT label::BIGINT AS id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


def _ranked_sql(corpus: str, queries: str = _HUNDREDS) -> str:
    """query_id, id, rank of corpus (id, v) by cosine."""
    return f"SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COS.format(a='q.v', b='c.v')} DESC, c.id)::INT AS rank FROM {queries} q, {corpus} c"


_CHUNKS = "(SELECT vec_id AS id, embedding AS v FROM embeddings)"


def _chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.lit("").alias("content"), "embedding")


def _centres(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    return rows.select(F.col("label").cast("long").alias("id"), F.transform("r", lambda r: r["x"]).alias("embedding"))


def _communities(t: Tables) -> DataFrame:
    return _centres(t).select("id", F.lit("summary").alias("summary"), F.col("embedding").alias("summary_embedding"))


def _asked(t: Tables) -> DataFrame:
    """All ids divisible by 100; no words, so that vectors alone count."""
    return _vector_queries(t, None).withColumn("query_text", F.lit(""))


@query(f"""WITH c AS ({_ranked_sql(_LABELS)}), k AS ({_ranked_sql(_CHUNKS)})
SELECT query_id, 'community' AS source, id, rank FROM c WHERE rank <= 3 UNION ALL SELECT query_id, 'chunk', id, (rank + least(3, (SELECT count(*) FROM {_LABELS})))::INT FROM k WHERE rank <= 6 - least(3, (SELECT count(*) FROM {_LABELS}))""")
def kg_global_search(t: Tables) -> DataFrame:
    return P.kg_global(_communities(t), P.hybrid(_chunks(t), 6, tier=2), 6)(_asked(t))


@query(f"WITH r AS ({_ranked_sql(_LABELS)}) SELECT query_id, 'summary' AS source, id, rank FROM r WHERE rank <= 4")
def tree_search(t: Tables) -> DataFrame:
    return P.tree(_centres(t), 4)(_asked(t))


@query(f"""WITH c AS ({_ranked_sql(_LABELS)}), k AS ({_ranked_sql(_CHUNKS)})
SELECT query_id, 'summary' AS source, id, rank FROM c WHERE rank <= 4 AND query_id % 300 = 0 UNION ALL SELECT query_id, 'chunk', id, rank FROM k WHERE rank <= 5 AND query_id % 300 <> 0""")
def dispatch_search(t: Tables) -> DataFrame:
    """A third of the queries to summaries, a third to hybrid search, and a third with a name that isn't a strategy, so to hybrid search."""
    way = F.when(F.col("query_id") % 300 == 0, "tree").when(F.col("query_id") % 300 == 100, "hybrid").otherwise("unheard of")
    ways = {"hybrid": P.hybrid(_chunks(t), 5, tier=2), "tree": P.tree(_centres(t), 4)}
    asked = _asked(t).withColumn("strategy", way)
    return P.dispatch(asked, P.present(asked, ways))


_PARTS = "(SELECT q.vec_id * 2 + p AS query_id, e.embedding AS v FROM embeddings q, range(2) r(p) JOIN embeddings e ON e.vec_id = q.vec_id + p WHERE q.vec_id % 100 = 0)"


@query(f"""WITH k AS ({_ranked_sql(_CHUNKS, _PARTS)}), f AS (SELECT query_id // 2 AS query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS s FROM k WHERE rank <= 8 GROUP BY 1, 2)
SELECT query_id, source, id, rank FROM (SELECT query_id, 'chunk' AS source, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM f) WHERE rank <= 8""")
def compound_search(t: Tables) -> DataFrame:
    """Two parts a query: its own vector and that of the next id; each goes its own way, and the lists are fused."""
    v = t.embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("_e"))

    def parts(q: DataFrame) -> DataFrame:
        two = q.select("query_id", "query_text", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("query", F.lit(""))
        return two.join(v, F.col("query_id") + F.col("pos") == F.col("_v")).select("query_id", "query_text", "pos", "query", F.col("_e").alias("query_vec"))

    return P.compound(parts, {"hybrid": P.hybrid(_chunks(t), 8, tier=2)}, 8)(_asked(t))


@query(f"""WITH RECURSIVE e AS (SELECT s_suppkey::BIGINT AS s, 10000000 + s_nationkey::BIGINT AS d FROM supplier), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e), o AS (SELECT s, count(*) AS n FROM b GROUP BY s),
st AS (SELECT b.s, b.d, 1.0::DOUBLE / o.n AS w FROM b JOIN o USING (s)),
near AS ({_ranked_sql("(SELECT vec_id AS id, embedding AS v FROM embeddings JOIN supplier ON s_suppkey = vec_id)")}),
p0 AS (SELECT query_id AS q, id::BIGINT AS id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p FROM near WHERE rank <= 8),
r AS (SELECT 0 AS i, q, id, p FROM p0 UNION ALL
  SELECT i, q, id, sum(p) FROM (SELECT r.i + 1 AS i, r.q, st.d AS id, 0.85::DOUBLE * r.p * st.w AS p FROM r JOIN st ON r.id = st.s WHERE r.i < 4 UNION ALL SELECT x.i + 1, p0.q, p0.id, 0.15::DOUBLE * p0.p FROM p0 JOIN (SELECT DISTINCT i, q FROM r) x ON x.q = p0.q WHERE x.i < 4) GROUP BY i, q, id),
top AS (SELECT q, id FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(p * (1 + CASE WHEN id < 10000000 THEN 1.0 ELSE 0.0 END), 8) DESC, id) AS n FROM r WHERE i = 4) WHERE n <= 10),
hit AS (SELECT DISTINCT q, doc_id FROM top JOIN documents ON doc_id % (SELECT count(*) FROM supplier) = id),
first AS (SELECT q, doc_id FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS n FROM hit) WHERE n <= 15)
SELECT query_id, source, id, rank FROM (SELECT q AS query_id, 'chunk' AS source, doc_id AS id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.5 END DESC, doc_id)::INT AS rank FROM first) WHERE rank <= 5""")
def kg_local_search(t: Tables) -> DataFrame:
    """Suppliers as entities with the vectors of their ids, nations as hubs, documents as chunks that mention a supplier each."""
    n = t.supplier.count()
    suppliers = t.supplier.select(F.col("s_suppkey").cast("long").alias("id"))
    entities = suppliers.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left").withColumn("specificity", F.lit(1.0))
    edges = t.supplier.select(F.col("s_suppkey").cast("long").alias("source_id"), (F.lit(10_000_000) + F.col("s_nationkey")).cast("long").alias("target_id"), F.lit(1.0).alias("weight"))
    mentions = t.documents.select(F.col("doc_id").alias("chunk_id"), F.pmod("doc_id", F.lit(n)).alias("entity_id"))
    utility = t.documents.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit(0.9).alias("utility_ema"))
    return P.kg_local(entities, edges, mentions, utility, 5, P.hybrid(_chunks(t), 5, tier=2), entities_kept=10, iterations=4, tolerance=None)(_asked(t))


# --- provenance

def _finalized(t: Tables) -> DataFrame:
    started = provenance.started(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).cast("long").alias("query_log_id"), F.col("o_orderstatus").alias("answer_text")))
    return provenance.finalized(started, t.orders.select(F.col("o_orderkey").alias("chain_id"), F.round(F.col("o_totalprice") / 300000, 3).alias("confidence")))


@query("SELECT o_orderkey AS id, coalesce(nullif(o_custkey % 3, 0), -1)::BIGINT AS query_log_id, o_orderstatus AS answer_text, round(round(least(1, greatest(0, o_totalprice / 300000)), 3), 6) AS overall_confidence FROM orders")
def provenance_lifecycle(t: Tables) -> DataFrame:
    return _finalized(t).withColumn("query_log_id", F.coalesce("query_log_id", F.lit(-1)))


@query("""WITH s AS (SELECT l_orderkey AS chain_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS rank_position, CASE WHEN l_linenumber % 4 > 0 THEN l_partkey END AS chunk_id, l_suppkey AS entity_id, round(l_discount, 4) AS kw, round(l_tax, 4) AS rr FROM lineitem),
x AS (SELECT chain_id, coalesce(rank_position, 2147483647) AS r, n, 'Result ' || coalesce(rank_position::VARCHAR, '?') || ' (' || CASE WHEN chunk_id IS NOT NULL THEN 'chunk #' || chunk_id ELSE 'entity #' || entity_id END || '): score=' || printf('%.4f', kw + 0.0 + rr)
  || ' [keyword:' || printf('%.4f', kw) || ' + vector:0.0000 + kg:0.0000 + utility:0.0000 + rerank:' || printf('%.4f', rr) || ']' || CASE WHEN trim(coalesce(source, '')) <> '' THEN chr(10) || 'Content: ' || source ELSE '' END AS line FROM s LEFT JOIN documents ON doc_id = chunk_id),
b AS (SELECT chain_id, string_agg(line, chr(10) || chr(10) ORDER BY r, n) AS body FROM x GROUP BY chain_id)
SELECT o_orderkey AS chain_id, 'Provenance chain #' || o_orderkey || ' — confidence: ' || printf('%.4f', round(least(1, greatest(0, o_totalprice / 300000)), 3)) || chr(10) || 'Answer: ' || o_orderstatus || coalesce(chr(10) || chr(10) || body, chr(10) || '(no steps recorded)') AS report FROM orders LEFT JOIN b ON chain_id = o_orderkey""")
def provenance_report(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    added = t.lineitem.select(
        F.col("l_orderkey").alias("chain_id"), F.when(line % 4 > 0, F.col("l_partkey")).alias("chunk_id"), F.col("l_suppkey").alias("entity_id"), F.when(line % 3 > 0, line).cast("int").alias("rank_position"), F.round("l_discount", 4).cast("double").alias("keyword_rrf"), F.round("l_tax", 4).cast("double").alias("rerank_score"), line
    ).orderBy("chain_id", "l_linenumber")
    none = t.spark.createDataFrame([], "id long, chain_id long, chunk_id long, entity_id long, score_components string, rank_position int")
    steps = provenance.with_steps(none, added.drop("l_linenumber"))
    return provenance.rendered(_finalized(t), steps, t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("content")))


# --- look-ups and reports


@query("""SELECT c AS collection, coalesce(d, 0) AS chunks, coalesce(d, 0) AS documents, coalesce(v, 0) AS embedded_chunks, coalesce(e, 0) AS entities, coalesce(r, 0) AS relationships, coalesce(m, 0) AS communities, coalesce(p, 0) AS parent_chunks, -1::BIGINT AS eval_questions
FROM (SELECT DISTINCT lang AS c FROM documents UNION SELECT 'en') LEFT JOIN (SELECT lang AS c, count(*) AS d, count(vec_id) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1) USING (c)
LEFT JOIN (SELECT 'en' AS c, count(*) AS e FROM supplier) USING (c) LEFT JOIN (SELECT 'en' AS c, count(*) AS r FROM lineitem) USING (c) LEFT JOIN (SELECT 'en' AS c, count(*) AS m FROM nation) USING (c) LEFT JOIN (SELECT lang AS c, count(DISTINCT source) AS p FROM documents GROUP BY 1) USING (c)""")
def service_stats(t: Tables) -> DataFrame:
    english = lambda df: df.select(F.lit("en").alias("collection"))
    docs = t.documents.select(F.col("lang").alias("collection"), F.col("doc_id").alias("id"), "source")
    chunks = docs.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    return service.stats({"chunks": chunks, "documents": docs, "entities": english(t.supplier), "relationships": english(t.lineitem), "communities": english(t.nation), "parent_chunks": docs.select("collection", "source").distinct()})


@query("SELECT o_orderkey AS chunk_id, c_name AS context_text FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_orderkey")
def context_lookup(t: Tables) -> DataFrame:
    return service.context_of(t.orders.select(F.col("o_orderkey").alias("chunk_id")), t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("context_text")))


@query("SELECT c_mktsegment AS collection, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 END AS entity_id FROM customer")
def entity_lookup(t: Tables) -> DataFrame:
    of = t.customer.select(F.col("c_mktsegment").alias("collection"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return service.entity_ids(of.select("collection", "name"), of.filter("id % 3 = 0")).withColumn("entity_id", F.coalesce("entity_id", F.lit(-1)))


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS entity_type, '' AS description, coalesce(n, 0) AS relations FROM supplier LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY k) ON k = s_suppkey")
def entity_details(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.lit("").alias("description"))
    return service.entity_details(s.select("id"), s, t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")))


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def entity_names(t: Tables) -> DataFrame:
    return evaluation.entity_names(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("specificity")))


@query("SELECT lang AS collection, (count(*) + count(*) FILTER (WHERE doc_id % 50 = 0))::BIGINT AS files, count(*) FILTER (WHERE doc_id % 7 <> 0) AS ingested, count(*) FILTER (WHERE doc_id % 7 = 0) AS skipped, count(*) FILTER (WHERE doc_id % 50 = 0) AS errors, sum(n)::BIGINT AS chunks, coalesce(sum(k), 0)::BIGINT AS tokens FROM documents LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS k FROM lineitem GROUP BY 1) ON l_orderkey = doc_id GROUP BY 1")
def ingest_report(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("lang").alias("collection"), F.col("doc_id").alias("id"), (F.col("doc_id") % 7 == 0).alias("skipped"))
    chunks = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_quantity").cast("long").alias("token_count"))
    return service.ingest_summary(docs, chunks, docs.filter("id % 50 = 0"))


@query("SELECT lang AS collection, count(*) AS total, count(*) FILTER (WHERE n_chars < 500) AS blind_spots, round(count(*) FILTER (WHERE n_chars < 500) / count(*), 4) AS blind_spot_rate, count(*) FILTER (WHERE n_chars < 200) AS healed FROM documents GROUP BY 1")
def cycle_report(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("lang").alias("collection"), F.col("doc_id").alias("test_id"), F.col("doc_id").alias("target_id"), (F.col("n_chars") >= 500).cast("int").alias("found"), "n_chars")
    return evaluation.cycle_report(d, d.filter("n_chars < 200").select("collection", F.col("test_id").alias("chunk_id")))


@query(f"""WITH r AS (SELECT q.query_id, c.id, {_COS.format(a="q.v", b="c.v")} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {_COS.format(a="q.v", b="c.v")} DESC, c.id) AS rank FROM {_HUNDREDS} q, {_CHUNKS} c)
SELECT query_id AS test_id, coalesce(max((id = query_id + 1 AND score >= 0.2)::INT), 0) AS found, max(score) AS best_score FROM r WHERE rank <= 5 GROUP BY 1""")
def blind_spots_by_vector(t: Tables) -> DataFrame:
    """Each id divisible by 100 asks for the next one."""
    q = _asked(t)
    found = retrieval.vector_search(q, _chunks(t), 5).withColumnRenamed("query_id", "test_id")
    return evaluation.blind_spots(q.select(F.col("query_id").alias("test_id"), (F.col("query_id") + 1).alias("target_id")), found, 0.2)


@query("SELECT count(*) AS files, count(DISTINCT sha256(text)) AS contents FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def new_files(t: Tables) -> DataFrame:
    files = t.documents.select(F.lit("c").alias("collection"), F.col("text").alias("content"), "doc_id")
    known = state.new_files(files.filter("doc_id % 2 = 0"), files.select("collection", F.lit("").alias("file_hash"))).select("collection", "file_hash")
    return state.new_files(files, known).agg(F.count("*").alias("files"), F.countDistinct("file_hash").alias("contents"))


@query("SELECT source_id, target_id, count(*) AS edges, sum(weight)::BIGINT AS weight FROM (SELECT l_suppkey AS source_id, l_partkey AS target_id, l_quantity AS weight FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, 1 FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2")
def edge_insert(t: Tables) -> DataFrame:
    """Parallel edges stay apart when they are added, and count together."""
    old = t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").cast("double").alias("weight"))
    new = t.lineitem.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit(1.0).alias("weight"))
    return sinks.inserted_edges(old, new).groupBy("source_id", "target_id").agg(F.count("*").alias("edges"), F.sum("weight").cast("long").alias("weight"))


@query("""WITH top AS (SELECT c, p FROM (SELECT l_returnflag AS c, l_partkey AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS n FROM lineitem GROUP BY 1, 2) WHERE n <= 40),
e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS a, l_partkey % 97 + 1 AS b FROM lineitem)
SELECT c AS community, id, a AS source_id, b AS target_id FROM (SELECT x.c, e.id, e.a, e.b, row_number() OVER (PARTITION BY x.c ORDER BY e.id) AS n FROM e JOIN top x ON x.p = e.a JOIN top y ON y.p = e.b AND y.c = x.c) WHERE n <= 15""")
def community_relations(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_returnflag").alias("community"), F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    members = retrieval.top_k(n, [F.desc("n"), F.asc("id")], 40, keys=["community"]).select("community", "id")
    e = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source_id"), (F.col("l_partkey") % 97 + 1).alias("target_id"))
    return model_steps.sample_relations(members, e).select("community", "id", "source_id", "target_id")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ': ' || p_type END AS text FROM part")
def entity_texts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), T.entity_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))).alias("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN p_size ELSE 1 END::INT AS level FROM part")
def style_levels(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 4
    style = F.when(kind == 0, "Title").when(kind == 1, "Subtitle").when(kind == 2, F.concat(F.lit("Heading "), F.col("p_size").cast("string"))).otherwise("Body")
    return t.part.select(F.col("p_partkey").alias("id"), T.heading_level(style, {"Title": 1, "Subtitle": 2}).alias("level"))


@query("SELECT p_partkey AS id, base64(encode(p_name)) AS encoded FROM part")
def base64_texts(t: Tables) -> DataFrame:
    from tessera.sources.files import base64_of

    return t.part.select(F.col("p_partkey").alias("id"), base64_of(F.encode("p_name", "UTF-8")).alias("encoded"))


# --- model steps without a model


@query(f"WITH r AS ({_ROUTED}) SELECT id::BIGINT AS query_id, query_type, CASE query_type WHEN 'specific_factoid' THEN 'hybrid' WHEN 'global_thematic' THEN 'kg_global' ELSE query_type END AS strategy, confidence FROM r")
def model_router(t: Tables) -> DataFrame:
    return model_steps.routed_by_model(_questions(t).select(F.col("id").alias("query_id"), F.col("q").alias("query_text")), Provider())


@query("SELECT item_id AS query_id, 0 AS pos, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS query, 'specific_factoid' AS query_type, TRUE AS independent FROM benchmark")
def model_decomposer(t: Tables) -> DataFrame:
    return model_steps.decomposed(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), Provider()).withColumn("independent", F.col("depends_on").isNull()).drop("depends_on")


@query(f"WITH k AS ({_ranked_sql(_CHUNKS)}) SELECT query_id, id, rank FROM k WHERE rank <= 5")
def model_hypotheses(t: Tables) -> DataFrame:
    """No model writes a passage, so the query's vector counts alone."""
    return retrieval.hyde_search(model_steps.hypotheses(_asked(t), Provider()), _chunks(t), 5).select("query_id", "id", "rank")


@query("SELECT o_custkey AS query_id, 0.5::DOUBLE AS quality, 'ambiguous' AS level, 'supplement' AS action FROM orders GROUP BY 1")
def model_grades(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.lit("q").alias("query_text"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"))
    return model_steps.graded_by_model(rows, Provider())


@query("SELECT query_id, id, rank FROM (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def passage_reranker(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.lit("q").alias("query_text"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"), "o_totalprice")
    ranked = retrieval.top_k(rows, [F.desc("o_totalprice"), F.asc("id")], 10, keys=["query_id"])
    return model_steps.passages_ranked(ranked, Provider(), 3)


@query("SELECT vec_id AS query_id, 1.0::DOUBLE AS faithfulness, 1.0::DOUBLE AS answer_relevancy, 1.0::DOUBLE AS context_precision, 1.0::DOUBLE AS context_recall FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0 AND regexp_matches(source, '[\\p{L}0-9]')")
def eval_run(t: Tables) -> DataFrame:
    """Each id divisible by 100 asks with the source of its own document and is answered from the nearest one, which is itself."""
    text = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("content"))
    q = _vector_queries(t, None).join(text.select(F.col("id").alias("query_id"), F.col("content").alias("query_text")), "query_id").withColumn("ground_truth", F.col("query_text"))
    q = q.filter(F.col("query_text").rlike(r"[\p{L}0-9]"))
    search = lambda x: retrieval.vector_search(x, _chunks(t), 1)
    return evaluation.dataset_run(q, search, text, Provider(), "run")[0]


@query()
def eval_run_means(t: Tables) -> DataFrame:
    text = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("content"))
    q = _vector_queries(t, None).join(text.select(F.col("id").alias("query_id"), F.col("content").alias("query_text")), "query_id").withColumn("ground_truth", F.col("query_text"))
    return evaluation.dataset_run(q, lambda x: retrieval.vector_search(x, _chunks(t), 5), text, Provider(), "run")[1]


@query()
def full_cycle(t: Tables) -> DataFrame:
    """Hard queries on a sample of documents, a keyword search for them, and healing of what it misses."""
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.col("text").alias("content"), F.lit("").alias("context_prefix"), F.lit(None).cast("array<float>").alias("embedding"))
    return model_steps.full_cycle(chunks, 20, lambda q: retrieval.keyword_search(q, chunks, 5), Provider(), 0.0)[1]


@query()
def corrective_scores(t: Tables) -> DataFrame:
    """The offline scorer beside the model's default, on what a hybrid search finds."""
    rows = retrieval.vector_search(_asked(t), _chunks(t), 3).join(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").withColumn("query_text", F.lit("the of"))
    return feedback.graded(rows).unionByName(model_steps.graded_by_model(rows, Provider()))
