"""Queries on search: vectors, keywords, fusion, routing, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import retrieval as R
from tessera.plans.registry import Tables, query

#: Texts of keyword queries: frequent terms of the corpus.
KEYWORDS = [(1, "the of and"), (2, "de la que"), (3, "that with")]
QUESTIONS = [
    "what is screen 207", "how does the Job Control Number relate to the Work Unit Code", "overview of maintenance management", "", "what are the main themes?", "define uptime",
    "is it on? is it off?", "list the steps and how to undo them and also why", "tell me more", "difference between a pump and a valve", "what code means OAR-261", "who wrote version 2 in 1999",
]


def literal_rows(t: Tables, rows: list[tuple], ddl: str) -> DataFrame:
    return t.spark.createDataFrame(rows, ddl)


def sql_values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS {names}"


_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _vector_queries(t: Tables, n: int | None = 10) -> DataFrame:
    """Vectors of the first n ids, or (n is None) of all ids divisible by 100."""
    return t.embeddings.filter(F.col("vec_id") < n if n is not None else F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(f"""SELECT query_id, id, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="q.embedding", b="c.embedding")} DESC, c.vec_id)::INT AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id < 10) WHERE rank <= 5""")
def vector_topk(t: Tables) -> DataFrame:
    return R.vector_search(_vector_queries(t), t.embeddings, 5, id_col="vec_id").select("query_id", "id", "rank")


@query(f"""SELECT query_id, id, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="q.embedding", b="c.embedding")} DESC, c.vec_id)::INT AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id < 10 AND c.label = 3) WHERE rank <= 5""")
def vector_topk_filtered(t: Tables) -> DataFrame:
    return R.vector_search(_vector_queries(t), t.embeddings.filter("label = 3"), 5, id_col="vec_id").select("query_id", "id", "rank")


_HUNDREDS = f"""SELECT query_id, id, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="q.embedding", b="c.embedding")} DESC, c.vec_id)::INT AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {{which}}) WHERE rank <= 5"""


@query(_HUNDREDS.format(which="true"))
def vector_topk_hundreds(t: Tables) -> DataFrame:
    return R.vector_search(_vector_queries(t, None), t.embeddings, 5, id_col="vec_id").select("query_id", "id", "rank")


@query(_HUNDREDS.format(which="c.label = 3"))
def vector_topk_filtered_hundreds(t: Tables) -> DataFrame:
    return R.vector_search(_vector_queries(t, None), t.embeddings.filter("label = 3"), 5, id_col="vec_id").select("query_id", "id", "rank")


_Q = sql_values(KEYWORDS, "q(query_id, query_text)")
_BM25 = f"""q AS (SELECT * FROM {_Q}),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[\\p{{L}}0-9]+')) AS term FROM q),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}0-9]+') AS terms FROM documents),
st AS (SELECT count(*) AS nd, avg(len(terms)) AS av FROM d),
p AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, p.doc_id AS id, count(*) AS hits, round(sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / av))), 6) AS score
  FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY query_id, p.doc_id),
kw AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc JOIN qn USING (query_id) WHERE hits = n)"""


def _keyword_queries(t: Tables) -> DataFrame:
    return literal_rows(t, KEYWORDS, "query_id long, query_text string")


@query(f"WITH {_BM25} SELECT query_id::BIGINT AS query_id, id, rank FROM kw WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return R.keyword_search(_keyword_queries(t), t.documents, 10, id_col="doc_id", text_col="text").select("query_id", "id", "rank")


@query(f"WITH {_BM25} SELECT query_id::BIGINT AS query_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM kw GROUP BY query_id")
def keyword_and_match(t: Tables) -> DataFrame:
    found = R.keyword_search(_keyword_queries(t), t.documents, 1 << 30, id_col="doc_id", text_col="text")
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _hybrid(t: Tables, tier: int | None) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    vectors = t.embeddings.filter("vec_id <= 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    queries = _keyword_queries(t).join(vectors, "query_id")
    return R.hybrid_search(queries, chunks, 5, tier=tier).select("query_id", "id", "rank")


_VEC = f"""vk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS.format(a="q.embedding", b="c.embedding")} AS s FROM embeddings q, embeddings c WHERE q.vec_id IN (1, 2, 3) AND c.vec_id IN (SELECT doc_id FROM documents)))"""
_FUSED = """SELECT query_id::BIGINT AS query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank
  FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (k + rank)), 8) AS s FROM l GROUP BY query_id, id)) WHERE rank <= 5"""


@query(f"WITH {_BM25}, {_VEC}, l AS (SELECT query_id, id, rank, 40 AS k FROM kw WHERE rank <= 20 UNION ALL SELECT query_id, id, rank, 60 FROM vk WHERE rank <= 20) {_FUSED}")
def hybrid_rrf(t: Tables) -> DataFrame:
    return _hybrid(t, None)


@query(f"WITH {_BM25}, l AS (SELECT query_id, id, rank, 40 AS k FROM kw WHERE rank <= 20) {_FUSED}")
def hybrid_tier1(t: Tables) -> DataFrame:
    return _hybrid(t, 1)


@query(f"WITH {_VEC}, l AS (SELECT query_id, id, rank, 60 AS k FROM vk WHERE rank <= 20) {_FUSED}")
def hybrid_tier2(t: Tables) -> DataFrame:
    return _hybrid(t, 2)


_CUSTOMER_LISTS = """l AS (
  SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer
  UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey)::INT FROM orders GROUP BY o_custkey
  UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey)::INT FROM orders GROUP BY o_custkey)"""


@query(f"""WITH {_CUSTOMER_LISTS} SELECT 1::BIGINT AS query_id, id, rank, rrf_score FROM (
  SELECT id, rrf_score, row_number() OVER (ORDER BY rrf_score DESC, id)::INT AS rank FROM (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf_score FROM l WHERE rank <= 200 GROUP BY id)) WHERE rank <= 10""")
def rrf_merge_lists(t: Tables) -> DataFrame:
    one = lambda df, by: R.top_k(df.withColumn("query_id", F.lit(1).cast("long")), [F.desc(by), F.asc("id")], 200, keys=["query_id"])
    by_customer = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    lists = [one(t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal"), one(by_customer, "n"), one(by_customer, "total")]
    rows = [x.select("query_id", "id", "rank") for x in lists]
    return R.fuse(rows[0].unionByName(rows[1]).unionByName(rows[2]), 60, 10)


@query(f"""WITH h AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
q AS (SELECT vec_id AS query_id, embedding AS qv, v AS hv FROM embeddings e JOIN h USING (label) WHERE vec_id < 5),
a AS (SELECT query_id, vec_id AS id, {_COS.format(a="qv", b="embedding")} AS s FROM q, embeddings UNION ALL SELECT query_id + 1000000, vec_id, {_COS.format(a="hv", b="embedding")} FROM q, embeddings),
l AS (SELECT query_id % 1000000 AS query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM a),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS s FROM l WHERE rank <= 20 GROUP BY query_id, id)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM f) WHERE rank <= 5""")
def hyde_fusion(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r")).select("label", F.transform("r", lambda r: r["x"]).alias("hypothesis_vec"))
    q = t.embeddings.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), V.as_double(F.col("embedding")).alias("query_vec"), "label")
    return R.hyde_search(q.join(centre, "label"), t.embeddings, 5, id_col="vec_id").select("query_id", "id", "rank")




@query("""WITH subs AS (SELECT i AS query_id, unnest(string_split(x, '. ')) AS s, generate_subscripts(string_split(x, '. '), 1) AS pos FROM (VALUES (1, 'the of. and that'), (2, 'de la. que')) v(i, x)),
qt AS (SELECT DISTINCT query_id, pos, unnest(regexp_extract_all(lower(s), '[\\p{L}0-9]+')) AS term FROM subs),
qn AS (SELECT query_id, pos, count(*) AS n FROM qt GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}0-9]+') AS terms FROM documents), st AS (SELECT count(*) AS nd, avg(len(terms)) AS av FROM d),
p AS (SELECT term, doc_id, doc_len, count(*) AS tf FROM (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, pos, p.doc_id AS id, count(*) AS hits, round(sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / av))), 6) AS s
  FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL),
l AS (SELECT query_id, pos, id, row_number() OVER (PARTITION BY query_id, pos ORDER BY s DESC, id) AS rank FROM sc JOIN qn USING (query_id, pos) WHERE hits = n),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS s FROM l WHERE rank <= 20 GROUP BY query_id, id)
SELECT query_id::BIGINT AS query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM f) WHERE rank <= 10""")
def multi_query_merge(t: Tables) -> DataFrame:
    rows = literal_rows(t, [(1, "the of. and that"), (2, "de la. que")], "query_id long, query_text string")
    subs = rows.select("query_id", F.posexplode(F.split("query_text", r"\. ")).alias("pos", "query"))
    return R.multi_query(subs, lambda q: R.keyword_search(q, t.documents, 20, id_col="doc_id", text_col="text"), 10).select("query_id", "id", "rank")


ANSWERS = [
    (1, "plain", "no json here"), (2, "two parts", '```json\n{"sub_queries": [{"query": " first ", "query_type": "multi_hop", "depends_on": null}, {"query": "second", "query_type": "odd", "depends_on": 0}, {"query": " ", "query_type": "compound"}]}\n```'),
    (3, "same", '{"sub_queries": [{"query": "same", "query_type": "multi_hop"}]}'), (4, "late", '<think>hm</think>{"sub_queries": [{"query": "a", "depends_on": 3}, {"query": "b", "depends_on": 1}]}'),
]


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 'plain', 'specific_factoid', -1), (2, 0, 'first', 'multi_hop', -1), (2, 1, 'second', 'specific_factoid', 0), (3, 0, 'same', 'specific_factoid', -1), (4, 0, 'a', 'specific_factoid', -1), (4, 1, 'b', 'specific_factoid', -1)) v(query_id, pos, query, query_type, depends_on)")
def sub_query_parse(t: Tables) -> DataFrame:
    return R.sub_queries(literal_rows(t, ANSWERS, "query_id long, query_text string, answer string")).fillna(-1, ["depends_on"])


def _sql_any(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


_ROUTED = f"""SELECT id, CASE WHEN trim(q) = '' THEN 'specific_factoid' WHEN {_sql_any("l", S.MULTI_HOP)} THEN 'multi_hop' WHEN {_sql_any("l", S.THEMATIC)} THEN 'global_thematic'
   WHEN len(q) - len(replace(q, '?', '')) >= 2 OR l LIKE '%and also%' OR l LIKE '% and how %' THEN 'compound' ELSE 'specific_factoid' END AS query_type,
  CASE WHEN trim(q) = '' THEN 1.0::DOUBLE WHEN {_sql_any("l", S.MULTI_HOP)} OR {_sql_any("l", S.THEMATIC)} THEN 0.7::DOUBLE WHEN len(q) - len(replace(q, '?', '')) >= 2 OR l LIKE '%and also%' OR l LIKE '% and how %' THEN 0.72::DOUBLE
   WHEN {_sql_any("l", S.FACTOID)} THEN 0.68::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM (SELECT id, q, lower(trim(q)) AS l FROM (SELECT * FROM {sql_values([(i, q) for i, q in enumerate(QUESTIONS)], "v(id, q)")} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'))"""


def _questions(t: Tables) -> DataFrame:
    fixed = literal_rows(t, list(enumerate(QUESTIONS)), "id long, q string")
    return fixed.unionByName(t.conversations.filter("role = 'user'").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q")))


@query(f"WITH r AS ({_ROUTED}) SELECT id::BIGINT AS id, query_type, CASE query_type WHEN 'specific_factoid' THEN 'hybrid' WHEN 'global_thematic' THEN 'kg_global' ELSE query_type END AS strategy, confidence FROM r")
def route_queries(t: Tables) -> DataFrame:
    return _questions(t).select("id", *[c.alias(k) for k, c in S.query_class(F.col("q")).items()])


@query(f"WITH r AS ({_ROUTED}) SELECT CASE query_type WHEN 'specific_factoid' THEN 'hybrid' WHEN 'global_thematic' THEN 'kg_global' ELSE query_type END AS strategy, count(*) AS n FROM r GROUP BY 1")
def strategy_dispatch(t: Tables) -> DataFrame:
    return _questions(t).select(S.query_class(F.col("q"))["strategy"].alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


@query(f"""SELECT id::BIGINT AS id, regexp_matches(q, '{T.FACTUAL}') AS needs_facts FROM {sql_values([(i, q) for i, q in enumerate(QUESTIONS)], "v(id, q)")}""")
def self_rag_gate(t: Tables) -> DataFrame:
    return literal_rows(t, list(enumerate(QUESTIONS)), "id long, q string").select("id", T.needs_facts(F.col("q")).alias("needs_facts"))


@query("""SELECT query_id, id, rank FROM (SELECT q.item_id AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY q.item_id ORDER BY
  round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}0-9]+')), regexp_extract_all(lower(substring(d.text, 1, 1024)), '[\\p{L}0-9]+'))) / len(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}0-9]+')))::DOUBLE, 6) DESC, d.doc_id)::INT AS rank
  FROM benchmark q, documents d WHERE q.item_id < 5 AND d.doc_id % 10 = q.item_id % 10) WHERE rank <= 3""")
def rerank_overlap(t: Tables) -> DataFrame:
    q = t.benchmark.filter("item_id < 5").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 10).alias("k"))
    rows = q.withColumn("k", F.col("query_id") % 10).join(d, "k")
    return R.rerank(rows, 3).select("query_id", "id", F.col("rerank_rank").alias("rank"))


def benchmark_queries(t: Tables) -> DataFrame:
    """All benchmark items with their whole texts; query_vec is null where there is no vector of that id."""
    v = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(v, "query_id", "left")


def text_chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def retrieved(t: Tables, k: int = 20) -> DataFrame:
    """query_id, query_text, id, content, rank: the k first rows of a hybrid search of all benchmark items over all documents."""
    q = benchmark_queries(t)
    found = R.hybrid_search(q, text_chunks(t), k).select("query_id", "id", "rank")
    return found.join(q.select("query_id", "query_text"), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


@query()
def rerank_retrieved(t: Tables) -> DataFrame:
    return R.rerank(retrieved(t), 3).select("query_id", "id", F.col("rerank_rank").alias("rank"))


@query("SELECT o_orderkey AS id, coalesce(c_name, '') AS parent_content FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def parent_expansion(t: Tables) -> DataFrame:
    links = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("parent_id"))
    parents = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))
    return R.expand_parents(t.orders.select(F.col("o_orderkey").alias("id")), links, parents)


@query(f"""WITH cs AS (SELECT label AS id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
r AS (SELECT q.vec_id AS query_id, id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="q.embedding", b="v")} DESC, id)::INT AS rank FROM embeddings q, cs WHERE q.vec_id < 5),
c AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="q.embedding", b="e.embedding")} DESC, e.vec_id)::INT AS rank FROM embeddings q, embeddings e WHERE q.vec_id < 5)
SELECT query_id, 'community_summary' AS content_type, id::BIGINT AS id, rank FROM r WHERE rank <= 2 UNION ALL SELECT query_id, 'text', id, rank + 2 FROM c WHERE rank <= 3""")
def kg_global(t: Tables) -> DataFrame:
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r")).select(F.col("label").cast("long").alias("id"), F.transform("r", lambda r: r["x"]).alias("embedding"))
    q = _vector_queries(t, 5)
    summaries = R.vector_search(q, centre, 2).select("query_id", F.lit("community_summary").alias("content_type"), "id", "rank")
    rows = R.vector_search(q, t.embeddings, 3, id_col="vec_id").select("query_id", F.lit("text").alias("content_type"), "id", (F.col("rank") + 2).alias("rank"))
    return summaries.unionByName(rows)
