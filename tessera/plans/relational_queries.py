"""Queries on text functions, joins, aggregates, state, feedback and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, evaluation, feedback, retrieval, state
from tessera.plans.registry import Tables, query
from tessera.plans.search_queries import literal_rows, retrieved, sql_values
from tessera.sources import files

# --- text functions


@query("SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '\\S+')) * 1.33::DOUBLE))::INT AS token_count, floor(len(regexp_extract_all(text, '\\S+')) * 1.33::DOUBLE)::INT AS parent_tokens FROM documents")
def count_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.count_tokens(F.col("text")).alias("token_count"), T.count_tokens(F.col("text"), 0).alias("parent_tokens"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“”', '''''""'), '[ \\t]+', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \\t\\f\\r]+(\\n|$)', '\\1', 'g'), '^\\s+', ''), '\\s+$', '')) AS cleaned FROM documents""")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.clean(F.col("text")), 256).alias("cleaned"))


NOISE = [(1, "THIS PAGE  INTENTIONALLY LEFT BLANK"), (2, " Page 3 of 10 "), (3, "  42 "), (4, "-----------"), (5, "Distribution Statement A"), (6, "for official use only"), (7, "Page turner"), (8, "plain text"), (9, "----"), (10, "")]


@query(f"""SELECT id::BIGINT AS id, regexp_matches(x, '(?i)THIS\\s+PAGE\\s+INTENTIONALLY\\s+LEFT\\s+BLANK') OR regexp_matches(x, '(?i)^\\s*Page\\s+\\d+\\s*(?:of\\s+\\d+)?\\s*$') OR regexp_matches(x, '^\\s*\\d+\\s*$') OR regexp_matches(x, '^[-=_]{{10,}}$') AS parser_noise,
  regexp_matches(x, '(?i)DISTRIBUTION\\s+(?:AUTHORIZED|LIMITED|STATEMENT)') OR regexp_matches(x, '(?i)THIS\\s+PAGE\\s+INTENTIONALLY\\s+LEFT\\s+BLANK') OR regexp_matches(x, '(?i)FOR\\s+OFFICIAL\\s+USE\\s+ONLY') OR regexp_matches(x, '(?i)^\\s*Page\\s+\\d+\\s*(?:of\\s+\\d+)?\\s*$') AS chunk_noise
  FROM {sql_values(NOISE, "v(id, x)")}""")
def noise_filter(t: Tables) -> DataFrame:
    return literal_rows(t, NOISE, "id long, x string").select("id", T.is_parser_noise(F.col("x")).alias("parser_noise"), T.is_chunk_noise(F.col("x")).alias("chunk_noise"))


@query("""SELECT item_id, array_to_string(regexp_extract_all(text, '\\S+')[1:5], ' ') AS short,
  substring(trim(string_split(text, '.')[1]), 1, 200) AS title FROM benchmark""")
def simplify_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.simplified(F.col("text")).alias("short"), T.community_title(F.col("text")).alias("title"))


JSON = [(1, '```json\n{"a": 1}\n```'), (2, '<think>x</think> {"b": 2} '), (3, "none"), (4, '{"c": [1, 2]}'), (5, "``` {broken ```")]


@query("""SELECT * FROM (VALUES (1::BIGINT, '{"a": 1}'), (2, '{"b": 2}'), (3, NULL), (4, '{"c": [1, 2]}'), (5, NULL)) v(id, answer)""")
def json_clean(t: Tables) -> DataFrame:
    return literal_rows(t, JSON, "id long, x string").select("id", T.json_answer(F.col("x")).alias("answer"))


DESCRIPTIONS = [(1, "This screenshot shows Screen 207 of the system. The field labeled Work Order Number is required. Equipment code OAR-261 must be entered."), (2, 'see form 12A, window 300B and step 4; field: "Job Code"'), (3, "nothing"), (4, "procedure 12 then Step 3, label Name")]


@query(f"""WITH v AS (SELECT * FROM {sql_values(DESCRIPTIONS, "v(id, x)")}),
e AS (SELECT id, 'Screen ' || unnest(regexp_extract_all(x, '(?i)\\b(?:screen|form|window)\\s*(\\d{{3}}[A-Z]?)\\b', 1)) AS e FROM v UNION ALL SELECT id, unnest(regexp_extract_all(x, '\\b[A-Z]{{2,5}}-\\d{{3,}}\\b')) FROM v
  UNION ALL SELECT id, upper(s[1]) || lower(s[2:]) FROM (SELECT id, unnest(regexp_extract_all(x, '(?i)\\b(?:step|procedure|process|task)\\s+\\d+')) AS s FROM v)
  UNION ALL SELECT id, trim(unnest(regexp_extract_all(x, '(?:field|column|label)[:\\s]+["'']?([A-Z][A-Za-z /]{{2,30}})["'']?', 1))) FROM v)
SELECT v.id::BIGINT AS id, coalesce(string_agg(DISTINCT e, '; ' ORDER BY e), '') AS entities FROM v LEFT JOIN e ON v.id = e.id AND len(e) >= 3 GROUP BY v.id""")
def entity_regex(t: Tables) -> DataFrame:
    return literal_rows(t, DESCRIPTIONS, "id long, x string").select("id", F.array_join(T.entities(F.col("x")), "; ").alias("entities"))


@query("SELECT o_orderkey, round(x, 4) AS quality, CASE WHEN round(x, 4) >= 0.8 THEN 'correct' WHEN round(x, 4) >= 0.5 THEN 'ambiguous' ELSE 'incorrect' END AS level, CASE WHEN round(x, 4) >= 0.8 THEN 'use_as_is' WHEN round(x, 4) >= 0.5 THEN 'supplement' ELSE 'rewrite_query' END AS action FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS x FROM orders)")
def quality_level(t: Tables) -> DataFrame:
    q = t.orders.select("o_orderkey", F.round((F.col("o_orderkey") % 101) / F.lit(100.0), 4).alias("quality"))
    return q.select("o_orderkey", "quality", S.quality_level(F.col("quality")).alias("level"), S.corrective_action(F.col("quality")).alias("action"))


@query("""SELECT l_orderkey, l_linenumber, round(kw, 8) AS keyword_rrf, round(vec, 8) AS vector_rrf, round(least(1.0, greatest(0.0, l_discount * 5)), 4) AS kg_score, round(least(1.0, l_tax * 10), 4) AS utility_score, round(l_discount, 4) AS rerank_score,
  round(round(150 * round(kw, 8) + 150 * round(vec, 8) + 0.1::DOUBLE * round(least(1.0, l_discount * 5), 6) + 0.1::DOUBLE * round(least(1.0, l_tax * 10), 6) + 0.5::DOUBLE * round(l_discount, 6), 6) + 0.00001::DOUBLE, 3) AS composite
  FROM (SELECT *, 1.0::DOUBLE / (60 + greatest(1, l_linenumber)) AS kw, 1.0::DOUBLE / (60 + greatest(1, coalesce(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 50 END, 999))) AS vec FROM lineitem)""")
def score_components(t: Tables) -> DataFrame:
    vec = F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 50)
    c = S.score_components(F.col("l_linenumber"), vec, F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_discount"))
    digits = {"keyword_rrf": 8, "vector_rrf": 8}
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.round(x + (1e-5 if k == "composite" else 0), digits.get(k, 3 if k == "composite" else 4)).alias(k) for k, x in c.items()])  # off the rounding boundary


HEADINGS = [(1, [" A ", "", "B", "C"]), (2, ["", " "]), (3, []), (4, None), (5, ["only"])]


@query("SELECT * FROM (VALUES (1::BIGINT, 'A|B'), (2, ''), (3, ''), (4, ''), (5, 'only')) v(id, group_key)")
def heading_key(t: Tables) -> DataFrame:
    return literal_rows(t, HEADINGS, "id long, path array<string>").select("id", F.array_join(T.heading_key(F.col("path")), "|").alias("group_key"))


@query("SELECT page_id, regexp_matches(url, '\\.html') AS html, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url ELSE 'p' || page_id || chr(10) || chr(10) || url END AS embed_text, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN chr(10) || chr(10) || url ELSE 'p' || page_id || chr(10) || chr(10) || url END AS leaf_text FROM pages")
def prefix_texts(t: Tables) -> DataFrame:
    prefix = F.when(F.col("page_id") % 3 == 1, "").when(F.col("page_id") % 3 == 2, F.concat(F.lit("p"), "page_id"))
    return t.pages.select("page_id", F.col("url").rlike(r"\.html").alias("html"), T.embed_text(prefix, F.col("url")).alias("embed_text"), T.leaf_text(prefix, F.col("url")).alias("leaf_text"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') = '42'""")
def json_containment(t: Tables) -> DataFrame:
    return t.events.filter(state.contains(F.col("props"), {"k": 42})).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%e%' OR p_brand ILIKE '%brand#1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def entity_browse(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%e%") | F.col("p_brand").ilike("%brand#1%")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name", "p_size")


# --- joins, aggregates, order


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_left_anti(t: Tables) -> DataFrame:
    return state.without(t.documents, t.labels, ["doc_id"]).select("doc_id", "lang")


@query("SELECT DISTINCT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def not_exists_docs(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return state.without(t.customer, done, ["c_custkey"]).select("c_custkey", "c_nationkey").distinct()


@query("SELECT o_orderkey, n_name, coalesce(s, 0.5::DOUBLE) AS utility FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT user_id, round(avg(value), 4) AS s FROM events GROUP BY user_id) u ON u.user_id = o_custkey")
def chunk_context_join(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("s"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(u, F.col("user_id") == F.col("o_custkey"), "left")
    return j.select("o_orderkey", "n_name", F.coalesce("s", F.lit(0.5)).alias("utility"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id * 7 FROM benchmark)")
def id_list_semi_join(t: Tables) -> DataFrame:
    return t.documents.join(t.benchmark.select((F.col("item_id") * 7).alias("doc_id")), "doc_id", "left_semi").select("doc_id", "source")


@query("""SELECT lang AS collection, count(*) AS documents, count(DISTINCT source) AS files, count(DISTINCT sha256(text)) AS contents, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def collection_stats(t: Tables) -> DataFrame:
    j = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("x")), "doc_id", "left")
    return j.groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("files"), F.countDistinct(F.sha2("text", 256)).alias("contents"), F.count("x").alias("labelled"))


@query("SELECT lang, count(*) AS files, count(*) FILTER (WHERE n_chars >= 200) AS ingested, count(*) FILTER (WHERE n_chars < 200) AS skipped, sum(greatest(1, floor(len(regexp_extract_all(text, '\\S+')) * 1.33::DOUBLE)))::BIGINT AS tokens FROM documents GROUP BY lang")
def ingest_summary(t: Tables) -> DataFrame:
    big = F.col("n_chars") >= 200
    return t.documents.groupBy("lang").agg(F.count("*").alias("files"), F.count(F.when(big, 1)).alias("ingested"), F.count(F.when(~big, 1)).alias("skipped"), F.sum(T.count_tokens(F.col("text"))).alias("tokens"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_on(t: Tables) -> DataFrame:
    return state.first_rows(t.orders, ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderpriority AS difficulty, count(*) AS n FROM orders GROUP BY 1")
def count_by_difficulty(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("difficulty")).agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS failed FROM events WHERE event_type = 'error' GROUP BY user_id")
def failed_by_target(t: Tables) -> DataFrame:
    e = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    return e.select("user_id", F.array_join(F.transform("x", lambda i: i.cast("string")), ",").alias("failed"))


@query("SELECT label AS community, count(*) AS size, sum(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS level0 FROM embeddings GROUP BY label")
def community_sizes(t: Tables) -> DataFrame:
    return t.embeddings.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("size"), F.sum(F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)).alias("level0"))


@query("SELECT community, id, rank FROM (SELECT c_nationkey AS community, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 10")
def community_top_entities(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("id"), "c_acctbal")
    return retrieval.top_k(rows, [F.desc("c_acctbal"), F.asc("id")], 10, keys=["community"]).select("community", "id", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_runs(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


# --- state


@query("SELECT file_hash, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT sha256(text) AS file_hash, doc_id FROM documents) GROUP BY file_hash")
def doc_dedup_hash(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents)"


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


@query(f"""SELECT doc_id AS document_id, chunk_index::INT AS chunk_index, sha256(lang || ':' || source || ':' || chunk_index || ':' || sha256(content)) AS stable_id FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(content) ORDER BY chunk_index) AS n FROM {_LINES}) WHERE n = 1""")
def chunk_hash_ids(t: Tables) -> DataFrame:
    rows = _lines(t).select(F.col("doc_id").alias("document_id"), F.col("lang").alias("collection"), F.col("source").alias("file_path"), "chunk_index", "content")
    return state.identified_chunks(rows).select("document_id", "chunk_index", "stable_id")


@query("SELECT lang, source, arg_max(doc_id % 7, doc_id) AS kind, sha256(arg_max(text, (length(text), -doc_id))) AS longest FROM documents GROUP BY lang, source")
def upsert_keep_longest(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("kind", F.col("doc_id") % 7)
    return state.keep_longest(rows, ["lang", "source"], "text", "kind", "doc_id").select("lang", "source", "kind", F.sha2("text", 256).alias("longest"))


@query("SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NOT NULL THEN v ELSE c_acctbal END AS value FROM customer FULL JOIN (SELECT o_custkey + 100 AS k, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1) d ON c_custkey = k")
def upsert_replace(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    new = t.orders.groupBy((F.col("o_custkey") + 100).alias("id")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    return state.upsert(old, new, ["id"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT id, name FROM (SELECT o_custkey + 100 AS id, 'o' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 AND id NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = t.orders.select((F.col("o_custkey") + 100).alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey")
    return state.insert_ignore(old.withColumn("o_orderkey", F.lit(None).cast("long")), new, ["id"], ["o_orderkey"]).drop("o_orderkey")


@query("SELECT vec_id AS id, CASE WHEN quality = 0 THEN 'healed' ELSE 'old' END AS context_prefix, coalesce(quality <> 0, TRUE) AS has_embedding FROM embeddings LEFT JOIN labels ON vec_id = doc_id")
def heal_write_back(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("old").alias("context_prefix"), "embedding")
    fixes = t.labels.filter("quality = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("healed").alias("prefix"))
    return state.heal(chunks, fixes).select("id", "context_prefix", F.col("embedding").isNotNull().alias("has_embedding"))


@query("SELECT 'kept' AS kind, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'lines', count(*), sum(l_linenumber)::BIGINT FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT 'null', count(*), sum(CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT FROM lineitem")
def cascade_delete(t: Tables) -> DataFrame:
    orders, lines = t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_linenumber")
    keys = orders.filter("id % 5 = 0")
    kept, left = state.delete_cascade(orders, lines, keys, "order_id")
    _, nulled = state.delete_set_null(orders, lines, keys, "order_id")
    # lines point at orders only, so a null is one that was set
    rows = [kept.agg(F.count("*").alias("n"), F.sum("id").alias("s")), left.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s")), nulled.agg(F.count("*").alias("n"), F.sum(F.col("order_id").isNull().cast("long")).alias("s"))]
    named = [r.select(F.lit(k).alias("kind"), "n", "s") for k, r in zip(("kept", "lines", "null"), rows)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'source': source, 'lang': lang}) AS line FROM documents")
def jsonl_export(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("doc_id", "source", "lang")).alias("line"))


# --- feedback


_STATE = """(SELECT user_id AS chunk_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS retrieve_count, count(*) FILTER (WHERE event_type = 'purchase') AS use_count, max(ts) FILTER (WHERE event_type = 'purchase') AS last_used, max(ts) AS updated_at FROM events GROUP BY user_id)"""
_EMA = """(SELECT user_id AS chunk_id, round(0.5::DOUBLE * pow(0.85::DOUBLE, count(*)) + sum(0.15::DOUBLE * pow(0.85::DOUBLE, later) * least(1, greatest(0, value / 100))), 6) AS utility_ema FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS later FROM events WHERE event_type = 'purchase') GROUP BY user_id)"""


def _uses(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("chunk_id"), "ts", F.col("event_id").alias("seq"), (F.col("value") / 100).alias("contribution"))


def _utility(t: Tables) -> DataFrame:
    return feedback.utility_ema(_uses(t)).withColumn("utility_ema", F.round("utility_ema", 6))


def _state(t: Tables) -> DataFrame:
    p = F.col("event_type") == "purchase"
    s = t.events.groupBy(F.col("user_id").alias("chunk_id")).agg(
        F.count(F.when(F.col("event_type").isin("view", "click"), 1)).alias("retrieve_count"), F.count(F.when(p, 1)).alias("use_count"), F.max(F.when(p, F.col("ts"))).alias("last_used"), F.max("ts").alias("updated_at")
    )
    return s.join(_utility(t).select("chunk_id", "utility_ema"), "chunk_id", "left").withColumn("utility_ema", F.coalesce("utility_ema", F.lit(0.5)))


@query("SELECT user_id AS chunk_id, count(*) AS retrieve_count FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def record_retrieval(t: Tables) -> DataFrame:
    return feedback.record_retrievals(t.events.filter(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("chunk_id")))


@query(f"SELECT chunk_id, utility_ema FROM {_EMA}")
def utility_ema(t: Tables) -> DataFrame:
    return _utility(t).select("chunk_id", "utility_ema")


@query(f"SELECT count(*) AS chunks, round(avg(coalesce(utility_ema, 0.5)), 4) AS avg_ema, round(max(coalesce(utility_ema, 0.5)), 4) AS max_ema, round(min(coalesce(utility_ema, 0.5)), 4) AS min_ema, sum(retrieve_count)::BIGINT AS retrieves, sum(use_count)::BIGINT AS uses FROM {_STATE} LEFT JOIN {_EMA} USING (chunk_id)")
def utility_stats(t: Tables) -> DataFrame:
    return feedback.utility_stats(_state(t))


@query(f"SELECT query_id, id, rank FROM (SELECT o_custkey % 20 AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY round(o_totalprice / 1000 * (1 + 0.3::DOUBLE * (coalesce(utility_ema, 0.5) - 0.5)), 6) DESC, o_orderkey)::INT AS rank FROM orders LEFT JOIN {_EMA} ON chunk_id = o_orderkey) WHERE rank <= 5")
def utility_boost(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("score"))
    return feedback.boosted(rows, _utility(t), 5).select("query_id", "id", "rank")


@query(f"SELECT c_custkey AS id, round(c_acctbal * (1 + 0.3::DOUBLE * coalesce(utility_ema, 0.0)), 4) AS score FROM customer LEFT JOIN {_EMA} ON chunk_id = c_custkey")
def rerank_with_utility(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).join(_utility(t).select(F.col("chunk_id").alias("id"), "utility_ema"), "id", "left")
    return rows.select("id", F.round(S.rerank_boost(F.col("score"), F.col("utility_ema")), 4).alias("score"))


@query(f"SELECT chunk_id, round(CASE WHEN old THEN 0.9::DOUBLE * e + 0.05::DOUBLE ELSE e END, 6) AS utility_ema, old AS decayed FROM (SELECT chunk_id, coalesce(utility_ema, 0.5::DOUBLE) AS e, coalesce(last_used < TIMESTAMP '2024-01-25' - INTERVAL 5 DAYS, updated_at < TIMESTAMP '2024-01-25' - INTERVAL 5 DAYS) AS old FROM {_STATE} LEFT JOIN {_EMA} USING (chunk_id))")
def utility_decay(t: Tables) -> DataFrame:
    return feedback.decayed(_state(t), "2024-01-25", 5).select("chunk_id", F.round("utility_ema", 6).alias("utility_ema"), "decayed")


@query(f"SELECT chunk_id, c_name, utility_ema FROM {_EMA} JOIN customer ON chunk_id = c_custkey ORDER BY utility_ema DESC, chunk_id LIMIT 20")
def top_utility(t: Tables) -> DataFrame:
    return _utility(t).join(t.customer, F.col("chunk_id") == F.col("c_custkey")).orderBy(F.desc("utility_ema"), "chunk_id").limit(20).select("chunk_id", "c_name", "utility_ema")


_OVERLAP = "round(10 * len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}0-9]+')), regexp_extract_all(lower(substring(d.text, 1, N)), '[\\p{L}0-9]+'))) / len(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}0-9]+')))::DOUBLE, 4)"
_PAIRS = "benchmark q JOIN documents d ON d.doc_id % 40 = q.item_id % 40 WHERE q.item_id < 20"


def _graded_rows(t: Tables) -> DataFrame:
    q = t.benchmark.filter("item_id < 20").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), (F.col("item_id") % 40).alias("k"))
    return q.join(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 40).alias("k"), (F.expr("doc_id div 40") + 1).alias("rank")), "k")


@query(f"WITH g AS (SELECT q.item_id AS query_id, round(avg({_OVERLAP.replace('N)', '500)').replace('round(10 * ', 'round(').replace(', 4)', ', 12)')}), 4) AS quality FROM {_PAIRS} GROUP BY 1) SELECT query_id, quality, CASE WHEN quality >= 0.8 THEN 'use_as_is' WHEN quality >= 0.5 THEN 'supplement' ELSE 'rewrite_query' END AS action FROM g")
def crag_action(t: Tables) -> DataFrame:
    return feedback.graded(_graded_rows(t)).select("query_id", "quality", "action")


@query(f"SELECT q.item_id AS query_id, d.doc_id AS id, {_OVERLAP.replace('N)', '300)')} AS relevance_score, ((d.doc_id // 40) // 5)::INT AS batch FROM {_PAIRS} AND {_OVERLAP.replace('N)', '300)')} >= 0.1 * 10")
def selfrag_filter(t: Tables) -> DataFrame:
    return feedback.relevant(_graded_rows(t), 0.1).select("query_id", "id", "relevance_score", "batch")


@query()
def crag_retrieved(t: Tables) -> DataFrame:
    return feedback.graded(retrieved(t)).select("query_id", "quality", "action")


@query()
def selfrag_retrieved(t: Tables) -> DataFrame:
    return feedback.relevant(retrieved(t), 0.1).select("query_id", "id", "relevance_score", "batch")


_LISTS = "l AS (SELECT o_custkey % 30 AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), m AS (SELECT o_custkey % 30 AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_custkey % 30 < 28)"


@query(f"""WITH {_LISTS}, v AS (SELECT q, CASE q % 3 WHEN 0 THEN 'use_as_is' WHEN 1 THEN 'supplement' ELSE 'rewrite_query' END AS action FROM (SELECT DISTINCT q FROM l)),
a AS (SELECT q, id, 0 AS part, r FROM l JOIN v USING (q) WHERE r <= 5 AND (action <> 'rewrite_query' OR q NOT IN (SELECT q FROM m))), b AS (SELECT m.q, m.id, 1 AS part, m.r FROM m JOIN v USING (q) WHERE r <= 5 AND (action = 'rewrite_query' OR action = 'supplement' AND NOT EXISTS (SELECT 1 FROM l WHERE l.q = m.q AND l.id = m.id AND l.r <= 5)))
SELECT q AS query_id, id, row_number() OVER (PARTITION BY q ORDER BY part, r, id)::INT AS position FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def corrective_supplement(t: Tables) -> DataFrame:
    base = t.orders.select((F.col("o_custkey") % 30).alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    one = retrieval.top_k(base, [F.desc("o_totalprice"), F.asc("id")], 5, keys=["query_id"]).select("query_id", "id", "rank")
    two = retrieval.top_k(base.filter("query_id < 28"), [F.desc("o_orderdate"), F.asc("id")], 5, keys=["query_id"]).select("query_id", "id", "rank")
    action = F.when(F.col("query_id") % 3 == 0, "use_as_is").when(F.col("query_id") % 3 == 1, "supplement").otherwise("rewrite_query")
    return feedback.corrected(one, two, base.select("query_id").distinct().withColumn("action", action)).select("query_id", "id", "position")


@query("SELECT chain_id, step_id, position, content_snippet FROM (SELECT o_custkey AS chain_id, o_orderkey AS step_id, substring(d.text, 1, 300) AS content_snippet, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END NULLS LAST, o_orderkey)::INT AS position FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN documents d ON doc_id = o_orderkey)")
def provenance_chain(t: Tables) -> DataFrame:
    chains = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("overall_confidence"))
    steps = t.orders.select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("step_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 10).alias("rank_position"))
    return feedback.provenance_chain(chains, steps, t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).select("chain_id", "step_id", "position", "content_snippet")


@query("SELECT o_custkey AS query_id, round(least(1, greatest(0, avg(o_totalprice / 500000))), 6) AS overall_confidence FROM orders GROUP BY 1")
def answer_confidence(t: Tables) -> DataFrame:
    return feedback.confidence(t.orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_totalprice") / 500000).alias("score")))


# --- evaluation


_FLAGS = "(SELECT doc_id % 25 AS query_id, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id)::INT AS rank, quality AS relevant FROM labels)"


def _flags(t: Tables) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("doc_id")
    return t.labels.withColumn("query_id", F.col("doc_id") % 25).select("query_id", F.row_number().over(w).alias("rank"), F.col("quality").alias("relevant"))


@query(f"SELECT query_id, round(coalesce(avg(p) FILTER (WHERE relevant = 1), 0), 4) AS context_precision FROM (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM {_FLAGS}) GROUP BY query_id")
def context_precision(t: Tables) -> DataFrame:
    return evaluation.context_precision(_flags(t))


@query(f"SELECT query_id, round(avg(relevant), 4) AS context_recall FROM {_FLAGS} GROUP BY query_id")
def context_recall(t: Tables) -> DataFrame:
    return evaluation.context_recall(_flags(t).withColumn("supported", F.col("relevant")))


@query("SELECT a.vec_id % 20 AS query_id, round(least(1, greatest(0, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 4) AS answer_relevancy FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 20 GROUP BY 1")
def answer_relevancy(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 20).alias("vec_id"), F.col("embedding").alias("reverse_vec"))
    return evaluation.answer_relevancy(t.embeddings.join(b, "vec_id").select((F.col("vec_id") % 20).alias("query_id"), F.col("embedding").alias("question_vec"), "reverse_vec"))


@query("SELECT 'run' || (o_custkey % 5) AS run_name, round(avg(o_totalprice), 4) AS faithfulness, count(*) AS n_questions FROM orders GROUP BY 1")
def eval_means(t: Tables) -> DataFrame:
    return evaluation.run_means(t.orders.select(F.concat(F.lit("run"), (F.col("o_custkey") % 5).cast("string")).alias("run_name"), F.col("o_totalprice").alias("faithfulness")), ["faithfulness"])


@query("""WITH r AS (SELECT o_custkey % 50 AS test_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
x AS (SELECT t.test_id, coalesce(max((id = target_id AND score >= 300000)::INT), 0) AS found, coalesce(max(score), 0) AS best_score FROM (SELECT o_custkey % 50 AS test_id, max(o_orderkey) FILTER (WHERE o_totalprice > 1) AS target_id FROM orders GROUP BY 1) t LEFT JOIN r ON r.test_id = t.test_id AND rank <= 5 GROUP BY t.test_id)
SELECT test_id, found, best_score FROM x""")
def blind_spot_rate(t: Tables) -> DataFrame:
    base = t.orders.select((F.col("o_custkey") % 50).alias("test_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    ranked = retrieval.top_k(base, [F.desc("score"), F.asc("id")], 5, keys=["test_id"])
    tests = base.filter("score > 1").groupBy("test_id").agg(F.max("id").alias("target_id"))
    return evaluation.blind_spots(tests, ranked, 300000.0)


@query("SELECT doc_id FROM documents WHERE n_chars > 50 ORDER BY sha256(doc_id::VARCHAR || 'seed42') LIMIT 30")
def sample_chunks(t: Tables) -> DataFrame:
    return evaluation.sample(t.documents.filter("n_chars > 50"), 30, "seed42", "doc_id").select("doc_id")


@query("SELECT * FROM (VALUES ('extractive', 5), ('abstractive', 3), ('multi_hop', 2)) v(kind, n)")
def question_allocation(t: Tables) -> DataFrame:
    return literal_rows(t, list(evaluation.allocation(10, {"extractive": 0.5, "abstractive": 0.3, "multi_hop": 0.2}).items()), "kind string, n int")


# --- ingest


@query(f"SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN tok < 5 AND chunk_index % 4 <> 0 THEN 'dropped' WHEN chunk_index % 4 = 0 OR tok <= 60 THEN 'single' WHEN chunk_index % 4 = 1 THEN 'table' ELSE 'split' END AS route FROM (SELECT *, greatest(1, floor(len(regexp_extract_all(content, '\\S+')) * 1.33::DOUBLE)) AS tok FROM {_LINES})")
def chunk_classify(t: Tables) -> DataFrame:
    rows = _lines(t).withColumns({"tok": T.count_tokens(F.col("content")), "atomic": F.col("chunk_index") % 4 == 0})
    route = F.when((F.col("tok") < 5) & ~F.col("atomic"), "dropped").when(F.col("atomic") | (F.col("tok") <= 60), "single").when(F.col("chunk_index") % 4 == 1, "table").otherwise("split")
    return rows.select("doc_id", "chunk_index", route.alias("route"))


@query()
def chunk_documents(t: Tables) -> DataFrame:
    block = F.struct(F.col("text").alias("content"), F.lit("text").alias("content_type"), F.array("source").alias("heading_path"))
    return chunking.chunk_blocks(t.documents.select("doc_id", F.array(block).alias("blocks")))


@query()
def table_split(t: Tables) -> DataFrame:
    blocks = t.documents.select("doc_id", F.lit(0).alias("block_index"), F.concat(F.lit("| a |\n| --- |\n"), "text").alias("content"), F.lit("table").alias("content_type"))
    return chunking.chunk_blocks(blocks, limits={"table": 200}).select("doc_id", "chunk_index", "token_count")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE lang = 'en')
SELECT doc_id, count(*) AS sections, max(i) AS last_line FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d) WHERE regexp_matches(x, '\\S') GROUP BY doc_id""")
def line_sections(t: Tables) -> DataFrame:
    rows = t.documents.filter("lang = 'en'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return rows.filter(F.col("x").rlike(r"\S")).groupBy("doc_id").agg(F.count("*").alias("sections"), (F.max("i") + 1).cast("long").alias("last_line"))


MARKDOWN = [(1, "guide", "intro\n# One\nalpha\n\n### Deep\nbeta\n## Two\n\ngamma\n# Three\n12\n"), (2, "note", "no headings\nat all"), (3, "empty", "")]


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 'intro', 'guide'), (1, 1, 'alpha', 'One'), (1, 2, 'beta', 'One > Deep'), (1, 3, 'gamma', 'One > Two'), (2, 0, 'no headings' || chr(10) || 'at all', 'note')) v(doc_id, block_index, content, context_prefix)")
def markdown_sections(t: Tables) -> DataFrame:
    return files.markdown_sections(literal_rows(t, MARKDOWN, "doc_id long, stem string, text string")).select("doc_id", "block_index", "content", "context_prefix")


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, chunk_index, greatest(1, floor(len(regexp_extract_all(content, '\\S+')) * 1.33::DOUBLE))::BIGINT AS n FROM {_LINES}),
w AS (SELECT doc_id, chunk_index, 0 AS parent_no, n AS s FROM c WHERE chunk_index = 0 UNION ALL
  SELECT c.doc_id, c.chunk_index, CASE WHEN w.s > 0 AND w.s + c.n > 250 THEN parent_no + 1 ELSE parent_no END, CASE WHEN w.s > 0 AND w.s + c.n > 250 THEN c.n ELSE w.s + c.n END FROM w JOIN c ON c.doc_id = w.doc_id AND c.chunk_index = w.chunk_index + 1)
SELECT doc_id, chunk_index::INT AS chunk_index, parent_no FROM w""")
def parent_pack(t: Tables) -> DataFrame:
    rows = _lines(t).select(F.col("doc_id").alias("document_id"), F.lit("g").alias("group"), "chunk_index", F.col("chunk_index").cast("long").alias("chunk_id"), T.count_tokens(F.col("content")).alias("token_count"))
    return chunking.pack_parents(rows, 250).select(F.col("document_id").alias("doc_id"), "chunk_index", "parent_no")


BOUNDARIES = [(1, "one. two three four", 12), (2, "para\n\nnext words here", 14), (3, "nobreakatall", 5), (4, "line\nother", 8), (5, "short", 50)]


@query("SELECT * FROM (VALUES (1::BIGINT, 5), (2, 6), (3, 5), (4, 5), (5, 5)) v(id, cut_at)")
def sentence_boundary(t: Tables) -> DataFrame:
    return literal_rows(t, BOUNDARIES, "id long, x string, at int").select("id", T.last_boundary(F.col("x"), F.col("at")).alias("cut_at"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'docx' WHEN page_id % 5 = 1 THEN 'pdf' ELSE 'text' END AS parser FROM pages WHERE page_id % 5 < 4 AND page_id % 7 <> 0")
def file_discovery(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, [".docx", ".pdf", ".TXT", ".md", ".exe"])), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 7 == 0, "skip").otherwise("keep")
    rows = t.pages.select("page_id", F.concat(F.lit("/base/"), folder, F.lit("/f"), F.col("page_id").cast("string"), suffix).alias("path"))
    return files.known_files(rows, exclude_dirs=["skip"]).select("page_id", "parser")
