"""Search over many queries at once: vector, keyword, hybrid, and the fusion of ranked lists.

A query table is small beside the corpus but its size isn't known, so joins leave the choice of a broadcast to the planner;
contents are joined back last, by id, to the few rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.scoring import STRATEGIES, rrf
from tessera.operators.storage import cut

#: Rows of a query table up to which it is broadcast.
MAX_BROADCAST_QUERIES = 10_000


def top_k(df: DataFrame, by: list, k: int, *, keys: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def small(df: DataFrame, most: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, checked by reading one more."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Queries of one block of a vector search, and of one product.
QUERY_BLOCK, QUERY_ROWS = 4096, 64


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best ids of each query, by score and then id, as numbers of queries, numbers of ids and scores; a matrix product for some
    queries at a time, each of which gives one item."""
    for i in range(0, len(queries), QUERY_ROWS):
        scores = np.round(queries[i : i + QUERY_ROWS] @ vectors.T, digits)
        found = []
        for row in scores:
            at = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(row >= np.partition(row, len(ids) - k)[len(ids) - k])
            found.append(at[np.lexsort((ids[at], -row[at]))[:k]])
        query = np.repeat(np.arange(len(found)), [len(at) for at in found])
        at = np.concatenate(found)
        yield i + query, at, scores[query, at]


def _by_length(ids: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Vectors of each length as a matrix, with their ids."""
    found: dict[int, tuple[list, list]] = {}
    for x, v in zip(ids, vectors):
        if v is not None:
            of = found.setdefault(len(v), ([], []))
            of[0].append(x)
            of[1].append(v)
    return {n: (x, np.array(v, np.float64)) for n, (x, v) in found.items() if n}


def _beside(queries: pa.Table, corpus: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
    """The corpus in Arrow batches beside a bounded table of queries; each batch keeps k rows a query."""
    kind = queries.schema.field("query_id").type
    of = _by_length(queries["query_id"].to_pylist(), queries["_q"].to_pylist())
    asked = corpus.sparkSession.sparkContext.broadcast({n: (pa.array(x, kind), m) for n, (x, m) in of.items()})

    def run(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            if len(lengths) and lists.null_count == 0 and (lengths == lengths[0]).all():  # nearly always
                of = {int(lengths[0]): (ids.to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1))}
            else:
                of = _by_length(ids.to_pylist(), lists.to_pylist())
            for n, (here, vectors) in of.items():
                if n in asked.value:
                    names, m = asked.value[n]
                    known = pa.array(here, ids.type)
                    for query, at, score in _best(m, np.array(here), vectors, k, digits):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), known.take(pa.array(at)), pa.array(score)], names=["query_id", "id", "score"])

    return corpus.mapInArrow(run, schema)


def _blocked(queries: DataFrame, corpus: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
    """Any number of queries: blocks of them meet parts of the corpus; each pair of a block and a part keeps k rows a query."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block, part = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part")
    asked = queries.select(block, part, "query_id", F.col("_q").alias("v")).groupBy("block", "part")
    held = corpus.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), "id", F.col("_v").alias("v")).groupBy("block", "part")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts, of = [pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": np.zeros(0)})], _by_length(right["id"].tolist(), right["v"].tolist())
        for n, (ids, vectors) in _by_length(left["query_id"].tolist(), left["v"].tolist()).items():
            if n in of:
                names, known = np.array(ids), np.array(of[n][0])
                parts += [pd.DataFrame({"query_id": names[query], "id": known[at], "score": score}) for query, at, score in _best(vectors, known, of[n][1], k, digits)]
        return pd.concat(parts, ignore_index=True)

    return asked.cogroup(held).applyInPandas(best, schema)


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "id", score_digits: int = 6) -> DataFrame:
    """queries: query_id, query_vec; corpus: id_col, embedding and filter columns -> query_id, id, score, rank.

    The corpus is scanned once with all queries (a stated query set, MAX_BROADCAST_QUERIES of them at most) beside it; more of them are
    dealt to blocks."""
    q = queries.select("query_id", V.unit(V.as_double(F.col("query_vec"))).alias("_q")).filter("_q IS NOT NULL")
    c = corpus.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), V.unit(V.as_double(F.col("embedding"))).alias("_v")).filter("_v IS NOT NULL")
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {c.schema['id'].dataType.simpleString()}, score double"
    first = q.limit(MAX_BROADCAST_QUERIES + 1).toArrow()
    pairs = _beside(first, c, k, score_digits, schema) if first.num_rows <= MAX_BROADCAST_QUERIES else _blocked(q, c, k, score_digits, schema)
    return top_k(pairs, [F.desc("score"), F.asc("id")], k, keys=["query_id"])


def postings(corpus: DataFrame, *, id_col: str = "id", text_col: str = "content", stop_words: list[str] | None = None) -> DataFrame:
    """term, id, tf, doc_len; the inverted index. Terms of a document are counted before they are shuffled."""
    terms = corpus.select(F.col(id_col).alias("id"), T.terms(F.col(text_col), stop_words).alias("terms"))
    long = terms.select("id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    return long.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf"))


#: Distinct terms of a query table up to which they are sent as a set.
MAX_TERMS = 20_000


def keyword_search(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "id", text_col: str = "content", k1: float = 1.2, b: float = 0.75, stop_words: list[str] | None = None) -> DataFrame:
    """queries: query_id, query_text -> query_id, id, score, rank: documents that hold every term, by BM25.

    Texts are read and split once: of each document only the terms that are asked for go on, with its length, and one row without a term
    for the corpus statistics."""
    terms = queries.select("query_id", F.array_distinct(T.terms(F.col("query_text"), stop_words)).alias("_t"))
    asked = terms.select("query_id", F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    wanted = asked.select("term").distinct()
    known = [r["term"] for r in wanted.limit(MAX_TERMS + 1).collect()]
    docs = corpus.select(F.col(id_col).alias("id"), T.terms(F.col(text_col), stop_words).alias("_all"))
    here = F.filter("_all", lambda t: t.isin(known)) if known and len(known) <= MAX_TERMS else F.col("_all") if known else F.array().cast("array<string>")
    rows = docs.select("id", F.size("_all").alias("doc_len"), F.explode(F.concat(here, F.array(F.lit("")))).alias("term"))
    if len(known) > MAX_TERMS:
        rows = rows.join(wanted.unionByName(queries.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi")
    hits = cut(rows.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf")))
    stats = hits.filter("term = ''").agg(F.count("*").alias("_docs"), F.avg("doc_len").alias("_avg"))
    hits = hits.filter("term <> ''")
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))
    # all are of the queries' terms; a document counts for a query if it has the query's rarest term, and only then are the others joined
    known = cut(asked.join(df, "term"))
    rarest = known.groupBy("query_id", "_n").agg(F.count("*").alias("_known"), F.min_by("term", F.struct("_df", "term")).alias("term")).filter("_known = _n").select("query_id", "term")
    maybe = hits.select("term", "id").join(small(rarest, MAX_TERMS), "term").select("query_id", "id")
    scored = maybe.join(small(known, MAX_TERMS), "query_id").join(hits, ["term", "id"]).crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("_avg")))
    per_doc = scored.groupBy("query_id", "id", "_n").agg(F.count("*").alias("_hits"), F.round(F.sum(weight), 6).alias("score"))
    return top_k(per_doc.filter("_hits = _n").select("query_id", "id", "score"), [F.desc("score"), F.asc("id")], k, keys=["query_id"])


def fuse(lists: DataFrame, k: int = 60, limit: int = 10, *, keys: tuple[str, ...] = ("query_id",), digits: int = 8) -> DataFrame:
    """lists: keys, id, rank (from 1) and optionally rrf_k -> keys, id, rrf_score, rank."""
    weight = 1.0 / (F.col("rrf_k") + F.col("rank")) if "rrf_k" in lists.columns else rrf(F.col("rank"), k)
    merged = lists.groupBy(*keys, "id").agg(F.round(F.sum(weight), digits).alias("rrf_score"))
    return top_k(merged, [F.desc("rrf_score"), F.asc("id")], limit, keys=list(keys))


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, *, tier: int | None = None, fetch: int = 4, k_keyword: int = 40, k_vector: int = 60, text_col: str = "content", stop_words: list[str] | None = None) -> DataFrame:
    """queries: query_id, query_text, query_vec; chunks: id, content, embedding. tier 1: keyword only, 2: vector only."""
    parts = []
    if tier != 2:
        parts.append(keyword_search(queries, chunks, k * fetch, text_col=text_col, stop_words=stop_words).select("query_id", "id", "rank", F.lit(k_keyword).alias("rrf_k")))
    if tier != 1:
        parts.append(vector_search(queries, chunks, k * fetch).select("query_id", "id", "rank", F.lit(k_vector).alias("rrf_k")))
    lists = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return fuse(lists, limit=k)


def hyde_search(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "id") -> DataFrame:
    """queries: query_id, query_vec and hypothesis_vec (null: none) -> the two result lists fused."""
    q = queries.select("query_id", "query_vec")
    h = queries.filter(F.col("hypothesis_vec").isNotNull()).select("query_id", F.col("hypothesis_vec").alias("query_vec"))
    one = vector_search(h, corpus, 4 * k, id_col=id_col).select("query_id", "id", "rank")
    two = vector_search(q, corpus, 4 * k, id_col=id_col).select("query_id", "id", "rank")
    return fuse(one.unionByName(two), 60, k)


def expand_parents(rows: DataFrame, chunk_parents: DataFrame, parents: DataFrame) -> DataFrame:
    """rows (with id) and parent_content, "" where a chunk has no parent."""
    p = chunk_parents.join(parents.select(F.col("id").alias("parent_id"), F.col("content").alias("_p")), "parent_id").select(F.col("chunk_id").alias("id"), "_p")
    return rows.join(p, "id", "left").withColumn("parent_content", F.coalesce("_p", F.lit(""))).drop("_p")


def overlap_score(query, passage):
    """The offline scorer: the share of the query's terms that the passage has."""
    q, p = F.array_distinct(T.terms(query)), T.terms(passage)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)


def rerank(rows: DataFrame, k: int, *, query: str = "query_text", passage: str = "content", chars: int = 1024, score=overlap_score) -> DataFrame:
    """rows: query_id, id, query and passage -> the k best by the scorer on the passages' first characters."""
    scored = rows.withColumn("rerank_score", F.round(score(F.col(query), F.substring(F.col(passage), 1, chars)), 6))
    return top_k(scored, [F.desc("rerank_score"), F.asc("id")], k, keys=["query_id"], rank="rerank_rank")


def sub_queries(answers: DataFrame, *, most: int = 8) -> DataFrame:
    """answers: query_id, query_text, answer (JSON with sub_queries) -> query_id, pos, query, query_type, depends_on. What can't be
    read, or only repeats the query, gives the query itself."""
    item = "struct<query:string,query_type:string,depends_on:string>"
    parsed = F.from_json(T.json_answer(F.col("answer")), f"struct<sub_queries:array<{item}>>")["sub_queries"]
    kept = F.filter(F.coalesce(parsed, F.array().cast(f"array<{item}>")), lambda x: T.strip(F.coalesce(x["query"], F.lit(""))) != "")
    own = F.array(F.struct(F.col("query_text").alias("query"), F.lit("specific_factoid").alias("query_type"), F.lit(None).cast("string").alias("depends_on")))
    only = (F.size(kept) == 0) | ((F.size(kept) == 1) & (T.strip(kept[0]["query"]) == T.strip(F.col("query_text"))))
    rows = answers.select("query_id", F.posexplode(F.slice(F.when(only, own).otherwise(kept), 1, most)).alias("pos", "s"))
    types = list(STRATEGIES)
    dep = F.when(F.col("s.depends_on").rlike(r"^\d+$"), F.col("s.depends_on").cast("int"))
    return rows.select("query_id", "pos", T.strip(F.col("s.query")).alias("query"), F.when(F.col("s.query_type").isin(types), F.col("s.query_type")).otherwise("specific_factoid").alias("query_type"), F.when(dep < F.col("pos"), dep).alias("depends_on"))


def multi_query(subs: DataFrame, search, k: int = 10) -> DataFrame:
    """subs: query_id, pos, query; search: a query table -> query_id, id, rank. Each sub-query is searched and the lists are fused
    by the query they come from; all in one plan."""
    keyed = subs.withColumn("_sub", F.concat_ws("#", "query_id", "pos"))
    found = search(keyed.select(F.col("_sub").alias("query_id"), F.col("query").alias("query_text"))).select(F.col("query_id").alias("_sub"), "id", "rank")
    return fuse(found.join(keyed.select("_sub", "query_id"), "_sub").select("query_id", "id", "rank"), 60, k)
