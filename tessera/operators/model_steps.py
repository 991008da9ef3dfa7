"""Steps that ask a model, with what they fall back to. Answers come from a Provider in Arrow batches; each step is a function of
tables, run on the rows that lack a result only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import STRATEGIES, clamp, corrective_action, quality_level, query_class
from tessera.operators import evaluation, graph, state
from tessera.operators.retrieval import sub_queries, top_k
from tessera.operators.storage import cut
from tessera.providers import PROMPTS, Provider, completions, embeddings, rating


def embed_missing(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Chunks without an embedding get one, of prefix and content."""
    done, todo = chunks.filter(F.col("embedding").isNotNull()), chunks.filter(F.col("embedding").isNull()).drop("embedding")
    new = embeddings(todo, T.embed_text(F.col("context_prefix"), F.col("content")), provider)
    return done.unionByName(new.select(*done.columns))


def contextualise(chunks: DataFrame, documents: DataFrame, contexts: DataFrame, provider: Provider) -> DataFrame:
    """chunk_id, context_text of chunks that have none; documents: document_id, text, title. Long or binary documents give their title."""
    todo = chunks.join(contexts.select(F.col("chunk_id").alias("id")), "id", "left_anti").join(documents, "document_id")
    whole = F.when((F.length("text") > 2_000_000) | F.col("text").contains("\x00"), F.col("title")).otherwise(F.col("text"))
    return completions(todo, PROMPTS["context"](whole, F.col("content")), provider, "context_text").select(F.col("id").alias("chunk_id"), "context_text")


def extract_graph(chunks: DataFrame, done: DataFrame, provider: Provider, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relations of chunks that have none. Names are resolved against the entities of the batch and the known ones
    (collection, name, id) of the collection."""
    todo = chunks.join(done.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
    answers = completions(todo, PROMPTS["entities"](F.col("content")), provider).select(F.col("id").alias("chunk_id"), "collection", "answer")
    found, relations = graph.extracted(answers)
    of = answers.select("chunk_id", "collection")
    found = found.join(of, "chunk_id").withColumn("seq", F.col("chunk_id") * 1000 + F.col("pos"))
    entities = state.keep_longest(found, ["collection", "name"], "description", "entity_type", "seq").withColumn("id", F.xxhash64("collection", "name"))
    if known is not None:  # a known name keeps its id
        entities = entities.join(known.select("collection", "name", F.col("id").alias("_id")), ["collection", "name"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    named = entities.select("collection", "name", F.col("id").alias("entity_id"))
    mentions = state.first_rows(found.join(named, ["collection", "name"]).select("chunk_id", "entity_id", F.col("name").alias("mention_text"), "pos"), ["chunk_id", "entity_id"], ["pos"]).drop("pos")
    ends = entities.select("collection", "name", "id")
    if known is not None:
        ends = ends.unionByName(known.select("collection", "name", "id")).distinct()
    return entities, mentions, graph.resolve_relations(relations.join(of, "chunk_id"), ends)


def extract_in_batches(chunks: DataFrame, done: DataFrame, provider: Provider, batches: int = 10, known: DataFrame | None = None):
    """The same over parts of the chunks, so that what is finished survives a failure: yields (entities, mentions, relations, counts)."""
    for i in range(batches):
        part = chunks.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
        entities, mentions, relations = extract_graph(part, done, provider, known)
        entities = cut(entities)
        yield entities, mentions, relations, {"chunks": part.count(), "entities": entities.count(), "mentions": mentions.count(), "relations": relations.count()}
        ids = entities.select("collection", "name", "id")
        known = ids if known is None else known.select("collection", "name", "id").unionByName(ids).distinct()


def sample_relations(members: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """members: community, id; edges: id, source_id, target_id -> of each community the first n edges with both ends in it."""
    a = members.select("community", F.col("id").alias("source_id"))
    b = members.select("community", F.col("id").alias("target_id"))
    inside = edges.join(a, "source_id").join(b, ["community", "target_id"])
    return top_k(inside, [F.asc("id")], n, keys=["community"])


def summarise_communities(members: DataFrame, entities: DataFrame, provider: Provider, edges: DataFrame | None = None) -> DataFrame:
    """members: community, id -> community, summary, title, entity_count, from the ten most specific entities and, where edges (id,
    source_id, target_id, rel_type) are given, fifteen relations among them."""
    named = members.join(entities.select("id", "name", "description", "specificity"), "id")
    top = top_k(named, [F.desc("specificity"), F.asc("id")], 10, keys=["community"])
    texts = top.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", T.entity_text(F.col("name"), F.col("description")).alias("t")))).alias("r"))
    lines = F.transform("r", lambda x: x["t"])
    if edges is not None:
        some = sample_relations(top.select("community", "id"), edges)
        name = lambda end: entities.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
        told = some.join(name("source_id"), "source_id").join(name("target_id"), "target_id")
        told = told.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "_source_id", "rel_type", "_target_id").alias("t")))).alias("e"))
        texts = texts.join(told, "community", "left")
        lines = F.concat(lines, F.coalesce(F.transform("e", lambda x: x["t"]), F.array().cast("array<string>")))
    told = completions(texts, PROMPTS["summary"](lines), provider, "summary")
    n = members.groupBy("community").agg(F.count("*").alias("entity_count"))
    return told.join(n, "community").select("community", "summary", T.community_title(F.col("summary")).alias("title"), "entity_count")


def groundedness(answers: DataFrame, provider: Provider) -> DataFrame:
    """answers: query_id, answer_text, contexts (array) -> grounded and score; 400 characters a context, 2000 in all; 0 without a model."""
    context = F.substring(F.array_join(F.transform("contexts", lambda c: F.substring(c, 1, 400)), "\n"), 1, 2000)
    asked = completions(answers, PROMPTS["faithfulness"](F.col("answer_text"), context), provider)
    score = rating(F.col("answer"), 0.0, 1.0)
    return asked.select("query_id", score.alias("score"), (score >= 0.5).alias("grounded"))


def rewritten(queries: DataFrame, failed: DataFrame, provider: Provider) -> DataFrame:
    """queries: query_id, query_text; failed: query_id, rank, content -> the query in new words, or as it was."""
    snippets = failed.filter("rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, 150).alias("s")))).alias("r"))
    asked = completions(queries.join(snippets, "query_id", "left"), PROMPTS["rewrite"](F.col("query_text"), F.coalesce(F.array_join(F.transform("r", lambda x: x["s"]), "\n"), F.lit(""))), provider)
    return asked.select("query_id", F.when(T.strip(F.coalesce("answer", F.lit(""))) != "", T.strip(F.col("answer"))).otherwise(F.col("query_text")).alias("query_text"))


#: Verdicts on a claim.
SUPPORT = ("Fully Supported", "Partially Supported", "No Support")


def support(claims: DataFrame, provider: Provider) -> DataFrame:
    """claims: claim_id, claim, passages -> verdict; three passages of 400 characters; what isn't a verdict is No Support."""
    text = F.array_join(F.transform(F.slice("passages", 1, 3), lambda p: F.substring(p, 1, 400)), "\n")
    asked = completions(claims, F.concat(F.lit("Answer with one of " + ", ".join(SUPPORT) + ".\nClaim: "), "claim", F.lit("\nPassages: "), text), provider)
    verdict = F.lit(SUPPORT[-1])
    for v in SUPPORT[:-1]:
        verdict = F.when(F.lower("answer").contains(v.lower()), v).otherwise(verdict)
    return asked.select("claim_id", verdict.alias("verdict"))


#: What each kind of question asks, and the characters and passages it is given.
KINDS = {
    "extractive": ("Write a question whose answer stands in this passage word for word, and the answer, as JSON.\n", 3000, 1),
    "abstractive": ("Write a question that takes all of these passages to answer, and the answer, as JSON.\n", 1500, 3),
    "multi_hop": ("Write a question that links these passages over the names below, and the answer, as JSON.\n", 1200, 3),
}


def questions(passages: DataFrame, kinds: dict[str, int], provider: Provider, *, seed: str = "42", names: DataFrame | None = None) -> DataFrame:
    """passages: id, content. Extractive questions read one passage, the others three in the order of id; multi-hop ones also get the
    first eight of names. The passages are a sample: as many as the questions need, in an order that depends on key and seed
    alone; where fewer than three are left for a question, it takes others of the sample."""
    need = sum(n * KINDS.get(kind, KINDS["abstractive"])[2] for kind, n in kinds.items())
    rows = sorted((r.id, r.content) for r in evaluation.sample(passages.select("id", "content"), need, seed).collect())  # need rows
    spark, out, at = passages.sparkSession, [], 0
    listed = ", ".join(r["name"] for r in names.limit(8).collect()) if names is not None else ""
    for kind, n in kinds.items():
        told, chars, width = KINDS.get(kind, KINDS["abstractive"])
        for _ in range(n):
            part = rows[at : at + width]
            if len(part) < width:
                part = (part + rows)[:width]
            at += width
            if part:
                extra = f"Names: {listed}\n" if kind == "multi_hop" and listed else ""
                out.append((kind, told + extra + "\n".join((x[1] or "")[:chars] for x in part), [x[0] for x in part]))
    asked = spark.createDataFrame(out, "difficulty string, prompt string, source_chunk_ids array<long>")
    done = completions(asked, F.col("prompt"), provider)
    return done.select("difficulty", T.json_answer(F.col("answer")).alias("question_json"), "source_chunk_ids")


def adversarial_queries(chunks: DataFrame, n: int, provider: Provider, *, seed: str = "42") -> DataFrame:
    """Two hard queries for each of a sample of n / 2 chunks, n in all: target_id, query_text; without a model the chunk's first words and
    its last ones."""
    asked = completions(evaluation.sample(chunks, -(-n // 2), seed), PROMPTS["question"](F.col("content")), provider)
    w = T.words(F.col("content"))
    own = F.array(F.array_join(F.slice(w, 1, 8), " "), F.array_join(F.slice(F.reverse(w), 1, 8), " "))
    told = F.split(T.strip(F.coalesce("answer", F.lit(""))), "\n")
    texts = F.when(F.coalesce("answer", F.lit("")) == "", own).otherwise(F.slice(told, 1, 2))
    return asked.select(F.col("id").alias("target_id"), F.posexplode(texts).alias("pos", "query_text")).orderBy("pos", "target_id").limit(n).select("target_id", "query_text")


def full_cycle(chunks: DataFrame, n: int, search, provider: Provider, threshold: float, *, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """Hard queries, a blind-spot test with search (a query table -> query_id, id, rank, score), healing of what was missed:
    chunks with their prefixes, and the report by collection. chunks: id, collection, content, ..."""
    asked = cut(adversarial_queries(chunks.select("id", "content"), n, provider, seed=seed).withColumn("query_id", F.xxhash64("target_id", "query_text")))
    found = search(asked.select("query_id", "query_text")).withColumnRenamed("query_id", "test_id")
    tests = asked.select(F.col("query_id").alias("test_id"), "target_id")
    results = cut(evaluation.blind_spots(tests, found, threshold).join(tests, "test_id"))
    failed = results.filter("found = 0").join(asked.select(F.col("query_id").alias("test_id"), "query_text"), "test_id").select("target_id", "query_text")
    healed = heal_blind_spots(chunks, failed, provider)
    of = chunks.select(F.col("id").alias("target_id"), "collection")
    missed = failed.select("target_id").distinct().join(of, "target_id").select("collection", F.col("target_id").alias("chunk_id"))
    return healed, evaluation.cycle_report(results.join(of, "target_id"), missed)


def routed_by_model(queries: DataFrame, provider: Provider) -> DataFrame:
    """query_id, query_type, strategy, confidence: the model's JSON where it names a class, else the phrasing rules."""
    asked = completions(queries, F.concat(F.lit('Class of the query, one of ' + ", ".join(STRATEGIES) + ', as JSON {"query_type": "", "confidence": 0.0}: '), "query_text"), provider)
    told = F.from_json(T.json_answer(F.col("answer")), "query_type string, confidence double")
    rows = asked.withColumn("_told", told)
    own = query_class(F.col("query_text"))
    good = F.coalesce(F.col("_told.query_type").isin(list(STRATEGIES)), F.lit(False))
    strategy = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), F.col("_told.query_type"))
    confidence = F.coalesce(clamp(F.col("_told.confidence")), F.lit(0.5))
    return rows.select("query_id", F.when(good, F.col("_told.query_type")).otherwise(own["query_type"]).alias("query_type"), F.when(good, strategy).otherwise(own["strategy"]).alias("strategy"), F.when(good, confidence).otherwise(own["confidence"]).alias("confidence"))


def decomposed(queries: DataFrame, provider: Provider) -> DataFrame:
    """queries: query_id, query_text -> query_id, pos, query, query_type, depends_on; the query itself without a readable answer."""
    return sub_queries(completions(queries, PROMPTS["decompose"](F.col("query_text")), provider))


def hypotheses(queries: DataFrame, provider: Provider) -> DataFrame:
    """queries with hypothesis_vec, the vector of a passage that would answer; null without a model, so that the query's vector counts."""
    written = completions(queries, PROMPTS["hypothesis"](F.col("query_text")), provider, "_passage")
    return embeddings(written, F.when(F.coalesce("_passage", F.lit("")) != "", F.col("_passage")), provider, "hypothesis_vec").drop("_passage")


def rated_by_model(rows: DataFrame, provider: Provider, chars: int = 500, default: float = 5.0) -> DataFrame:
    """rows: query_text, content -> with relevance, 0 to 1: the model's rating from 0 to 10, the default where it gives none."""
    asked = completions(rows, PROMPTS["relevance"](F.col("query_text"), F.substring("content", 1, chars)), provider, "_rating")
    return asked.withColumn("relevance", rating(F.col("_rating"), default)).drop("_rating")


def graded_by_model(rows: DataFrame, provider: Provider) -> DataFrame:
    """rows: query_id, query_text, content -> by query: quality, level and action."""
    per = rated_by_model(rows, provider).groupBy("query_id").agg(F.round(F.avg("relevance"), 4).alias("quality"))
    return per.select("query_id", "quality", quality_level(F.col("quality")).alias("level"), corrective_action(F.col("quality")).alias("action"))


def passages_ranked(rows: DataFrame, provider: Provider, k: int, chars: int = 2000) -> DataFrame:
    """rows: query_id, query_text, id, content, rank -> ranked by the provider's order of each query's passages, as indexes from 0 in
    JSON; indexes out of range are dropped, and without an answer the order stays."""
    per = rows.groupBy("query_id", "query_text").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.substring("content", 1, chars).alias("t")))).alias("_r"))
    asked = completions(per, F.concat(F.lit("Order the passages by how well they answer, as a JSON array of indexes from 0.\nQuery: "), "query_text", F.lit("\n"), F.array_join(F.transform("_r", lambda x: x["t"]), "\n---\n")), provider)
    order = F.filter(F.coalesce(F.from_json("answer", "array<int>"), F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("_r")))
    order = F.array_distinct(order)
    order = F.when(F.size(order) > 0, order).otherwise(F.sequence(F.lit(0), F.size("_r") - 1))
    out = asked.select("query_id", "_r", F.posexplode(order).alias("_pos", "_i")).filter(F.col("_pos") < k)
    return out.select("query_id", F.get("_r", F.col("_i"))["id"].alias("id"), (F.col("_pos") + 1).alias("rank"))


def heal_blind_spots(chunks: DataFrame, failed: DataFrame, provider: Provider) -> DataFrame:
    """failed: target_id, query_text. A chunk that queries miss gets a prefix, from five of them at most, and is embedded anew."""
    w = top_k(failed, [F.asc("query_text")], 5, keys=["target_id"])
    asked = w.groupBy("target_id").agg(F.array_sort(F.collect_list("query_text")).alias("q"))
    told = completions(asked, F.concat(F.lit("Write one sentence that a passage needs to be found by: "), F.array_join("q", "; ")), provider)
    prefix = F.when(F.coalesce("answer", F.lit("")) == "", F.array_join("q", "; ")).otherwise(F.col("answer"))
    return state.heal(chunks, told.select(F.col("target_id").alias("chunk_id"), prefix.alias("prefix")))


def image_chunks(images: DataFrame, provider: Provider) -> DataFrame:
    """images: document_id, name, content -> chunks with a description of each image, at indexes from -1000 down."""
    from pyspark.sql import Window as W

    @F.pandas_udf("string")
    def describe(name: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([provider.describe_image(n, c) for n, c in zip(name, content)])

    at = F.row_number().over(W.partitionBy("document_id").orderBy("name"))
    rows = images.withColumn("chunk_index", (-1000 - (at - 1)).cast("int")).withColumn("text", describe("name", "content"))
    words = F.regexp_count("text", F.lit(r"\S+")).cast("int")
    return rows.select("document_id", "chunk_index", F.col("text").alias("content"), F.lit("image").alias("content_type"), words.alias("token_count"), F.to_json(F.struct(F.col("name").alias("image_source"))).alias("chunk_metadata"))


def describe_tables(chunks: DataFrame, provider: Provider) -> DataFrame:
    """Table chunks with a description as their prefix; an empty answer changes nothing."""
    tables = chunks.filter("content_type = 'table'")
    told = completions(tables, F.concat(F.lit("Describe this table: "), F.substring("content", 1, 2000)), provider)
    return told.filter(F.coalesce("answer", F.lit("")) != "").select(F.col("id").alias("chunk_id"), F.substring("answer", 1, 2000).alias("prefix"))
