"""Unit tests of functions and operators, with null and empty inputs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import evaluation, feedback, graph, retrieval, state
from tessera.plans import pipeline
from tessera.providers import Chain, HashEmbedding, Provider, completions, embeddings, rating
from tessera.sources import files


def block(content, kind="text", atomic=False):
    return {"content": content, "content_type": kind, "heading_path": ["Test Section"], "context_prefix": "Test > Test Section", "inherited_screens": [], "atomic": atomic, "preserve_ws": False}


SENTENCE = "The quick brown fox jumps over the lazy dog near the river bank. "


class TestChunker:
    def test_noise_gives_nothing(self):
        assert C.chunk_document([block("THIS PAGE INTENTIONALLY LEFT BLANK")]) == []

    def test_small_is_dropped_unless_atomic(self):
        assert C.chunk_document([block("Too short.")]) == []
        assert len(C.chunk_document([block("Short but atomic.", "field_definition", True)])) == 1

    def test_normal_is_one(self):
        out = C.chunk_document([block(SENTENCE * 10)])
        assert len(out) == 1 and SENTENCE[:50] in out[0].text

    def test_long_is_split_within_limit(self):
        out = C.chunk_document([block(SENTENCE * 300)])
        assert len(out) > 2 and all(c.token_count <= 1020 for c in out)

    def test_overlap(self):
        out = C.chunk_document([block("\n".join(f"Line {i}: " + SENTENCE for i in range(200)))])
        assert len(out) > 1 and out[0].text.split("\n")[-1] in out[1].text

    def test_atomic_stays_whole(self):
        assert len(C.chunk_document([block("word " * 2000, "definition", True)])) == 1

    def test_prefix_is_inherited(self):
        assert {c.context_prefix for c in C.chunk_document([block("content " * 60)])} == {"Test > Test Section"}

    def test_table_keeps_every_row_and_repeats_header(self):
        text = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row{i} | some cell text here |" for i in range(500))
        out = C.chunk_document([block(text, "table")])
        assert len(out) > 1 and all(c.text.startswith("| a | b |") and c.token_count <= 1300 for c in out)
        assert sum(c.text.count("some cell") for c in out) == 500

    def test_small_neighbours_merge(self):
        out = C.chunk_document([block("word " * 50), block("other " * 50)])
        assert len(out) == 1 and out[0].token_count == C.tokens(out[0].text)

    def test_null_content(self):
        assert C.chunk_document([block(None)]) == []


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,kind,strategy", [("what is screen 207", "specific_factoid", "hybrid"), ("how does the Job Control Number relate to the Work Unit Code", "multi_hop", "multi_hop"), ("overview of maintenance management", "global_thematic", "kg_global"), ("", "specific_factoid", "hybrid")])
def test_router(spark, text, kind, strategy):
    r = spark.createDataFrame([(text,)], "q string").select(*[c.alias(k) for k, c in S.query_class(F.col("q")).items()]).first()
    assert (r.query_type, r.strategy) == (kind, strategy)


@pytest.mark.parametrize("q,level,action", [(0.9, "correct", "use_as_is"), (0.8, "correct", "use_as_is"), (0.79, "ambiguous", "supplement"), (0.5, "ambiguous", "supplement"), (0.49, "incorrect", "rewrite_query"), (0.0, "incorrect", "rewrite_query")])
def test_quality(spark, q, level, action):
    r = spark.range(1).select(S.quality_level(F.lit(q)).alias("l"), S.corrective_action(F.lit(q)).alias("a")).first()
    assert (r.l, r.a) == (level, action)


def test_rrf(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 2, 1), (1, 4, 2), (1, 2, 1), (1, 5, 2)], "query_id long, id long, rank int")
    rows = retrieval.fuse(lists, 60, 10).orderBy("rank").collect()
    assert [r.id for r in rows][0] == 2 and {r.id for r in rows} == {1, 2, 3, 4, 5}
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 2 / 61, abs=1e-8)
    assert retrieval.fuse(lists.filter("false"), 60, 10).count() == 0
    assert retrieval.fuse(lists.orderBy(F.desc("id")), 60, 10).orderBy("rank").collect() == rows


def test_score_components(spark):
    c = S.score_components(F.lit(1), F.lit(1), F.lit(0.05), F.lit(0.5), F.lit(1.0))
    r = spark.range(1).select(*[x.alias(k) for k, x in c.items()]).first()
    assert r.keyword_rrf == r.vector_rrf == round(1 / 61, 8) and r.composite > 0
    c = S.score_components(F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("double"), F.lit(7.0), F.lit(-1.0))
    r = spark.range(1).select(*[x.alias(k) for k, x in c.items()]).first()
    assert (r.kg_score, r.utility_score, r.rerank_score) == (0.0, 1.0, 0.0) and r.keyword_rrf == round(1 / 1059, 8)


def test_utility(spark):
    uses = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 1, 0.0), (3, 1, 1, None), (3, 2, 2, 5.0)], "chunk_id long, ts long, seq long, contribution double")
    got = {r.chunk_id: r.utility_ema for r in feedback.utility_ema(uses).collect()}
    assert got[1] == pytest.approx(0.575) and got[2] < 0.5 and got[3] == pytest.approx(0.85 * 0.575 + 0.15)


def test_entities(spark):
    text = "This screenshot shows Screen 207 of the IMDS system. The field labeled Work Order Number is required. Equipment code OAR-261 must be entered before proceeding."
    found = one(spark, T.entities(F.col("t")), t=text)
    assert any("207" in x for x in found) and "OAR-261" in found


def test_text_of_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(T.clean(F.col("t")).alias("a"), T.is_parser_noise(F.col("t")).alias("b"), T.simplified(F.col("t")).alias("c")).first()
    assert r.a is None and r.b is None


def test_nfkc(spark):
    assert one(spark, T.clean(F.col("t"), nfkc=True), t="ﬁne ½") == "fine 1⁄2"


def test_tokens(spark):
    assert one(spark, T.count_tokens(F.col("t")), t="") == 1 and one(spark, T.count_tokens(F.col("t"), 0), t=" ") == 0 and one(spark, T.count_tokens(F.col("t")), t="a b\tc") == 3


def test_corrective_replaces_off_topic_rows(spark):
    rows = spark.createDataFrame([(1, "alpha beta", 1, "nothing here"), (1, "alpha beta", 2, "also off")], "query_id long, query_text string, id long, content string")
    v = feedback.graded(rows).first()
    assert v.quality < 0.5 and v.action == "rewrite_query"
    first = rows.select("query_id", "id", F.col("id").cast("int").alias("rank"))
    second = spark.createDataFrame([(1, 9, 1)], "query_id long, id long, rank int")
    assert [r.id for r in feedback.corrected(first, second, feedback.graded(rows)).collect()] == [9]
    assert {r.id for r in feedback.corrected(first, second.filter("false"), feedback.graded(rows)).collect()} == {1, 2}


def test_adaptive_searches_again(spark):
    rows = spark.createDataFrame([(1, "what is alpha", 1, "what is alpha", 1), (2, "tell me more", 5, "x", 1)], "query_id long, query_text string, id long, content string, rank int")
    more = lambda q: q.withColumns({"id": F.lit(7).cast("long"), "content": F.lit("alpha is what"), "rank": F.lit(1)})
    got = {(r.query_id, r.id) for r in feedback.adaptive(rows, more).collect()}
    assert got == {(1, 1), (1, 7), (2, 5)}


def test_ppr_mass_and_tolerance(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, None), (3, 3, 0.0)], "source_id long, target_id long, weight double")
    seeds = spark.createDataFrame([(1, 1), (1, 99)], "query_id long, id long")
    r = graph.pagerank(e, seeds, iterations=40)
    assert r.agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-6)
    assert graph.pagerank(e, seeds.filter("id = 99"), iterations=3).count() == 0


def test_louvain_finds_two_cliques():
    ids = np.arange(8)
    pairs = [(i, j) for g in (0, 4) for i in range(g, g + 4) for j in range(i + 1, g + 4)] + [(3, 4)]
    a, b = np.array(pairs).T
    label = graph.louvain(ids, a, b, np.ones(len(a)), 1.0)
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[7]


def test_similar_pairs_across_blocks(spark):
    rng = np.random.RandomState(0)
    v = rng.randn(60, 8)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [0.0] * 8)], "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 6) >= 0.4}
    assert {(r.a, r.b) for r in graph.similar_pairs(df, 0.4, block=13).collect()} == want


def test_state_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "c", "h1")], "id long, collection string, file_hash string")
    chunks = spark.createDataFrame([(10, 1), (11, 2)], "id long, document_id long")
    left, kept = state.replace_documents(docs, chunks, docs)
    assert left.count() == 1 and [r.id for r in kept.collect()] == [11]
    assert state.without(docs, docs, ["id"]).count() == 0


def test_containment(spark):
    df = spark.createDataFrame([('{"a": {"b": ["1", "2"]}, "n": 3, "t": true}',), (None,), ("bad",)], "j string")
    has = lambda x: [r.x for r in df.select(F.coalesce(state.contains(F.col("j"), x), F.lit(False)).alias("x")).collect()]
    assert has({"a": {"b": ["2"]}}) == [True, False, False] and has({"a": {"b": ["3"]}})[0] is False and has({"n": 3, "t": True})[0] is True


def test_metrics(spark):
    flags = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "query_id long, rank int, relevant int")
    got = {r.query_id: r.context_precision for r in evaluation.context_precision(flags).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2, abs=1e-4), 2: 0.0}
    assert evaluation.allocation(10, {"extractive": 1, "abstractive": 1, "multi_hop": 1}) == {"extractive": 3, "abstractive": 4, "multi_hop": 3}
    bar = spark.range(1).select(evaluation.metric_bar(F.lit(0.5)).alias("x")).first().x
    assert bar == "#" * 10 + "." * 10 + " 0.5000"


def test_config():
    assert config.substitute({"a": ["${X}", 1]}, {"X": "y"}) == {"a": ["y", 1]}
    with pytest.raises(ValueError):
        config.substitute("${NOT_SET}", {})
    assert config.read_dotenv("A=1\n# c\nB='2'", {"A": "0"}) == {"A": "0", "B": "2"}
    assert config.Settings.of({"overlap_tokens": 7, "x": 1}).overlap_tokens == 7


def test_stages():
    assert pipeline.stages(no_llm=True) == ["parse", "embed", "parents"]
    with pytest.raises(ValueError):
        pipeline.stages("parse,nope")
    tables, errors = pipeline.ingest({}, {"parse": lambda t: {"a": 1}, "embed": lambda t: 1 / 0})
    assert tables == {"a": 1} and list(errors) == ["embed"]


def test_providers(spark):
    class Broken(Provider):
        def complete(self, *a, **k):
            raise RuntimeError

    class Says(Provider):
        def complete(self, prompt, *a, **k):
            return f"7 of {prompt}"

    assert Chain(Broken(), Provider(), Says()).complete("x") == "7 of x" and Chain().complete("x") == ""
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    r = completions(df, F.col("t"), Provider()).collect()
    assert r[0].answer == "" and r[1].answer is None
    v = embeddings(df, F.col("t"), HashEmbedding(8)).collect()
    assert sum(x * x for x in v[0].embedding) == pytest.approx(1.0, abs=1e-5) and v[1].embedding is None
    got = spark.range(1).select(rating(F.lit("score: 7"), 5.0).alias("a"), rating(F.lit("?"), 5.0).alias("b"), rating(F.lit("99"), 5.0).alias("c")).first()
    assert (got.a, got.b, got.c) == (0.7, 0.5, 1.0)


def test_files(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    for name in ("a.md", "b.TXT", "c.exe", "skip/d.md"):
        (tmp_path / name).write_text("# T\nbody text\n")
    found = files.discover(spark, str(tmp_path), exclude_dirs=["skip"])
    assert sorted(r.file_name for r in found.collect()) == ["a.md", "b.TXT"]
    new = state.new_files(found.withColumn("collection", F.lit("c")), spark.createDataFrame([], "collection string, file_hash string"))
    assert new.count() == 2
    bad = files.binary_blocks(spark.createDataFrame([("x.pdf", b"nope", "pdf")], "path string, content binary, parser string")).first()
    assert "parse error" in bad.content
    assert files.table_markdown([["a", "b"], ["1"]]) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_watch_folder(spark, tmp_path):
    from tessera.streaming.utility import watch_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    (tmp_path / "in/b.txt").write_text("one")
    seen = []
    for _ in range(2):
        watch_folder(spark, str(tmp_path / "in"), lambda df, epoch: seen.extend(r.file_hash for r in df.collect()), str(tmp_path / "check"), every=None).awaitTermination()
        (tmp_path / "in/c.txt").write_text("two")
    assert len(seen) == len(set(seen)) == 2


class TestStrategies:
    def corpus(self, spark):
        chunks = spark.createDataFrame([(i, f"alpha beta word{i}", [float(i == k) for k in range(4)]) for i in range(4)], "id long, content string, embedding array<float>")
        queries = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0, 0.0, 0.0])], "query_id long, query_text string, query_vec array<float>")
        return chunks, queries

    def test_kg_local_and_fallback(self, spark):
        from tessera.plans import strategies as P

        chunks, queries = self.corpus(spark)
        edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "source_id long, target_id long, weight double")
        entities = chunks.select("id", "embedding", F.lit(0.5).alias("specificity"))
        mentions = spark.createDataFrame([(10, 0), (11, 1)], "chunk_id long, entity_id long")
        utility = spark.createDataFrame([(11, 0.9)], "chunk_id long, utility_ema double")
        hybrid = P.hybrid(chunks, 2)
        run = P.kg_local(entities, edges, mentions, utility, 2, hybrid)
        assert [r.id for r in run(queries).orderBy("rank").collect()] == [11, 10]
        none = P.kg_local(entities, edges.filter("false"), mentions, utility, 2, hybrid)
        assert {r.id for r in none(queries).collect()} == {r.id for r in hybrid(queries).collect()}

    def test_global_tree_compound_dispatch(self, spark):
        from tessera.plans import strategies as P

        chunks, queries = self.corpus(spark)
        communities = spark.createDataFrame([(1, "s", [1.0, 0.0, 0.0, 0.0]), (2, "", [1.0, 0.0, 0.0, 0.0])], "id long, summary string, summary_embedding array<float>")
        hybrid = P.hybrid(chunks, 4)
        rows = P.kg_global(communities, hybrid, 4)(queries).orderBy("rank").collect()
        assert (rows[0].source, rows[0].id, len(rows)) == ("community", 1, 4)
        assert P.tree(chunks, 2)(queries).count() == 2
        split = lambda q: q.select("query_id", F.posexplode(F.split("query_text", " ")).alias("pos", "query"), "query_vec")
        ways = {"hybrid": hybrid, "kg_global": P.kg_global(communities, hybrid, 4)}
        for s in (P.multi_hop(split, hybrid, 3), P.compound(split, ways, 3)):
            assert [r.rank for r in s(queries).orderBy("rank").collect()] == [1, 2, 3]
        assert P.dispatch(queries.withColumn("strategy", F.lit("odd")), ways).count() == hybrid(queries).count()


def test_model_steps(spark):
    from tessera.operators import model_steps as M

    class Says(Provider):
        def __init__(self, text):
            self.text = text

        def complete(self, *a, **k):
            return self.text

    chunks = spark.createDataFrame([(1, 7, "c", "alpha beta gamma", None, "table", None), (2, 7, "c", "delta", "p", "text", [1.0])], "id long, document_id long, collection string, content string, context_prefix string, content_type string, embedding array<float>")
    assert M.embed_missing(chunks, HashEmbedding(4)).filter("embedding IS NOT NULL").count() == 2
    docs = spark.createDataFrame([(7, "whole text", "title")], "document_id long, text string, title string")
    none = spark.createDataFrame([(2,)], "chunk_id long")
    assert [r.context_text for r in M.contextualise(chunks, docs, none, Says("ctx")).collect()] == ["ctx"]
    e, m, r = M.extract_graph(chunks, none, Says('{"entities": [{"name": "A"}, {"name": "B"}], "relationships": [{"source": "A", "target": "B"}]}'))
    assert (e.count(), m.count(), r.count()) == (2, 2, 1)
    assert M.extract_graph(chunks, none, Provider())[0].count() == 0
    s = M.summarise_communities(m.select(F.lit(1).cast("long").alias("community"), F.col("entity_id").alias("id")), e.withColumn("specificity", F.lit(1.0)), Says("One. Two")).first()
    assert (s.title, s.entity_count) == ("One", 2)
    a = spark.createDataFrame([(1, "ans", ["x"])], "query_id long, answer_text string, contexts array<string>")
    assert M.groundedness(a, Says("0.9")).first().grounded and not M.groundedness(a, Provider()).first().grounded
    q = spark.createDataFrame([(1, "old")], "query_id long, query_text string")
    f = spark.createDataFrame([(1, 1, "snippet")], "query_id long, rank int, content string")
    assert M.rewritten(q, f, Says(" new ")).first().query_text == "new" and M.rewritten(q, f, Provider()).first().query_text == "old"
    c = spark.createDataFrame([(1, "claim", ["p"])], "claim_id long, claim string, passages array<string>")
    assert M.support(c, Says("fully supported")).first().verdict == "Fully Supported" and M.support(c, Provider()).first().verdict == "No Support"
    p = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "id long, content string")
    assert sorted(len(r.source_chunk_ids) for r in M.questions(p, {"extractive": 1, "abstractive": 2}, Provider()).collect()) == [1, 3, 3]
    assert M.adversarial_queries(chunks, 3, Provider()).count() == 3
    healed = {r.id: r for r in M.heal_blind_spots(chunks, spark.createDataFrame([(2, "q1")], "target_id long, query_text string"), Provider()).collect()}
    assert healed[2].context_prefix == "q1" and healed[2].embedding is None and healed[1].context_prefix is None
    images = spark.createDataFrame([(7, "diagram.png", b"x")], "document_id long, name string, content binary")
    i = M.image_chunks(images, Provider()).first()
    assert i.chunk_index == -1000 and "diagram.png" in i.content
    assert M.describe_tables(chunks, Says("d")).count() == 1 and M.describe_tables(chunks, Provider()).count() == 0


def test_sinks(spark, tmp_path):
    from tessera.operators import sinks

    df = spark.createDataFrame([(1, "é")], "id long, t string")
    sinks.append(df, str(tmp_path / "log"))
    sinks.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == '{"id":1,"t":"é"}'
    for n in ("a", "b"):
        sinks.write_report(df, str(tmp_path / "reports"), n)
    assert sinks.newest_reports(spark, str(tmp_path / "reports"), 1).count() == 1
    assert spark.read.parquet(sinks.swap(df, str(tmp_path / "snap"), 1)).count() == 1


def docx(parts, styles):
    """A DOCX file of paragraphs (style id, text) and tables (rows of cells)."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>'
    cell = lambda c: f"<w:tc>{p('x', c)}</w:tc>"
    body = "".join(p(*x) if isinstance(x, tuple) else "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in x) + "</w:tbl>" for x in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>" + "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in styles.items()) + "</w:styles>")
        z.writestr("word/media/a.png", b"png")
    return out.getvalue()


class TestDocuments:
    styles = {"h1": "heading 1", "h2": "Heading 2", "t": "Title", "q": "Quote", "b": "Body Text", "l": "List Number", "c": "Code", "toc": "toc 1", "x": "Normal"}

    def blocks(self, parts):
        from tessera.sources.documents import parse_binary

        return [(b["content_type"], b["content"], [h["text"] for h in b["heading_path"]]) for b in parse_binary(docx(parts, self.styles), "docx", "doc")]

    def test_roles(self):
        got = self.blocks([("h1", "One"), ("x", "a"), ("x", "b"), ("l", "step 1"), ("l", "step 2"), ("x", "c"), ("q", "Term"), ("b", "its text"), ("b", "more"), ("b2", "d"), ("c", "  code  "), ("c", "x"), ("toc", "skipped"), ("h2", "Two"), [["k", "v"], ["1"], ["same", "same"]], ("b", "plain here"), ("h1", "Three"), ("x", "12"), ("x", "e"), ("q", "alone")])
        assert got == [
            ("text", "a\nb", ["One"]), ("procedure", "step 1\nstep 2", ["One"]), ("text", "c", ["One"]), ("definition", "Term\nits text\nmore", ["One"]), ("text", "d", ["One"]), ("screen_print", "  code  ", ["One"]), ("screen_print", "x", ["One"]),
            ("table", "| k | v |\n| --- | --- |\n| 1 |  |\n| same | same |", ["One", "Two"]), ("text", "plain here", ["One", "Two"]), ("text", "12\ne", ["Three"]), ("definition", "alone", ["Three"]),
        ]

    def test_in_spark(self, spark):
        from tessera.sources import files

        df = spark.createDataFrame([("/in/My file.docx", docx([("t", "T"), ("x", "body")], self.styles), "docx"), ("/in/bad.docx", b"nope", "docx")], "path string, content binary, parser string")
        rows = {(r.path, r.block_index): r for r in files.binary_blocks(df).collect()}
        assert rows["/in/My file.docx", 0].context_prefix == "My file > T" and rows["/in/My file.docx", 0].heading == "T" and "DOCX parse error" in rows["/in/bad.docx", 0].content
        images = files.document_images(df.filter("path LIKE '%My%'").selectExpr("1L AS document_id", "content")).collect()
        assert [(r.name, bytes(r.content)) for r in images] == [("a.png", b"png")]

    def test_pages_have_tables(self):
        from tessera.sources.documents import _page_blocks

        got = _page_blocks(3, " text ", [[["a", None], [1, 2]], [["only a header"]]], "f")
        assert [b["content"] for b in got] == ["text", "| a |  |\n| --- | --- |\n| 1 | 2 |"] and got[0]["context_prefix"] == "f > Page 3"
        assert _page_blocks(1, "12", [], "f") == []

    def test_encodings(self, spark):
        from tessera.sources import files

        texts = ["plain é", "naïve café"]
        raw = [texts[0].encode(), texts[1].encode("cp1252"), texts[1].encode("utf-16"), texts[0].encode("utf-16-le"), b"\xef\xbb\xbfx"]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i long, c binary")
        got = [r.t.lstrip("\ufeff") for r in df.orderBy("i").select(files.decoded_text(F.col("c")).alias("t")).collect()]
        assert got == [texts[0], texts[1], texts[1], texts[0], "x"]


def test_transports():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tessera.providers import Chain, ChatCompletions, Generate, Messages, complete_json

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("Authorization"), self.headers.get("x-api-key")))
            answers = {"/v1/chat/completions": {"choices": [{"message": {"content": 'x {"a": 1} y'}}]}, "/v1/api/generate": {"response": "generated"}, "/v1/messages": {"content": [{"text": "mess"}, {"text": "age"}]}}
            self.send_response(200 if self.path in answers else 500)
            self.end_headers()
            self.wfile.write(json.dumps(answers.get(self.path, {})).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    chat, plain, messages = ChatCompletions(url, "m", "k"), Generate(url, "m"), Messages(url, "m", "k")
    assert complete_json(chat, "p", "s") == {"a": 1} and complete_json(plain, "p") == {} and messages.complete("p") == "message"
    assert asked[0][1]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}] and asked[0][2] == "Bearer k" and asked[2][3] == "k" and asked[1][2] is None
    assert Chain(ChatCompletions(f"{url}/nowhere", "m"), plain).complete("p") == "generated"
    server.shutdown()


def test_stream_upserts_over_three_files(spark, tmp_path):
    from tessera.streaming import utility as U

    schema = "chunk_id long, ts timestamp, seq long, contribution double"
    source, at = str(tmp_path / "in"), str(tmp_path / "table")
    stream = lambda: U.upserted(U.running_utility(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), ["chunk_id"], at, str(tmp_path / "progress")).awaitTermination()
    want, n = {}, 0
    for part in ([(1, 1.0), (2, 0.0)], [(1, 0.2), (3, None)], [(2, 1.0), (1, 1.0)]):
        rows = [(c, datetime.datetime(2024, 1, 1), n + i, x) for i, (c, x) in enumerate(part)]
        n += len(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for c, x in part:
            want[c] = 0.85 * want.get(c, 0.5) + 0.15 * (1.0 if x is None else x)
        stream()
        got = U.current(spark, at, "chunk_id long, utility_ema double, use_count long").collect()
        assert len(got) == len(want) and all(abs(r.utility_ema - want[r.chunk_id]) < 1e-9 for r in got)


def test_background_cycles(spark, tmp_path):
    import time

    from tessera.streaming import utility as U

    runs = []

    def cycle(n):
        runs.append(n)
        if n == 0:
            raise ValueError("the first one fails")

    q = U.background(spark, cycle, "1 second", str(tmp_path / "progress"))
    began = time.time()
    while len(runs) < 2 and time.time() - began < 60:
        time.sleep(0.2)
    q.stop()
    assert len(runs) >= 2


def test_model_answers_are_used(spark):
    from tessera.operators import model_steps as M
    from tessera.providers import Provider

    class Says(Provider):
        def __init__(self, text):
            self.text = text

        def complete(self, prompt, system="", max_tokens=2000):
            return self.text

    q = spark.createDataFrame([(1, "what is x")], "query_id long, query_text string")
    r = M.routed_by_model(q, Says('{"query_type": "multi_hop", "confidence": 0.9}')).first()
    assert (r.query_type, r.strategy, r.confidence) == ("multi_hop", "multi_hop", 0.9)
    assert M.routed_by_model(q, Says('{"query_type": "odd"}')).first().query_type == "specific_factoid"
    subs = M.decomposed(q, Says('{"sub_queries": [{"query": "a"}, {"query": "b", "depends_on": 0}]}')).orderBy("pos").collect()
    assert [s.query for s in subs] == ["a", "b"]
    rows = spark.createDataFrame([(1, "q", i, f"text {i}", i) for i in range(1, 4)], "query_id long, query_text string, id long, content string, rank int")
    assert [(r.id, r["rank"]) for r in M.passages_ranked(rows, Says("[2, 9, 0]"), 5).orderBy("rank").collect()] == [(3, 1), (1, 2)]
    assert M.graded_by_model(rows, Says("9")).first().level == "correct"
    known = spark.createDataFrame([("c", "Old", 7)], "collection string, name string, id long")
    chunks = spark.createDataFrame([(1, "c", "text")], "id long, collection string, content string")
    none = spark.createDataFrame([], "chunk_id long")
    says = Says('{"entities": [{"name": "New"}], "relationships": [{"source": "New", "target": "Old"}]}')
    assert [r.target_id for r in M.extract_graph(chunks, none, says, known)[2].collect()] == [7]
    assert sum(c["relations"] for *_, c in M.extract_in_batches(chunks, none, says, 2, known)) == 1


def test_pipeline_goes_the_way_it_logs(spark):
    from tessera.plans.pipeline import Corpus, run_queries

    v = [[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]]
    chunks = spark.createDataFrame([(i, f"overview of pump text {i}", v[i % 3]) for i in range(6)], "id long, content string, embedding array<float>")
    none = spark.createDataFrame([], "chunk_id long, utility_ema double")
    links, parents = spark.createDataFrame([(0, 9)], "chunk_id long, parent_id long"), spark.createDataFrame([(9, "whole")], "id long, content string")
    communities = spark.createDataFrame([(4, "overview of pump text", [1.0, 0.0])], "id long, summary string, summary_embedding array<float>")
    q = spark.createDataFrame([(1, "overview of pump", [1.0, 0.0]), (2, "what is pump", [0.0, 1.0])], "query_id long, query_text string, query_vec array<float>")
    out = run_queries(q, Corpus(chunks, none, links, parents, communities=communities))
    assert {r.query_id: r.strategy for r in out["log"].collect()} == {1: "kg_global", 2: "hybrid"}
    ids = {(r.query_id, r.id) for r in out["results"].collect()}
    assert (1, -9) in ids and not any(i < 0 for n, i in ids if n == 2)
    assert {r.query_id: r.strategy for r in run_queries(q, Corpus(chunks, none, links, parents))["log"].collect()} == {1: "hybrid", 2: "hybrid"}


def test_vector_search_in_blocks(spark, monkeypatch):
    from tessera.operators import retrieval as R

    rng = np.random.RandomState(2)
    df = spark.createDataFrame([(i, rng.rand(8).tolist()) for i in range(300)] + [(300, rng.rand(5).tolist())], "id long, embedding array<double>")
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    want = {(r.query_id, r.id, r["rank"]) for r in R.vector_search(q, df, 4).collect()}
    monkeypatch.setattr(R, "MAX_BROADCAST_QUERIES", 10)
    monkeypatch.setattr(R, "QUERY_BLOCK", 64)
    assert {(r.query_id, r.id, r["rank"]) for r in R.vector_search(q, df, 4).collect()} == want
