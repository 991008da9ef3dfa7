"""The operators against brute force, libraries and edge cases."""

import hashlib
import html
import json
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, html_extraction, line_dedup, lm, minhash, packing, quality_rules, token_counts, url_filters
from tessera.llm.common import HOT_SHARE, lookup, word_hashes
from tessera.llm.queries import TOKENIZERS, oracle_sql, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def docs_of(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def odd_rows():
    words = [f"word{i}" for i in range(60)]
    base = " ".join(words)
    near = " ".join(words[:-1] + ["other"])
    line = "A line that many documents share."
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "a"), (5, "one two", "b"), (6, base, "a"), (7, base.upper(), "b"), (8, near, "b"), (8, near, "b"), (9, base + " \n", "a"), (None, base, "a"), (10, "x" * 200_000, "a"), (11, (base + " ") * 40, "b")]
    rows += [(20 + i, f"{line}\nown text number {i} is here\n  {line.lower()} ", "hot") for i in range(6)]
    return rows + [(40 + i, base, "hot") for i in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_brute(rows):
    """rows: (doc_id, text) -> doc_id: component"""
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i] |= {shingle_set(t)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, shared = defaultdict(set), Counter()
    for i, ss in sets.items():
        for s in ss:
            for x in s:
                where[x].add(i)
    for ids in where.values():
        shared.update(combinations(sorted(ids), 2))
    for a, b in shared:
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: root(i) for i in sets}


def test_word_hashes():
    data = b" a bb\tccc\n a  " + b" ".join(b"w%d" % (i % 300) for i in range(30_000))
    starts, ends, h = word_hashes(data)
    assert [data[s:e] for s, e in zip(starts, ends)] == data.split()
    of = {}
    assert all(of.setdefault(data[s:e], x) == x for s, e, x in zip(starts, ends, h.tolist())) and len(set(of.values())) == len(of)


def test_lookup_hot_and_cold(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3 * HOT_SHARE)] + [(-1, None)], "id long, k string")
    right = left.filter("k is not null AND k <> 'k0'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = {r.id: r.m for r in lookup(left, right, "k", "n").collect()}
    assert len(got) == 3 * HOT_SHARE + 1 and got[-1] is None and got[0] is None and got[3] == 3 and got[1] == 3 * HOT_SHARE - 1


class TestUrls:
    @pytest.mark.parametrize(
        "url,host,path,rule",
        [
            ("http://A.Org/X?y", "a.org", "/X", "org/"), ("https://sub.example.org/es/1", "sub.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12#z", "example.org", "/en/12", "example.org/en/1"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
            ("http://x.com/fr/", "x.com", "/fr/", "com/fr/"), ("http://x.com/de/a?b", "x.com", "/de/a", "com/de/"), ("http://x.com/de", "x.com", "/de", None), ("http://x.org", "x.org", "", None), ("no scheme", "", "", None), (None, "", "", None), ("http://x.com?a/fr/", "x.com", "", None), ("http://com/fr/a", "com", "/fr/a", "com/fr/"),
        ],
    )
    def test_rules(self, spark, url, host, path, rule):
        r = url_filters.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == url_filters.RULES[rule]

    def test_template_learns_from_labels(self, spark):
        rows = [(i, f"http://site.com/de/{i}") for i in range(60)] + [(100 + i, f"http://site.com/fr/{i}") for i in range(60)] + [(300 + i, f"http://site.com/*/{i}/a/b/c/d") for i in range(5)]
        got = {r.page_id: r for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
        assert len(got) == 125 and got[5].template == "site.com/de/*" and got[105].template == "site.com/fr/*" and got[5].purity > 0.9 > 0.1 > got[105].purity

    def test_tree_equals_brute_force(self, spark):
        """Deep branches, branches that are merged with one another, ids that become wildcards."""
        rng = np.random.RandomState(4)
        rows = []
        for i in range(1500):
            branch, rate = [("spam", 0.97), ("junk", 0.96), ("news", 0.03), ("x/y/z/w/bad", 0.95), ("x/y/z/w/fine", 0.02), ("mix", 0.5)][rng.randint(6)]
            label = None if rng.rand() < 0.3 else int(rng.rand() < rate)
            rows.append((["a.com", "b.com"][rng.randint(2)], f"/{branch}/{i}", label))
        got = {(r.host, r.path): (r.template, r.purity) for r in url_filters.path_templates(spark.createDataFrame(rows, "host string, path string, label int")).collect()}

        def differs(n, bad, m, bad_m, tests):
            q = (bad_m + 1) / (m + 2)
            off = abs(bad - n * q) - 0.5
            return n > 0 and m > 0 and off > 0 and off * off > (url_filters.Z**2 + 2 * np.log(tests)) * n * q * (1 - q)

        want = {}

        def grow(paths, template, depth, purity):
            known, bad = sum(x[2] is not None for x in paths), sum(x[2] or 0 for x in paths)
            purity = (bad + url_filters.PRIOR * purity) / (known + url_filters.PRIOR)
            more = [x for x in paths if len(x[1].split("/")) - 1 > depth]
            mixed = 0 < bad < known
            for x in paths:
                if x not in more or not mixed:
                    want[x[0], x[1]] = (template + "/*" if x in more else template, purity)
            if not mixed or not more:
                return
            children = defaultdict(list)
            for x in more:
                children[x[1].split("/")[depth + 1]].append(x)
            counts = {s: (sum(x[2] is not None for x in v), sum(x[2] or 0 for x in v)) for s, v in children.items()}
            n, b = map(sum, zip(*counts.values()))
            apart = sorted((s for s, (k, y) in counts.items() if 0 < b < n and differs(k, y, n - k, b - y, len(counts))), key=lambda s: ((counts[s][1] + 1) / (counts[s][0] + 2), s))
            groups = []
            for s in apart:
                if groups and not differs(*counts[s], *counts[groups[-1][-1]], 1):
                    groups[-1].append(s)
                else:
                    groups.append([s])
            rest = [x for s, v in children.items() if s not in apart for x in v]
            for g in groups:
                grow([x for s in g for x in children[s]], f"{template}/{g[0] if len(g) == 1 else '(' + '|'.join(sorted(g)) + ')'}", depth + 1, purity)
            if rest:
                grow(rest, f"{template}/*", depth + 1, purity)

        known, bad = sum(x[2] is not None for x in rows), sum(x[2] or 0 for x in rows)
        for host in ("a.com", "b.com"):
            grow([x for x in rows if x[0] == host], host, 0, (bad + 1) / (known + 2))
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
        names = {v[0] for v in want.values()}
        assert any("(junk|spam)" in t for t in names) and any(t.endswith("/*/*/bad/*") for t in names)

    def test_empty_and_repeated(self, spark):
        df = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
        assert url_filters.judge_urls(df).count() == 2 and url_filters.judge_urls(df.filter("false")).count() == 0


def line_brute(rows):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 20 and i is not None:
                holders[strip(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(holders.get(strip(x), ())) >= 3 and i != max(holders[strip(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_lines(spark, odd, documents, empty, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for df in (odd, documents, docs_of(spark, [(i, "the very same line in all of them\n" * 2, "a") for i in range(400)])):
            got = line_dedup.drop_lines(df).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("t"))
            assert sorted(map(tuple, got.collect()), key=str) == line_brute([(r.doc_id, r.text) for r in df.collect()])
        assert line_dedup.drop_lines(empty).count() == 0
        assert line_dedup.drop_lines(odd.withColumn("n_lines", F.lit("x"))).columns[-2:] == ["_n_lines", "n_dropped"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bitmaps_are_compressed(spark, documents):
    import zlib

    for r in line_dedup.line_keep_bitmaps(documents).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), count=r.n_lines)
        assert r.n_lines - bits.sum() == r.n_dropped > 0


class TestTokenCounts:
    def test_equals_library(self, spark, documents, odd):
        from tokenizers import Tokenizer, models, pre_tokenizers

        vocab, hidden = token_counts.read_vocab(PIECES)
        # the library matches any piece of its vocabulary, so control pieces get spellings that no text has; byte pieces it needs as they are
        spelled = [(f"\ufdd0{i}" if i in hidden and not p.startswith("<0x") else p, s) for i, (p, s) in enumerate(vocab)]
        t = Tokenizer(models.Unigram(spelled, 0, byte_fallback=True))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        more = docs_of(spark, [(i, x, "a") for i, x in enumerate(["  a  b ", "日本語 text\n\nfoo▁bar", "😀😀 x", "x<s> </s> <unk> é", "▁a", "\n", "a\tb", "é<" * 30_000])])
        for df in (documents, odd, more):
            rows = df.select("doc_id", "text").collect()
            want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
            assert Counter(map(tuple, token_counts.count_tokens(df, PIECES).collect())) == want

    @pytest.mark.parametrize("text", ["x<s>", "a<0x41>b", "<0x41>", "<unk>", "the cat <0x0A><0x0A>"])
    def test_hidden_pieces_are_text(self, text):
        """Against a Viterbi search over all substrings."""
        vocab, hidden = token_counts.read_vocab(PIECES)
        scores = {p: s for i, (p, s) in enumerate(vocab) if i not in hidden}
        low, total = min(scores.values()) - 10, 0
        for w in text.split(" "):
            w = "▁" + w
            best = [(0.0, 0)]
            for end in range(1, len(w) + 1):
                found = [(best[i][0] + scores[w[i:end]], best[i][1] + 1) for i in range(end) if w[i:end] in scores]
                if w[end - 1] not in scores:
                    found.append((best[end - 1][0] + low, best[end - 1][1] + len(w[end - 1].encode())))
                best.append(max(found, key=lambda x: x[0]))
            total += best[-1][1]
        assert token_counts.UnigramCounter(vocab, hidden).count(text) == total

    def test_ties_and_unknown_runs(self):
        from tokenizers import Tokenizer, models

        vocab = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0)]
        t = Tokenizer(models.Unigram(vocab, 0, byte_fallback=False))
        c = token_counts.UnigramCounter(vocab)
        for s in ("a", "aaab", "abab", "xxa", "axxb", "xaxbx", "aabaab"):
            assert c.piece(s) == len(t.encode(s).ids), s

    def test_empty(self, empty):
        assert token_counts.count_tokens(empty, PIECES).count() == 0


class TestNear:
    @pytest.mark.parametrize("which", ["odd", "documents"])
    def test_equals_brute_force(self, request, which):
        df = request.getfixturevalue(which)
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = near_brute(rows)
        got = minhash.near_groups(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id == r.component_id)
        sizes = Counter((i, len(shingle_set(t))) for i, t in rows)
        assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes

    def test_star_of_copies_around_a_text(self, spark):
        rng = np.random.RandomState(3)
        base = [f"w{i}" for i in range(150)]
        rows = []
        for i in range(120):
            w = list(base)
            for at in rng.choice(150, rng.randint(0, 9), replace=False):
                w[at] = f"x{i}_{at}"
            rows.append((i, " ".join(w), "a"))
        want = near_brute([(i, t) for i, t, _ in rows])
        assert {r.doc_id: r.component_id for r in minhash.near_groups(docs_of(spark, rows)).collect()} == want

    def test_common_passage_links_nothing(self, spark):
        passage = " ".join(f"p{i}" for i in range(60))
        rows = [(i, passage + " " + " ".join(f"own{i}_{k}" for k in range(40)), "a") for i in range(60)]
        assert minhash.near_groups(docs_of(spark, rows)).filter("kept").count() == 60

    def test_shingles_too_many_share(self, spark, monkeypatch):
        """Texts over a long common passage, more than a block has, with a few near copies among them."""
        monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
        monkeypatch.setattr(minhash, "CHOICE", 8)
        monkeypatch.setattr(minhash, "PART", 4)
        passage = [f"p{i}" for i in range(160)]
        rows = [(i, " ".join(passage + [f"own{i}_{k}" for k in range(45)]), "a") for i in range(60)]
        rows += [(100 + i, rows[i][1] + f" tail{i}", "a") for i in range(0, 60, 7)]
        want = near_brute([(i, t) for i, t, _ in rows])
        assert {r.doc_id: r.component_id for r in minhash.near_groups(docs_of(spark, rows)).collect()} == want

    def test_blocks_find_all_links(self):
        import pyarrow as pa

        texts = [" ".join(f"w{k}" for k in range(40)) + f" x{i // 2}" for i in range(6)] + [" ".join(f"v{k}" for k in range(30))]
        schema = pa.schema([("token", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("label", pa.int64()), ("text", pa.string())])
        rows = [{"token": 1, "i": 0, "j": 1, "block": n % 2, "node": n, "label": n, "text": t} for n, t in enumerate(texts)] + [{"token": 2, "i": 0, "j": 0, "block": 0, "node": n, "label": n, "text": texts[n]} for n in (0, 1, 6)]
        got = {tuple(r.values()) for b in minhash._across([pa.RecordBatch.from_pylist(rows, schema=schema)]) for r in b.to_pylist()}
        assert got == {(a, b) for a in range(6) for b in range(a + 1, 6) if a % 2 != b % 2}

    def test_components_of_a_chain(self, spark):
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
        got = {r.node: r.label for r in minhash.components(edges).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}

    def test_empty(self, empty):
        assert minhash.near_groups(empty).count() == 0


class TestLm:
    def test_trie_finds_what_it_holds(self):
        rng = np.random.RandomState(0)
        for n, top in ((0, 10), (1, 5), (3000, 1 << 62), (500, 600)):
            v = np.unique(rng.randint(0, top, n).astype(np.uint64))
            ef = lm.EliasFano(v, int(v[-1]) + 1 if len(v) else 1)
            probe = np.concatenate([v, v + np.uint64(1), np.array([0, top], np.uint64)])
            at = {int(x): i for i, x in enumerate(v)}
            assert ef.find(probe).tolist() == [at.get(int(x), -1) for x in probe]
            assert ef.get(np.arange(len(v))).tolist() == v.tolist()

    def test_select(self):
        """The k-th one of a word, for far less than counting the ones of its bytes one by one."""
        import time

        rng = np.random.RandomState(1)
        words = rng.randint(1, 1 << 62, 200_000).astype(np.uint64) & rng.randint(1, 1 << 62, 200_000).astype(np.uint64) | np.uint64(1 << 63)
        words[:2] = (1 << 63, (1 << 64) - 1)
        k = rng.randint(0, 64, len(words)) % np.bitwise_count(words)
        k[1] = 63

        def plain():
            upto = np.cumsum(np.bitwise_count(words.view(np.uint8).reshape(-1, 8)), axis=1, dtype=np.int64)
            return (upto <= k[:, None]).sum(axis=1)

        def took(f):
            began = time.process_time()
            f()
            return time.process_time() - began

        got = lm.EliasFano._select_in(words, k)
        want = [[i for i in range(64) if w >> i & 1][n] for w, n in zip(words[:3000].tolist(), k[:3000].tolist())]
        assert got[:3000].tolist() == want and (got >> 3).tolist() == plain().tolist()
        assert min(took(lambda: lm.EliasFano._select_in(words, k)) for _ in range(5)) < min(took(plain) for _ in range(5))

    def test_ranks(self):
        """Both ways to find distinct values agree with numpy's, also where value and place don't fit one number."""
        rng = np.random.RandomState(2)
        for n, top in ((0, 5), (1, 1), (5000, 300), (5000, 1 << 61)):
            x = rng.randint(0, top, n)
            want = [a.tolist() for a in np.unique(x, return_inverse=True)]
            assert [a.tolist() for a in lm._ranked(x)] == want == [a.tolist() for a in lm._distinct(x, top)]

    def test_spelling_is_sent_once_a_task(self, monkeypatch):
        """A task sends each spelling cell once, not once a flush, with the sums of all its flushes, and the counts of all words."""
        import pyarrow as pa

        monkeypatch.setattr(lm, "BYTES_PER_FLUSH", 20)
        texts = ["ab abc a", "ab x  é abc\n", "", None, "b ab abc ab", "zz"]
        held = [False, False, False, False, False, True]
        rows = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(held), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"])
        flushes = [t for _, _, t in lm._flushes([rows])]
        assert len(flushes) > 1
        got = [r for b in lm._counted([rows]) for r in b.to_pylist()]
        cells, n = Counter(), Counter()
        for flush in flushes:
            words = [w for t in flush for w in t.split() if w != b"zz"]
            n.update(words)
            for w in set(words):
                spelled = b"  " + w + b" "
                cells.update(((a * 40503 + b * 30011) >> 3) % lm.ROWS * 256 + c for a, b, c in zip(spelled, spelled[1:], spelled[2:]))
        sent = [(r["x"], r["n"]) for r in got if r["kind"] == 1]
        assert dict(sent) == cells and len(sent) == len(cells)
        sums = Counter()
        for r in got:
            if r["kind"] == 0:
                sums[r["x"] & ((1 << 64) - 1)] += r["n"]
        assert sums == {int(word_hashes(w)[2][0]): k for w, k in n.items()}

    def test_scores(self, documents):
        rows = {r.doc_id: r.text for r in documents.collect()}
        import zlib

        words = {i: WORD.findall((t or "").translate(LOWER)) + ["\n"] for i, t in rows.items()}
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
        c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
        n, v = sum(c.values()), len(c)
        got = lm.score_documents(documents).collect()
        assert len(got) == len(rows)
        for r in got:
            ws = words[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)

    def test_model_is_smoothed(self, spark):
        df = docs_of(spark, [(i, "a b a b c", "a") for i in range(4)] + [(4, "a b z", "a")])
        rows = {r.doc_id: r for r in lm.score_documents(df).collect()}
        assert all(r.score < 0 for r in rows.values()) and rows[0].score > rows[0].base_score

    def test_all_counts_are_kept(self, spark, monkeypatch):
        """Scores are those of the exact counts, however few words are broadcast."""
        import zlib

        rng = np.random.RandomState(5)
        texts = {i: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 300) for i in range(300)}
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
        words = {i: t.split() + ["\n"] for i, t in texts.items()}
        c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
        pairs = Counter(p for i, ws in words.items() if not held[i] for p in zip(["\t", *ws], ws))
        tokens, seen = sum(c.values()), Counter({**c, "\t": sum(not x for x in held.values())})
        rest = min(0.5, max(sum(n == 1 for n in c.values()) / tokens, 1e-3))
        triples = Counter(t for i, ws in words.items() if not held[i] for t in zip(["\t", "\t", *ws], ["\t", *ws], ws))
        two = lambda h, w: (pairs[h, w] + lm.MU * (1 - rest) * c[w] / tokens) / (seen[h] + lm.MU)
        three = lambda u, v, w: two(v, w) if v == "\t" else (triples[u, v, w] + lm.MU3 * two(v, w)) / (pairs[u, v] + lm.MU3)
        score = lambda ws: sum(np.log10(three(*t)) for t in zip(["\t", "\t", *ws], ["\t", *ws], ws))
        whole = sum(three("w1", "w2", w) for w in c)
        assert whole == pytest.approx(1 - rest * lm.MU / (seen["w2"] + lm.MU) * lm.MU3 / (pairs["w1", "w2"] + lm.MU3), rel=1e-6)
        df = docs_of(spark, [(i, t, "a") for i, t in texts.items()]).repartition(3)
        for frequent in (8, lm.FREQUENT):
            monkeypatch.setattr(lm, "FREQUENT", frequent)
            got = [r for r in lm.score_documents(df).collect() if all(c[w] for w in words[r.doc_id])]
            assert len(got) > 200
            assert max(abs(r.score - score(words[r.doc_id])) / len(words[r.doc_id]) for r in got) < 0.01

    def test_odd(self, odd, empty):
        got = lm.score_documents(odd).collect()
        assert len(got) == len(odd_rows()) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and all(r.score < 0 for r in got)
        assert lm.score_documents(empty).count() == 0


#: Names that the operators use within, and that result columns have.
CLASHING = [
    "host", "row", "n", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept", "_words", "_lines", "_hot", "hot", "part", "parts", "_doc", "_keep_bitmap", "keep_bitmap", "n_lines",
    "_n_lines", "n_dropped", "text_key", "_text_key", "positions", "hash", "key", "node", "label", "component_id", "set_id", "signature", "a.b", "c0", "at", "digest", "keep_id", "shard", "bin", "piece", "cluster", "held_out", "x",
]


def test_clashing_names(spark, odd):
    """Extra columns with the names used within change nothing, and pass through the stages."""
    import corpus_pipeline as p

    plain = odd.filter("doc_id is not null AND doc_id < 25")
    wide = plain.select("*", *[F.lit(-7).alias(c) for c in CLASHING])
    rows = lambda df: Counter(map(str, df.collect()))
    for f in (
        lambda d: exact_dedup.exact_groups(d), lambda d: minhash.near_groups(d), lambda d: lm.score_documents(d), lambda d: quality_rules.judge(d), lambda d: bpe.encode_digests(d, BPE), lambda d: token_counts.count_tokens(d, PIECES),
        lambda d: packing.pack_documents(d).drop("shard", "bin", "left_over"), lambda d: p.packing_stage(spark, d, "").drop("shard", "bin", "left_over"),
    ):
        assert rows(f(wide)) == rows(f(plain))
    for stage in (p.quality_stage, p.line_stage, p.near_dedup_stage):
        got = stage(spark, wide, "")
        assert got.columns == wide.columns
        assert rows(got.select(*plain.columns)) == rows(stage(spark, plain, "")) and got.filter("n_words <> -7 OR `a.b` <> -7 OR n_lines <> -7").count() == 0
    lined = line_dedup.drop_lines(wide)
    assert len({c.lower() for c in lined.columns}) == len(lined.columns) == len(wide.columns) + 2
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", f"<p>{i}") for i in range(6)], "page_id long, url string, html string")
    wider = pages.select("*", *[F.lit(-7).alias(c) for c in [*CLASHING, "page", "path", "rule", "verdict", "template", "purity", "segments", "open", "templates", "text"]])
    for f in (html_extraction.extract_pages, url_filters.judge_urls):
        assert rows(f(wider)) == rows(f(pages))


def test_lookup_splits_large_keys(spark):
    left = spark.createDataFrame([(i, f"k{i % 1500}" if i % 3 else f"k{i % 40}") for i in range(9000)], "id long, k string")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = {r.k: r.m for r in right.collect()}
    assert {(r.id, r.k, r.m) for r in lookup(left, right, "k", "n", rows=3).collect()} == {(r.id, r.k, want[r.k]) for r in left.collect()}


class TestExact:
    def brute(self, rows):
        groups = defaultdict(list)
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        for i, t in rows:
            groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
        return Counter((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)

    @pytest.mark.parametrize("capacity", [None, 500])
    def test_equals_brute_force(self, odd, documents, capacity):
        for df in (odd, documents):
            got = exact_dedup.exact_groups(df, capacity).collect()
            assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == self.brute([(r.doc_id, r.text) for r in df.collect()])
            assert all(r.kept == (r.doc_id == r.keep_id) for r in got)

    def test_directory_doubles(self):
        d = exact_dedup.Directory()
        assert d.split({0: 100, 1: 1, 200: 5}, 8, capacity=50) == [0] and d.depth == 8
        assert (0, 8) in d.leaves and (1, 8) in d.leaves and (1, 1) in d.leaves
        # a finer histogram inside what is still overfull
        assert d.split({0: 40, 3: 60}, 10, capacity=50, known=8) == [3] and {(0, 9), (2, 10), (3, 10)} <= d.leaves and (0, 8) not in d.leaves
        starts = d.starts()
        assert starts[0] == 0 and len(set(starts.tolist())) == len(d.leaves)
        assert sum(2.0**-depth for _, depth in d.leaves) == 1
        empty = exact_dedup.Directory()
        assert empty.split({}, 16, 50) == [] and empty.starts().tolist() == [0]

    def test_directory_goes_below_the_first_histogram(self, spark):
        low = 1 << 20  # keys that differ in their last bits only
        entries = spark.createDataFrame([(low + i, 100) for i in range(8)], "key long, n_bytes long")
        starts = exact_dedup.build_directory(entries, 450)
        at = np.searchsorted(starts, np.array([low + i for i in range(8)], np.int64).view(np.uint64) ^ np.uint64(1 << 63), side="right")
        assert max(Counter(at.tolist()).values()) == 2

    def test_collisions_are_told_apart(self):
        import pyarrow as pa

        b = pa.RecordBatch.from_pylist([{"key": 5, "norm": n, "n_cp": c, "best": d, "members": [d]} for n, c, d in ((b"x", 1, 9), (b"y", 1, 8), (b"x", 3, 7))], schema=pa.schema([("key", pa.int64()), ("norm", pa.binary()), ("n_cp", pa.int64()), ("best", pa.int64()), ("members", pa.list_(pa.int64()))]))
        got = [r for out in exact_dedup._own([b]) for r in out.to_pylist()]
        assert sorted((r["keep_id"], r["n"], r["place"]) for r in got if r["kind"] == exact_dedup.HEAD) == [(7, 2, 0), (8, 1, 1)]
        assert [(r["members"], r["place"]) for r in got if r["kind"] == exact_dedup.PLACE] == [([9], 0), ([8], 1), ([7], 0)]

    def test_empty(self, empty):
        assert exact_dedup.exact_groups(empty).count() == 0


class TestQuality:
    def brute(self, t):
        t = t or ""
        w = WORD.findall(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        covered = {k for i, x in enumerate(win) if n[x] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    def test_counts(self, spark, odd, documents):
        more = docs_of(spark, [(1, "a b c d e a b c d e", "x"), (2, "a a a a a a a", "x"), (3, "# $ a\n# $ a\n\n \n", "x"), (4, "a b c d e f a b c d e", "x"), (5, "a b c d e", "x")])
        for df in (odd, documents, more):
            for r in quality_rules.rule_columns(df).collect():
                want = self.brute(r.text)
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
                assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])

    def test_hosts(self, spark):
        good, bad = " ".join(f"w{i}" for i in range(30)), "short"
        rows = [(i, bad if i % 50 else good, "spam") for i in range(200)] + [(1000 + i, good if i % 10 else bad, "fine") for i in range(200)] + [(2000, good, "tiny"), (2001, good, None)]
        df = docs_of(spark, rows)
        got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
        assert not got[0] and got[1001] and not got[1000] and got[2000] and got[2001]
        assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, k in got.items() if k}

    def test_each_rule_is_summed_by_host(self, spark):
        """A host whose documents pass the base rules but nearly all fail another one is rejected; brute force on the rates."""
        good = " ".join(f"w{i}" for i in range(30))
        signs = " ".join(f"a{i} #|" for i in range(15))
        rows = [(i, signs if i % 40 else good, "signs") for i in range(160)] + [(1000 + i, signs if i % 5 == 0 else good, "some") for i in range(160)] + [(2000 + i, good, f"h{i % 7}") for i in range(140)]
        df = docs_of(spark, rows)
        light = quality_rules.rule_columns(df.select("doc_id", "source", "text"))
        got = {r["source"]: r for r in quality_rules.host_verdicts(light).collect()}
        n, failed = Counter(s for _, _, s in rows), Counter(s for _, t, s in rows if t == signs)
        mean, rates = sum(failed.values()) / len(rows), [failed[s] / n[s] for s in n]
        strength = min(quality_rules.PRIOR_MAX, max(quality_rules.PRIOR_MIN, mean * (1 - mean) / np.var(rates) - 1))
        for s in n:
            assert got[s]["rate_symbols"] == pytest.approx((failed[s] + mean * strength) / (n[s] + strength)) and got[s]["failed_symbols"] == failed[s]
        kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
        assert not any(kept[i] for i in range(160)) and all(kept[i] for i in kept if i >= 1000)

    def test_odd(self, odd, empty):
        assert quality_rules.judge(odd).count() == len(odd_rows()) and quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


class TestPacking:
    def check(self, rows, capacity):
        bins = defaultdict(list)
        for r in rows:
            if r.bin is not None:
                bins[r.shard, r.bin].append(r)
        for b in bins.values():
            assert sum(r.length for r in b) + b[0].left_over == capacity and len({r.left_over for r in b}) == 1
            for k in ("source", "cluster"):
                known = [getattr(r, k) for r in b if getattr(r, k) is not None]
                assert len(known) == len(set(known))
        return bins

    def test_whole_and_without_conflicts(self, spark, documents, odd):
        for df in (documents, odd):
            rows = packing.pack_documents(df, 300).collect()
            self.check(rows, 300)
            want = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in df.collect())
            got = defaultdict(int)
            for r in rows:
                got[r.doc_id] += r.length or 0
            assert got == {i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in want}

    def test_equals_plain_best_fit(self):
        rng = np.random.RandomState(1)
        pieces = sorted(((int(rng.randint(1, 101)), f"s{rng.randint(6)}" if rng.rand() < 0.9 else None, int(rng.randint(40))) for _ in range(400)), key=lambda p: -p[0])
        bins, placed = [], []
        for n, s, c in pieces:
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and n < 100 and (s is None or s not in b[1]) and c not in b[2]]
            if fits:
                left = min(f[0] for f in fits)
                k = min((b[3], k) for k, b in enumerate(bins) if (b[0], k) in set(fits) and b[0] == left)[1]
            else:
                bins.append([100, set(), set(), 0])
                k = len(bins) - 1
            bins[k][0] -= n
            bins[k][1].add(s)
            bins[k][2].add(c)
            bins[k][3] = len(placed)
            placed.append(k)
        assert [b for b, _ in packing.pack(pieces, 100)] == placed

    def test_shards_and_empty(self, spark, empty):
        items = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}", i, 10) for i in range(300)], "doc_id long, source string, cluster long, n_tokens long")
        rows = packing.best_fit(items, 100, shard_rows=50).collect()
        assert len(rows) == 300 and len({r.shard for r in rows}) > 3
        self.check(rows, 100)
        assert packing.pack_documents(empty).count() == 0


class TestBpe:
    def test_equals_library(self, spark, documents, odd, empty):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(BPE)
        rng = np.random.RandomState(2)
        texts = ["", "  a  b ", "日本語 text\n\nfoo", "😀😀 x", "<|endoftext|>a <|endoftext|> b<|endoftext", "\n \t\n  x", "a" * 300, "!!!!====----____    " * 20, "I'll don't 'S x's"]
        texts += ["".join(rng.choice(list("abeinrst =-_.!1"), 200)) for _ in range(60)] + ["".join(rng.choice(list("ae"), 80)) for _ in range(60)]
        m = bpe.model(BPE)
        for x in texts:
            ids = t.encode(x, add_special_tokens=False).ids
            assert m.encode(x) == ids if x else ids == []
            assert m.decode(ids) == t.decode(ids, skip_special_tokens=False)
        for df in (documents, odd):
            got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, BPE).collect()}
            want = set()
            for r in df.collect():
                ids = t.encode(r.text or "", add_special_tokens=False).ids
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
            assert got == want
        assert bpe.encode_digests(empty, BPE).count() == 0

    def test_unsupported_files_are_refused(self, tmp_path):
        with open(BPE, encoding="utf-8") as f:
            spec = json.load(f)
        for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "ignore_merges": True}}, {"decoder": None}):
            (tmp_path / "t.json").write_text(json.dumps(spec | change))
            with pytest.raises(ValueError, match="not supported"):
                bpe.BytePairs(str(tmp_path / "t.json"))

    def test_adjoin_is_merging(self):
        m = bpe.model(BPE)
        rng = np.random.RandomState(5)
        for a, b in rng.randint(0, 3000, (3000, 2)).tolist():
            assert m.adjoin(a, b) == (m.merged(m.bytes[a] + m.bytes[b]) == [a, b]), (a, b)


class TestHtml:
    def test_article(self):
        page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar">
        <header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">buy</div>
        <article id="main-comment"><h1>Head &amp; more</h1><p><b>Bold<br>next<p>two&nbsp;parts <i>in</i>line</p><ul><li>one<li>two</ul><div class="share-box">share</div><form>mail <input></form><aside>see also</aside>
        <p title="a > b">three &lt;tag&gt;</p></article><section id="comments"><article class="comment"><p>reader says a very long thing that is longer than the article itself, again and again and again and again and again and again and again</p></article></section><footer>&copy; x</footer></body></html>"""
        assert html_extraction.main_text(page) == "Head & more Bold next two parts inline one two three <tag>"

    @pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<body><p>a<p>b</body>", "a b"), ("<p>a</b>c</p><", "ac <"), ("<div>" * 3000 + "deep", "deep"), ("<main>x<script>y", "x"), ("<p>a<!-- b", "a")])
    def test_odd_pages(self, page, text):
        assert html_extraction.main_text(page) == text

    def test_site_template_goes_and_shared_paragraphs_stay(self, spark):
        notice, shared = "<div><p>Join us today</p></div>", "<p>A passage that pages share.</p>"
        rows = [(i, f"http://h.com/{i}", f"<body>{notice}<article>{shared}<p>own {i}</p></article></body>") for i in range(20)]
        rows += [(100 + i, f"http://h.com/n{i}", f"<body>{notice}<p>no article {i}</p></body>") for i in range(20)]
        rows += [(200 + i, "http://copy.com/", "<body><div><p>same page</p></div></body>") for i in range(20)] + [(300, None, None)]
        got = {r.page_id: r for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[3].text == "A passage that pages share. own 3" and got[103].text == "no article 3" and got[203].text == "same page" and got[300].text == "" and got[3].n_chars == len(got[3].text)

    @pytest.mark.parametrize(
        "page,text",
        [
            ("<body><article><p>first part</p></article><p>x</p><article><p>the second part</p></article></body>", "first part the second part"),
            ("<body><div><p>" + "long text " * 20 + "</p></div><article><p>teaser</p></article></body>", "long text " * 20 + "teaser"),
            ("<body><p>aside</p><main><p>" + "long text " * 20 + "</p><article><p>teaser</p></article></main></body>", "long text " * 20 + "teaser"),
        ],
    )
    def test_no_article_is_lost(self, page, text):
        assert html_extraction.main_text(page) == text

    def test_templates_without_telling_names(self, spark):
        """Menus, notices and feet in plain div elements go by their counts alone; a page on a host of few pages keeps them."""
        menu = "<div><a href='/'>Home</a> <a href='/news'>News</a></div><div><p>We use small files to count visits.</p></div>"
        page = lambda i: f"<html><body>{menu}<div><h1>Title {i}</h1><p>Own words of page {i} and no other.</p></div><div>Made with care.</div></body></html>"
        rows = [(i, f"http://big.com/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://tiny.com/{i}", page(i)) for i in range(3)]
        got = {r.page_id: r for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        lost = "Home News", "We use small files to count visits.", "Made with care."
        for i in range(30):
            assert got[i].text == f"Title {i} Own words of page {i} and no other." and (got[i].template_chars, got[i].rule_chars) == (sum(map(len, lost)), 0)
        assert got[100].text == f"{lost[0]} {lost[1]} Title 0 Own words of page 0 and no other. {lost[2]}" and got[100].template_chars == 0

    def test_templates_equal_brute_force(self, spark):
        """Blocks of a pool on the pages of two hosts: those on MIN_PAGES different pages of a host go there, the others stay."""
        rng = np.random.RandomState(6)
        rows, blocks, on = [], {}, defaultdict(set)
        for i in range(90):
            own = i if i % 10 else 7  # some pages are the same
            host, some = f"h{own % 2}.com", np.flatnonzero(np.random.RandomState(own).rand(25) < np.linspace(0.02, 0.4, 25))
            blocks[i] = host, own, some.tolist()
            page = f"<body><p>own {own}</p>" + "".join(f"<div class='x'><b>block</b> {k}</div>" for k in some) + "</body>"
            for k in some:
                on[host, k].add(page)
            rows.append((i, f"http://{host}/{rng.randint(9)}", page))
        got = {r.page_id: r for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
        gone = {x for x, pages in on.items() if len(pages) >= html_extraction.MIN_PAGES}
        assert 0 < len(gone) < len(on)
        for i, (host, own, some) in blocks.items():
            left = [k for k in some if (host, k) not in gone]
            assert got[i].text == " ".join([f"own {own}", *(f"block {k}" for k in left)])
            assert got[i].template_chars == sum(len(f"block {k}") for k in some if k not in left) and got[i].rule_chars == 0

    @pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "x", "<b>" * 100_000 + "<p>x</p>" * 50_000, "<a " * 300_000, "<a ='" * 200_000, f"<a class='{'y ' * 300_000}' {'z' * 400_000}>x"])
    def test_work_is_linear(self, page):
        import time

        began = time.process_time()
        html_extraction.main_text(page, {b"none"})
        assert time.process_time() - began < 10

    def test_template_on_a_small_share_of_a_large_host(self, spark):
        notice = "<div><p>Join us today</p></div>"
        rows = [(i, f"http://a.com/{i}", f"<body><article><p>own {i}</p>{notice if i < 8 else ''}</article></body>") for i in range(200)]
        got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"own {i}" for i in range(200)}

    def test_pages(self, spark, sf_dir):
        rows = queries()["op10_html_extraction"](spark, sf_dir).collect()
        pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
        for r in rows:
            a = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
            a = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|br|h1)[^>]*>", " ", a))
            assert r.text == " ".join(html.unescape(a).split())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    show = lambda pdf: sorted(pdf[sorted(pdf.columns)].astype(str).itertuples(index=False, name=None))
    assert show(queries()[name](spark, sf_dir).toPandas()) == show(con.execute(oracle_sql()[name]).df())


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline as p

    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    q = TestQuality()
    good = [(i, t, s) for i, t, s in rows if (w := q.brute(t))[0] >= 10 and 100 * w[4] <= 20 * w[0]]
    fails = Counter(s for _, _, s in rows)
    lined = {i: t for i, _, _, t in line_brute([(i, t) for i, t, _ in good])}
    groups = near_brute(list(lined.items()))
    left = {i for i, g in groups.items() if i == g}
    got = p.run(spark, sf_dir).collect()
    assert fails and {r.doc_id for r in got} == left
    n = defaultdict(int)
    for r in got:
        n[r.doc_id] += r.length or 0
    assert n == {i: len(WORD.findall(lined[i])) for i in left}
    TestPacking().check(got, packing.CAPACITY)
