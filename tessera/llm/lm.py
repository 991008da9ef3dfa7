"""LM scoring with Elias-Fano n-gram tries.

The model is a trigram model with hierarchical Dirichlet (interpolated) smoothing:
    p(w | v)   = (c(v w) + MU * p0(w)) / (c(v) + MU)
    p(w | u v) = (c(u v w) + MU3 * p(w | v)) / (c(u v) + MU3)
and p(w | v) for a text's first word. p0 is the relative frequency of every word that has a training count; a share as large as that of the words seen once is left for words without one:
half of it evenly (over as many words as were seen once), half by a byte-trigram spelling model.

What is broadcast has a fixed bound at any size of the corpus: words with a share of 1/FREQUENT or more, so at most FREQUENT of
them, and the spelling model. Counts of other words are exact too, but only where they are needed: a word's own shard, where all
its tokens as a context meet, counts it there, and the counts of words that follow another such word come to that word's shard by
a join on the word.

Scan tasks send each (context, word), with the word before, to the shard of the context: a blob of a few bytes a token. A frequent context is dealt
by context and word if the word is frequent too, so that both counts are known from the broadcast table, else to the word's own
shard. So all that happens to a pair of words meets in one shard. A shard counts the pairs and triples of its training documents, builds
one trie over them and scores all its pairs with it; sums by document go back in blobs. The logarithm of a trigram's probability
is that of a numerator, known where its last two words are, less that of a denominator, known where its first two are, and each adds
its part. So the corpus is shuffled once, and a shard's share is bounded by choosing their number by the tokens.

A trie has sorted contexts, monotone pointers to their successors, the successors, made monotone by adding the context's
offset, and below them pointers to the words before, kept the same way: each an Elias-Fano sequence; probabilities and
back-off weights are quantised to a byte. The levels lie in one memory-mapped file. A query finds the context, takes its pointers and
searches the successor within them, then the word before within the pair's.

Defined cases: null counts as empty (one end token); a null doc_id counts as the empty text and so trains; repeated rows are scored
and learned each; a very long text is one flush of one task, and its tokens are dealt like any other's; an empty table, or one without
training rows, gives scores from the smoothing alone; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lowered, materialise, shuffle_partitions, word_hashes

#: Weight of the next lower order, in tokens.
MU, MU3 = 300.0, 10.0
FREQUENT = 1 << 20
#: Contexts of the spelling model: two bytes, hashed to this many rows.
ROWS = 8192
BYTES_PER_FLUSH = 8 << 20
TOKENS_PER_SHARD = 1_500_000
END, START = b"\n", b"\t"  # no word has these bytes
#: Spelling probabilities travel as bytes: steps of a tenth of log10.
STEP = 0.1
_LOW = (1 << 40) - 1


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary. All methods take arrays."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, (max(1, universe // max(1, n))).bit_length() - 1)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = (universe >> self.low_bits) + 2
        bits = np.zeros(-(-(n + self.buckets) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        small = np.uint32 if 64 * len(words) < 1 << 32 else np.uint64
        self.levels = {"high": words, "ones": ones.astype(small), "zeros": (np.arange(len(ones)) * 64 - ones).astype(small), "low": self._pack(v)}

    def _pack(self, v: np.ndarray) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(1, np.uint64)
        out = np.zeros(len(v) * b // 64 + 2, np.uint64)
        low = v & np.uint64((1 << b) - 1)
        at = np.arange(len(v), dtype=np.uint64) * np.uint64(b)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, low << shift)
        over = shift + np.uint64(b) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return out

    def low(self, i: np.ndarray) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(len(i), np.uint64)
        packed = self.levels["low"]
        at = i.astype(np.uint64) * np.uint64(b)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = packed[word] >> shift
        over = shift + np.uint64(b) > np.uint64(64)
        out[over] |= packed[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << b) - 1)

    @staticmethod
    def _select_in(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one of each word: a product adds up the ones of its bytes, a table has the place within a byte."""
        upto = words - (words >> np.uint64(1) & _FIVES)
        upto = (upto & _THREES) + (upto >> np.uint64(2) & _THREES)
        upto = (upto + (upto >> np.uint64(4)) & _FIFTEENS) * _EACH  # byte i: ones in bytes 0 to i
        k = k.astype(np.uint64)
        at = np.bitwise_count((k * _EACH | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)  # bytes that end before the k-th one
        k -= (upto << np.uint64(8)) >> at & np.uint64(255)
        return (at + _SELECT[(words >> at & np.uint64(255)) << np.uint64(3) | k]).astype(np.int64)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        high, seen = self.levels["high"], self.levels["zeros" if zeros else "ones"]
        word = np.searchsorted(seen, k.astype(seen.dtype), side="right") - 1
        return word * 64 + self._select_in(~high[word] if zeros else high[word], k - seen[word])

    def _after(self, at: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
        """As _select, for k-th ones that are the first from position at: most lie in its word."""
        rest = self.levels["high"][at >> 6]
        rest = (~rest if zeros else rest) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count(~rest & rest - np.uint64(1))
        beyond = np.flatnonzero(rest == 0)
        out[beyond] = self._select(k[beyond], zeros)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return self._value(self._select(i, False), i)

    def _value(self, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (at - i).astype(np.uint64) << np.uint64(self.low_bits) | self.low(i)

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """get(i) and get(i + 1)."""
        at = self._select(i, False)
        return self._value(at, i), self._value(self._after(at + 1, i + 1, False), i + 1)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, -1 where it is not there: successor search among those with its high bits (and within start, stop)."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        v = values.astype(np.uint64)
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        fits = high < self.buckets - 1
        high = np.where(fits, high, 0)
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) + 1, 0)
        lo, hi = at - high, self._after(at, high, True) - high
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, stop)
        end, low = hi.copy(), v & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(fits & (lo < hi))
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        at = np.flatnonzero(fits & (lo < end))
        hit = at[self.low(lo[at]) == low[at]]
        out[hit] = lo[hit]
        return out


#: Position of the k-th one of a byte.
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.uint8)
#: Each byte of a word: 1, 0x80, and masks of every other one, two and four bits.
_EACH, _TOPS, _FIVES, _THREES, _FIFTEENS = (np.uint64(0x0101010101010101 * x) for x in (1, 0x80, 0x55, 0x33, 0x0F))


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a byte and their values: the means of 256 bins of equal width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    low, high = float(values.min()), float(values.max())
    width = (high - low) / 255 or 1.0
    codes = np.rint((values - low) / width).astype(np.uint8)
    sums, n = np.bincount(codes, values, 256), np.bincount(codes, minlength=256)
    return codes, sums / np.maximum(n, 1)


class Level:
    """Sorted children of sorted parents: (parent, child) with pointers, both given by index of the parent and child's number."""

    def __init__(self, parents: int, parent: np.ndarray, names: np.ndarray, which: np.ndarray):
        """Children are names[which]; names are sorted and may have others too."""
        there = np.zeros(len(names), bool)
        there[which] = True
        names, rank = names[there], np.cumsum(there) - 1
        self.names = EliasFano(names, (int(names[-1]) if len(names) else 0) + 1)
        self.span = len(names)
        self.children = EliasFano(rank[which] + parent * self.span, max(1, parents * self.span))
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=parents))]), len(parent) + 1)

    def parts(self) -> list[EliasFano]:
        return [self.names, self.children, self.pointers]

    def find(self, parent: np.ndarray, names: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Index of each (parent, names[which]), -1 where it is not there; a parent may be -1. Successor search within the parent's
        children."""
        out = np.full(len(which), -1, np.int64)
        name = self.names.find(names)[which]
        ok = np.flatnonzero((name >= 0) & (parent >= 0))
        for i in range(0, len(ok), 1 << 16):
            at = ok[i : i + (1 << 16)]
            of = parent[at]
            new = np.concatenate([[True], of[1:] != of[:-1]])
            run = np.cumsum(new) - 1  # neighbours mostly share their parent
            start, stop = (x.astype(np.int64)[run] for x in self.pointers.get_two(of[new]))
            out[at] = self.children.find(name[at].astype(np.uint64) + of.astype(np.uint64) * np.uint64(self.span), start, stop)
        return out


class Trie:
    """context (64 bits) -> word (41 bits) -> word before (41 bits). A pair has its quantised log10 p(w | v) and the weight that
    it gives to what follows it, -log10(c + MU3); a triple its quantised log10 numerator; a context its back-off weight."""

    def __init__(self, contexts, log_backoff, pair_context, words, pair_word, log_p, weight, triple_pair, us, triple_word, log_t):
        """contexts, pairs (index of a context, of one of words) and triples (index of a pair, of one of us) are sorted."""
        self.contexts = EliasFano(contexts, int(contexts[-1]) + 1 if len(contexts) else 1)
        self.pairs, self.triples = Level(len(contexts), pair_context, words, pair_word), Level(len(pair_word), triple_pair, us, triple_word)
        self.backoff, self.backoff_values = quantised(log_backoff)
        self.p, self.p_values = quantised(log_p)
        self.weight, self.weight_values = quantised(weight)
        self.t, self.t_values = quantised(log_t)
        self._map()

    def _map(self) -> None:
        """Move all levels into one memory-mapped file without a name (gone when the trie is)."""
        parts = [self.contexts, *self.pairs.parts(), *self.triples.parts()]
        places = [(t.levels, k) for t in parts for k in t.levels] + [(self.__dict__, k) for k in ("backoff", "p", "weight", "t")]
        with tempfile.TemporaryFile() as f:
            spans = []
            for table, k in places:
                f.write(bytes(-f.tell() % 8))
                spans.append(f.tell())
                f.write(table[k].tobytes())
            f.write(b"\0")
            f.flush()
            memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        for (table, k), at in zip(places, spans):
            table[k] = np.frombuffer(memory, table[k].dtype, len(table[k]), at)

    def query(self, contexts, words, pair_context, pair_word, log_p0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs, given as indexes of contexts and words: their index (-1: not there), log10 p(w | v), and weight. A context that is not
        there has the back-off weight 1."""
        found = self.contexts.find(contexts)
        pair = self.pairs.find(found[pair_context], words, pair_word)
        backoff = np.where(found >= 0, self.backoff_values[self.backoff[np.maximum(found, 0)]] if len(self.backoff) else 0.0, 0.0)
        hit = pair >= 0
        out, weight = backoff[pair_context] + log_p0, np.full(len(pair), -np.log10(MU3))
        out[hit], weight[hit] = self.p_values[self.p[pair[hit]]], self.weight_values[self.weight[pair[hit]]]
        return pair, out, weight

    def numerators(self, pair, words, which, log_p) -> np.ndarray:
        """log10(c(u v w) + MU3 * p(w | v)) of triples: index of the pair, u as words[which], log10 p(w | v)."""
        out = log_p + np.log10(MU3)
        at = self.triples.find(pair, words, which)
        hit = at >= 0
        out[hit] = self.t_values[self.t[at[hit]]]
        return out


END_HASH, START_HASH = xxhash.xxh3_64_intdigest(END), xxhash.xxh3_64_intdigest(START)


def _flushes(batches):
    """doc_ids, held_out, and the texts, lower-cased, of about BYTES_PER_FLUSH bytes."""
    ids, held, texts, n = [], [], [], 0
    for b in batches:
        for doc, out, text in zip(*(c.to_pylist() for c in b.columns)):
            ids.append(doc)
            held.append(out)
            texts.append(lowered(text))
            n += len(texts[-1]) + 1
            if n >= BYTES_PER_FLUSH:
                yield ids, np.array(held, bool), texts
                ids, held, texts, n = [], [], [], 0
    if ids:
        yield ids, np.array(held, bool), texts


def _words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, start, end and hash of each word, and the words of each text."""
    data = b" ".join(texts)
    starts, ends, hashes = word_hashes(data)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, in the order in which they come, and the index of each; by a hash table, as words come again often."""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _first(token: np.ndarray) -> np.ndarray:
    """Where each of _coded()'s values comes first."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(token), prepend=-1))


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the index of each."""
    values, at = _coded(x)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return values[order], rank[at]


def _distinct(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """As _ranked, for integers from 0 to below limit of which most come once: value and place are sorted as one number if they fit."""
    bits = len(x).bit_length()
    if limit << bits > 1 << 63:
        return _ranked(x)
    x = x.astype(np.int64) << bits
    x |= np.arange(len(x))
    x.sort()
    at = x & ((1 << bits) - 1)
    x >>= bits
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    index = np.empty(len(x), np.int32)
    index[at] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], index


def _spelling_cells(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and each word's end, a space: the cell (hash of the two bytes before, byte); and where words start."""
    lengths = ends - starts + 1
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
    spelled = np.frombuffer(data + b" ", np.uint8)[at].astype(np.int32)
    spelled[first + lengths - 1] = 32
    before, second = np.full_like(spelled, 32), np.full_like(spelled, 32)
    before[1:], second[2:] = spelled[:-1], spelled[:-2]
    second[first] = 32  # two spaces come before a word
    return ((second * 40503 + before * 30011) >> 3) % ROWS * 256 + spelled, first


def _counted(batches):
    """kind 0: word hash and count in training rows; kind 1: spelling cell and count, each word once a flush, in one batch at the end;
    kind 2: tokens, and all tokens at x = 1, training documents at x = 2."""

    def batch(kinds, xs, ns):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(kinds, [len(x) for x in xs]), pa.int32()), pa.array(np.concatenate(xs).astype(np.int64)), pa.array(np.concatenate(ns).astype(np.int64))], names=["kind", "x", "n"])

    spelled = np.zeros(ROWS * 256, np.int64)
    for ids, held, texts in _flushes(batches):
        data, starts, ends, hashes, n_words = _words(texts)
        n_all, train = len(ids) + len(hashes), np.repeat(~held, n_words)
        starts, ends, hashes = starts[train], ends[train], hashes[train]
        words, token = _coded(hashes)
        first = _first(token)
        if len(words):
            spelled += np.bincount(_spelling_cells(data, starts[first], ends[first])[0], minlength=len(spelled))
        yield batch([2, 0], [np.array([0, 1, 2]), words.view(np.int64)], [np.array([len(hashes) + int((~held).sum()), n_all, int((~held).sum())]), np.bincount(token, minlength=len(words))])
    cells = np.flatnonzero(spelled)
    if len(cells):
        yield batch([1], [cells], [spelled[cells]])


class Vocabulary:
    """What every task knows: corpus totals, frequent words with counts, the spelling model."""

    def __init__(self, tokens: int, types: int, docs: int, once: int, frequent: dict[int, int], cells: dict[int, int]):
        self.tokens, self.types, self.docs = tokens, types, docs
        table = {**frequent, START_HASH: docs, END_HASH: docs}
        self.hashes = np.array(sorted(table), np.uint64)
        self.counts = np.array([table[int(h)] for h in self.hashes], np.int64)
        p = self.counts / max(1, tokens)
        p[self.hashes == np.uint64(START_HASH)] = 0
        # left for words without a training count: as many tokens as there are words seen once
        self.rest = min(0.5, max(once / tokens, 1e-3)) if tokens else 0.5
        self.log_p0 = np.log10(np.maximum(p * (1 - self.rest), 1e-12))
        grid = np.full(ROWS * 256, 0.1)
        grid[np.fromiter(cells.keys(), np.int64, len(cells))] += np.fromiter(cells.values(), np.int64, len(cells))
        grid = grid.reshape(ROWS, 256)
        self.spelling = np.log10(grid / grid.sum(axis=1, keepdims=True)).ravel().astype(np.float32)
        self.even = 1.0 / max(1, once)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Index of a frequent word, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def rare(self, hashes: np.ndarray) -> np.ndarray:
        """Whether codes() is -1; a table by low bits settles most of them."""
        low = np.uint64((1 << 22) - 1)
        place = np.full(1 << 22, -1, np.int32)
        place[(self.hashes & low).astype(np.int64)] = np.arange(len(self.hashes), dtype=np.int32)
        found = place[(hashes & low).astype(np.int64)]
        out = (found < 0) | (self.hashes[found] != hashes)
        at = np.flatnonzero(out & (found >= 0))  # another word has the place
        out[at] = self.codes(hashes[at]) < 0
        return out

    def counted(self, n: np.ndarray) -> np.ndarray:
        """log10 p0 of words with these training counts."""
        return np.log10(n / self.tokens * (1 - self.rest))

    def spelled(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 p0 of words without a training count, in steps."""
        if not len(starts):
            return np.zeros(0, np.uint8)
        cells, starts = _spelling_cells(data, starts, ends)
        p = self.rest / 2 * (self.even + 10.0 ** np.add.reduceat(self.spelling[cells].astype(np.float64), starts))
        return np.clip(np.rint(-np.log10(p) / STEP), 0, 255).astype(np.uint8)  # the even part is far above the last step


def learn(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """texts: doc_id, held_out, text -> the vocabulary, and x (hash), n of all words. What comes to the driver: totals, FREQUENT words
    and ROWS * 256 spelling cells at most."""
    counts = materialise(texts.mapInArrow(_counted, "kind int, x long, n long").groupBy("kind", "x").agg(F.sum("n").alias("n")), "vocabulary")
    totals = {r["x"]: r["n"] for r in counts.filter("kind = 2").collect()}
    tokens, docs = totals.get(0, 0), totals.get(2, 0)
    words = counts.filter("kind = 0")
    frequent = {r["x"] & ((1 << 64) - 1): r["n"] for r in words.filter(F.col("n") * FREQUENT >= F.lit(tokens)).collect()}
    cells = {r["x"]: r["n"] for r in counts.filter("kind = 1").collect()}
    found = Vocabulary(tokens, words.count() + (docs > 0), docs, words.filter("n = 1").count(), frequent, cells)
    found.all_tokens = totals.get(1, 0)
    return found, words.select("x", "n")


_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    return _compressor.compress(b"".join(struct.pack("<cq", a.dtype.char.encode(), len(a)) + a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = _decompressor.decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<cq", data, at)
        out.append(np.frombuffer(data, np.dtype(kind.decode()), n, at + 9))
        at += 9 + out[-1].nbytes
    return out


def _low_high(x: np.ndarray, bits: int) -> list[np.ndarray]:
    x = x.astype(np.uint64)
    return [(x & np.uint64((1 << bits) - 1)).astype(np.uint16 if bits == 16 else np.uint32), (x >> np.uint64(bits)).astype(np.uint8)]


def _joined(parts, bits: int) -> np.ndarray:
    return next(parts).astype(np.int64) | next(parts).astype(np.int64) << bits


def _own_shard(x: np.ndarray, shards: int) -> np.ndarray:
    """By the high bits: the low ones (_LOW) tell the words of a shard apart."""
    return ((x >> np.uint64(40)).astype(np.uint32) % np.uint32(shards)).astype(np.int32)


def _tokens(hashes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes, then those that stand for a text's end and start; first place of each distinct word; and of each token (ends
    of texts are tokens) the index of its word, of its context and of the word before that."""
    uniq, words = _coded(hashes)
    token = np.insert(words, np.cumsum(n_words), len(uniq))
    starts = np.cumsum(n_words + 1)[:-1]
    before, second = np.full_like(token, len(uniq) + 1), np.full_like(token, len(uniq) + 1)
    before[1:] = token[:-1]
    before[starts] = len(uniq) + 1
    second[1:] = before[:-1]
    second[starts] = len(uniq) + 1
    return np.concatenate([uniq, np.array([END_HASH, START_HASH], np.uint64)]), _first(words), token, before, second


def _wanted(vocab, shards: int):
    """x (hash), shard: words that aren't frequent, and shards where they follow a context that isn't, and not the word's own; each
    once a flush."""

    def run(batches):
        for _, _, texts in _flushes(batches):
            _, _, _, hashes, n_words = _words(texts)
            rare = vocab.value.rare(hashes)
            after = rare[1:] & rare[:-1]
            starts = np.cumsum(n_words)[:-1]
            after[starts[(starts > 0) & (starts < len(hashes))] - 1] = False  # a text's first word follows its start
            at = np.flatnonzero(after)
            word, where = hashes[at + 1], _own_shard(hashes[at], shards)
            far = _own_shard(word, shards) != where
            order = np.lexsort((where[far], word[far]))
            word, where = word[far][order], where[far][order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (where[1:] != where[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(word[new].view(np.int64)), pa.array(where[new].astype(np.int32))], names=["x", "shard"])

    return run


def _requests(vocab, shards: int):
    """Blobs by shard: (document in the flush, word before the context, context, word) of each token; and one row with the flush's
    documents."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, (doc_ids, held, texts) in enumerate(_flushes(batches)):
            flush = (part << 24) + seq
            data, starts, ends, hashes, n_words = _words(texts)
            lengths = n_words + 1
            of_hash, first, token, before, second = _tokens(hashes, n_words)
            of_code = vocab.value.codes(of_hash).astype(np.int32)
            of_p0 = np.zeros(len(of_hash), np.uint8)
            doc = np.repeat(np.arange(len(doc_ids), dtype=np.int32), lengths)
            train = ~held[doc]
            trained = np.zeros(len(of_hash), bool)
            trained[token[train]] = True
            # the shard has the count of a word in training texts, so its spelling isn't asked for
            other = np.flatnonzero((of_code < 0) & ~trained)
            of_p0[other] = vocab.value.spelled(data, starts[first[other]], ends[first[other]])
            of_rare, of_low, of_own = of_code < 0, of_hash & np.uint64(_LOW), _own_shard(of_hash, shards)
            rare_c, rare_w = of_rare[before], of_rare[token]
            both = (of_hash[before] ^ (of_hash >> np.uint64(7))[token]) * np.uint64(0x9E3779B97F4A7C15)
            shard = np.where(rare_c, of_own[before], np.where(rare_w, of_own[token], _own_shard(both, shards)))
            group = shard * 4 + rare_c * 2 + rare_w
            del data, texts, starts, ends, hashes, both, rare_c, rare_w, shard
            # few distinct numbers: two bytes are sorted by counting
            order = np.argsort(group.astype(np.uint16) if 4 * shards <= 1 << 16 else group, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=4 * shards))])
            token, before, second, doc, train = token[order], before[order], second[order], doc[order], train[order]
            del group, order

            def blob(shard):
                """Four groups, as context and word are frequent or not: three bytes for a frequent one, eight for another context, five and
                the spelling probability for another word; a bit and as many bytes for the word before."""
                parts = []
                for i in range(4 * shard, 4 * shard + 4):
                    at = slice(bounds[i], bounds[i + 1])
                    word, context, two = token[at], before[at], second[at]
                    parts += [np.diff(doc[at], prepend=0).astype(np.uint32), np.packbits(train[at])]
                    parts += [of_hash[context]] if i & 2 else _low_high(of_code[context], 16)
                    parts += [*_low_high(of_low[word], 32), of_p0[word]] if i & 1 else _low_high(of_code[word], 16)
                    known = ~of_rare[two]
                    parts += [np.packbits(known), *_low_high(of_code[two[known]], 16), *_low_high(of_low[two[~known]], 32)]
                return _pack(*parts)

            out = [(flush, s, None, blob(s)) for s in np.flatnonzero(bounds[4::4] > bounds[:-4:4]).tolist()]
            meta = [(flush, int(flush % shards), doc_ids, _pack(lengths, held.astype(np.uint8)))]
            cols = list(zip(*out, *meta))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names=["flush", "shard", "ids", "data"])

    return run


_BLOBS = "flush long, shard int, ids array<long>, data binary"


def _scored(vocab):
    def run(batches):
        """All blobs of one shard, in one partition."""
        tables = [b for b in batches if b.num_rows]
        if tables:
            yield from scored(pa.Table.from_batches(tables)).to_batches()

    def scored(table: pa.Table) -> pa.Table:
        v = vocab.value
        far = table.filter(pc.is_valid(table["x"]))
        far_word, far_n = far["x"].to_numpy().view(np.uint64) & np.uint64(_LOW), far["n"].to_numpy()
        table = table.filter(pc.is_null(table["x"]))
        rows = list(zip(table["flush"].to_pylist(), table["shard"].to_pylist(), table["ids"].to_pylist(), table["data"].to_pylist()))
        out = [r for r in rows if r[2] is not None]
        which, docs, contexts, words, p0s, trains, seconds = [], [], [], [], [], [], []
        blobs = [r for r in rows if r[2] is None]
        del rows, table
        for k, row in enumerate(blobs):
            parts = iter(_unpack(row[3]))
            blobs[k] = row[:2]
            for fc in (True, False):
                for fw in (True, False):
                    doc = np.cumsum(next(parts), dtype=np.int64).astype(np.int32)
                    trains.append(np.unpackbits(next(parts), count=len(doc)).astype(bool))
                    contexts.append(v.hashes[_joined(parts, 16)] if fc else next(parts))
                    if fw:
                        code = _joined(parts, 16)
                        words.append(code.astype(np.uint64) | np.uint64(1 << 40))
                        p0s.append(v.log_p0[code].astype(np.float32))
                    else:
                        words.append(_joined(parts, 32).astype(np.uint64))
                        p0s.append((next(parts) * -STEP).astype(np.float32))
                    known = np.unpackbits(next(parts), count=len(doc)).astype(bool)
                    second = np.zeros(len(doc), np.uint64)
                    second[known] = _joined(parts, 16).astype(np.uint64) | np.uint64(1 << 40)
                    second[~known] = _joined(parts, 32).astype(np.uint64)
                    seconds.append(second)
                    docs.append(doc)
                    which.append(np.full(len(doc), k, np.int32))
        if blobs:
            which, doc, context, word, p0, train, second = (np.concatenate(x) for x in (which, docs, contexts, words, p0s, trains, seconds))
            docs = contexts = words = p0s = trains = seconds = None
            (contexts, c), (words, w), (us, u) = _ranked(context), _ranked(word), _ranked(second)
            word_p0 = np.empty(len(words))
            word_p0[w], p0 = p0, word_p0  # of each word from here on
            del context, word, second
            pairs, pair = _distinct(c.astype(np.int64) * len(words) + w, len(contexts) * len(words))
            del w
            triples, triple = _distinct(pair.astype(np.int64) * len(us) + u, len(pairs) * len(us))
            del pair, u
            (pair_c, pair_w), (triple_pair, triple_u) = np.divmod(pairs, len(words)), np.divmod(triples, len(us))
            times = np.bincount(triple[train], minlength=len(triples))
            seen = np.bincount(triple_pair, times, len(pairs)).astype(np.int64)
            counts = np.bincount(pair_c, seen, len(contexts)).astype(np.int64)
            code = v.codes(contexts)
            counts = np.where(code >= 0, v.counts[np.maximum(code, 0)], counts)
            # words of which this is the own shard were counted as contexts
            own = np.flatnonzero((code < 0) & (counts > 0))
            known_word, at = np.unique(np.concatenate([contexts[own] & np.uint64(_LOW), far_word]), return_index=True)
            known_n = np.concatenate([counts[own], far_n])[at]
            if len(known_word):
                at = np.minimum(np.searchsorted(known_word, words), len(known_word) - 1)
                hit = np.flatnonzero(known_word[at] == words)
                p0[hit] = v.counted(known_n[at[hit]])
            in_trie, of_pair = np.flatnonzero(counts > 0), np.flatnonzero(seen)
            log_p = np.log10((seen[of_pair] + MU * 10.0 ** p0[pair_w[of_pair]]) / (counts[pair_c[of_pair]] + MU))
            of_triple = np.flatnonzero(times)
            at = (np.cumsum(seen > 0) - 1)[triple_pair[of_triple]]
            log_t = np.log10(times[of_triple] + MU3 * 10.0 ** log_p[at])
            trie = Trie(
                contexts[in_trie], np.log10(MU / (counts[in_trie] + MU)), (np.cumsum(counts > 0) - 1)[pair_c[of_pair]], words, pair_w[of_pair], log_p, -np.log10(seen[of_pair] + MU3), at, us, triple_u[of_triple], log_t
            )
            index, log_p, weight = trie.query(contexts, words, pair_c, pair_w, p0[pair_w])
            log_t = trie.numerators(index[triple_pair], us, triple_u, log_p[triple_pair])
            # a text's first word has no word before its context; nothing follows a text's end
            real = contexts != np.uint64(START_HASH)
            log_t = np.where(real[pair_c[triple_pair]], log_t, log_p[triple_pair])
            ends = words[pair_w] == np.uint64(int(v.codes(np.array([END_HASH], np.uint64))[0]) | 1 << 40)
            score = (log_t + np.where(ends, 0.0, weight)[triple_pair])[triple]
            base = np.where(real, np.log10(counts + 1), 0.0)[c]
            known = (real & (counts > 0)).astype(np.float64)[c]
            bounds = np.searchsorted(which, np.arange(len(blobs) + 1))
            for k, (flush, shard) in enumerate(blobs):
                at = slice(bounds[k], bounds[k + 1])
                here = np.flatnonzero(np.bincount(doc[at]))
                sums = [np.bincount(doc[at], x[at])[here] for x in (base, score, known)]
                out.append((flush, shard, None, _pack(here.astype(np.uint32), sums[0], sums[1].astype(np.float32), sums[2].astype(np.uint32))))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names=["flush", "shard", "ids", "data"])

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(tokens: int, types: int, docs: int):
    below, end = np.log10(tokens + types + 1), np.log10(docs + 1)

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["ids"].to_pylist(), table["data"].to_pylist()))
        ids, data = next(r for r in rows if r[0] is not None)
        lengths, held = _unpack(data)
        base, score, known = np.full(len(ids), end), np.zeros(len(ids)), np.full(len(ids), int(docs > 0), np.int64)
        for x, data in rows:
            if x is None:
                at, b, s, k = _unpack(data)
                base[at] += b
                score[at] += s
                known[at] += k.astype(np.int64)
        cols = [pa.array(ids, pa.int64()), pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base - lengths * below), pa.array(score)]
        return pa.table(cols, names=[x.split()[0] for x in _RESULT.split(", ")])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text), learning from those whose crc32(doc_id as text) mod 7 is not 2."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    texts = docs.select("doc_id", held.alias("held_out"), "text")
    vocab, counts = learn(texts)
    shards = max(shuffle_partitions(docs.sparkSession), -(-vocab.all_tokens // TOKENS_PER_SHARD))
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    asked = texts.mapInArrow(_requests(shared, shards), _BLOBS).withColumns({"x": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    # a word that is wanted has less than a share of 1/FREQUENT, so no key is hot
    answers = texts.mapInArrow(_wanted(shared, shards), "x long, shard int").join(counts, "x")
    asked = asked.unionByName(answers, allowMissingColumns=True)
    # the shard's number is the partition's, so that each task has one shard; a hash of it would put several into some
    scored = asked.repartitionById(shards, "shard").mapInArrow(_scored(shared), _BLOBS)
    return scored.groupBy("flush").applyInArrow(_summed(vocab.tokens, vocab.types, vocab.docs), _RESULT)
