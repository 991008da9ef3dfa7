"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi over Aho-Corasick matches.

The automaton holds the vocabulary and runs over a text's pieces; at each match, dynamic programming keeps the best score of
the prefix that ends there and the number of pieces on that path. Pieces are split before each space sign, as the tokenizer's
pre-tokenizer does, and each distinct piece is counted once (cache of bounded size).

The tie rules are those of the Unigram model of the tokenizers library: a path replaces another only when its score is larger,
and candidates come from the longest match to the shortest; a character without a one-character match gets an unknown edge at
ten below the least score, tried last; an unknown character counts as its UTF-8 bytes where the vocabulary has all byte
pieces, else runs of unknown characters count once. Control, unknown and byte pieces are never matched by a text that spells them.

Defined cases: null and empty texts count 0; repeated rows are counted each; an empty table gives an empty table; no cap on
length: the state held is one number a position of one piece; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 500_000


class UnigramCounter:
    def __init__(self, vocab: list[tuple[str, float]], hidden: frozenset[int] | set[int] = frozenset()):
        """hidden: ids of pieces that no text matches."""
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece and i not in hidden:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for i, (p, _) in enumerate(vocab) if len(p) == 1 and i not in hidden}
        self.unknown = min(s for i, (_, s) in enumerate(vocab) if i not in hidden) - UNKNOWN_PENALTY
        self.pieces = {p for p, _ in vocab}
        self.has_bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.cache: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one pre-tokenized piece."""
        n = len(text)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        run = [False] * (n + 1)  # the best path to here ends in an unknown character
        singles, unknown = self.singles, self.unknown
        at = 0  # all positions up to here are final
        iterator = self.automaton.iter(text)
        match = next(iterator, None)
        for end in range(1, n + 1):
            top, count, last_unknown = None, 0, False
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                score += best[end - length]
                if top is None or score > top:
                    top, count = score, pieces[end - length] + 1
                match = next(iterator, None)
            ch = text[end - 1]
            if ch not in singles:
                score = best[end - 1] + unknown
                if top is None or score > top:
                    top, last_unknown = score, True
                    count = pieces[end - 1] + (len(ch.encode("utf-8", "surrogatepass")) if self.has_bytes else not run[end - 1])
            best[end], pieces[end], run[end] = top, count, last_unknown
        return pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        head, *rest = text.split(SPACE)
        total, cache = 0, self.cache
        if head:
            rest.insert(0, head)
        for w in rest:
            n = cache.get(w)
            if n is None:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = n = self.piece(SPACE + w)
            total += n
        return total


def read_vocab(path: str) -> tuple[list[tuple[str, float]], frozenset[int]]:
    """Pieces and scores of a sentencepiece model file in id order, and the ids of those that no text matches."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    hidden = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids], hidden


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*read_vocab(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and n_tokens; path: a sentencepiece model file that all executors have."""

    def run(batches):
        counter = _counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(counter.count, b.column(1).to_pylist()), pa.int64())], names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
