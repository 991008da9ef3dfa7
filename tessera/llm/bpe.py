"""Byte-level BPE encoding by a traversal of the trie of distinct words, and decoding.

For byte-pair merges by rank, the last token of the encoding of a prefix fixes the rest: it is the one token t that ends the
prefix such that t may follow the last token of what stands before it, and two tokens may stand side by side exactly if
merging their joint bytes gives these two tokens again. So the state of a trie node is one token, computed from the states of
its ancestors, and an encoding is read off by walking back. The distinct words of a batch are visited in byte order, which is
the depth-first order of their trie: the path to the common prefix with the word before is kept, so states of shared
prefixes are computed once.

Encoded words are cached (bounded). Special tokens' strings in a text are found first, as the tokenizers library does.

What the file says of normaliser, pre-tokenizer, decoder and model is read; kinds that are not supported are refused.

Defined cases: null counts as empty (no ids, empty text); repeated rows are encoded each; an empty table gives an empty table;
other columns are ignored, so their names can't clash; long texts are encoded whole, word by word.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE = 400_000
#: The word pattern of a pre-tokenizer of the kind ByteLevel with use_regex (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _refuse(spec: dict) -> None:
    """A ValueError for a file whose encoding this module would not give."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    plain = {"dropout": (None, 0, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "fuse_unk": (None, False), "byte_fallback": (None, False), "ignore_merges": (None, False)}
    faults = [f"model.{k} is {model[k]}" for k, fits in plain.items() if k in model and model[k] not in fits]
    faults += [f"model is {model.get('type')}"] * (model.get("type", "BPE") != "BPE")
    faults += ["it has a normalizer"] * (spec.get("normalizer") is not None)
    faults += [f"pre_tokenizer is {before}"] * (before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True))
    faults += [f"decoder is {after}"] * (after.get("type") != "ByteLevel")
    faults += [f"added token {x['content']!r} has flags" for x in spec.get("added_tokens", ()) if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]
    if faults:
        raise ValueError("not supported: " + "; ".join(faults))


class BytePairs:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse(spec)
        to_byte = byte_chars()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        model = spec["model"]
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, result
        self.parts: dict[int, tuple[int, int]] = {}  # token: the pair it is merged from
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[as_bytes(s)] for s in (pair if isinstance(pair, list) else pair.split(" ")))
            c = self.ids[self.bytes[a] + self.bytes[b]]
            self.merges.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (a, b))
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank."""
        out = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(out) > 1:
            rank, i, c = min(((*self.merges.get((a, b), (1 << 60, -1))[:1], i, self.merges.get((a, b), (0, -1))[1]) for i, (a, b) in enumerate(zip(out, out[1:]))), default=(1 << 60, 0, -1))
            if rank == 1 << 60:
                break
            out[i : i + 2] = [c]
        return out

    def _rank(self, token: int) -> int:
        return self.merges[self.parts[token]][0] if token in self.parts else -1

    def adjoin(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joint bytes is a, b.

        While both are merged together from their bytes, the seam lies between some right end of a and some left end of b. A
        merge across the seam happens if its rank is less than that of the merge which next takes one of these ends into a
        larger token. So go back over both histories from the last merge on."""
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        x, y = a, b
        # ranks of the merges that took x and y up; none yet for the whole tokens
        up_x = up_y = 1 << 60
        ok = True
        while True:
            across = self.merges.get((x, y))
            # on equal places the left merge comes first, so an equal rank goes to the merge inside a, but not to one inside b
            if across is not None and across[0] < up_x and across[0] <= up_y:
                ok = False
                break
            rx, ry = self._rank(x), self._rank(y)
            if rx < 0 and ry < 0:
                break
            # undo the later merge: of equal ranks, the right one
            if rx > ry:
                up_x, x = rx, self.parts[x][1]
            else:
                up_y, y = ry, self.parts[y][0]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, sharing the work on common prefixes."""
        out: dict[bytes, list[int]] = {}
        ids, adjoin, longest = self.ids, self.adjoin, self.longest
        last: list[int] = [-1]  # of each prefix of the current path: its last token; the root has none
        size: list[int] = [0]  # and that token's length
        before = b""
        for word in sorted(words):
            same, top = 0, min(len(before), len(word))
            while same < top and before[same] == word[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    t = ids.get(word[start:end])
                    if t is not None and (not start or adjoin(last[start], t)):
                        last.append(t)
                        size.append(end - start)
                        break
            before = word
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= size[at]
            out[word] = tokens[::-1]
        return out

    def _words(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[str, int, bytes]]]:
        """Of each text: for each of its words the ids (as text, joined by commas), their number, the decoded bytes."""
        split = [self._words(t) if t else [] for t in texts]
        cache, new = self.cache, set()
        if len(cache) > CACHE:
            cache.clear()
        for words in split:
            new.update(w for w in words if w not in cache)
        for s, i in self.special.items():
            if s in new:
                new.remove(s)
                cache[s] = (str(i), 1, self.bytes[i])
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in new}
        for b, tokens in self.encode_words(list(by_bytes)).items():
            cache[by_bytes[b]] = (",".join(map(str, tokens)), len(tokens), b"".join([self.bytes[t] for t in tokens]))
        return [[cache[w] for w in words] for words in split]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for w in self.encode_batch([text])[0] for i in w[0].split(",")]

    def decode(self, tokens: list[int]) -> str:
        return b"".join(self.bytes[t] for t in tokens).decode("utf-8", "replace")


_models: dict[str, BytePairs] = {}


def model(path: str) -> BytePairs:
    if path not in _models:
        _models[path] = BytePairs(path)
    return _models[path]


#: Rows of one pass over the trie; long texts make shorter passes.
ROWS, CHARS = 2_000, 4_000_000


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; path: a tokenizer file that all executors have."""

    def run(batches):
        pairs = model(path)

        def passed(ids, texts):
            out = ([], [], [])
            for words in pairs.encode_batch(texts):
                out[0].append(sum([w[1] for w in words]))
                out[1].append(hashlib.sha256(",".join([w[0] for w in words]).encode()).hexdigest())
                decoded = b"".join([w[2] for w in words]).decode("utf-8", "replace")
                out[2].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
                if len(ids) >= ROWS or size >= CHARS:
                    yield passed(ids, texts)
                    ids, texts, size = [], [], 0
            yield passed(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
