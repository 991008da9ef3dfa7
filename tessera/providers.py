"""Model calls behind one interface. The default is offline and deterministic: what the engine falls back to without a model."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider:
    """Override what a model is there for. Instances are sent to executors, so they must pickle."""

    name = "offline"

    def complete(self, prompt: str, system: str = "", max_tokens: int = 2000) -> str:
        return ""

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        return [None] * len(texts)

    def describe_image(self, name: str, content: bytes) -> str:
        return f"[image: {name}]"


class Chain(Provider):
    """Providers in turn; the first answer that isn't empty."""

    name = "chain"

    def __init__(self, *providers: Provider):
        self.providers = providers

    def complete(self, prompt: str, system: str = "", max_tokens: int = 2000) -> str:
        for p in self.providers:
            try:
                if out := p.complete(prompt, system, max_tokens):
                    return out
            except Exception:  # the next one answers
                continue
        return ""


class HashEmbedding(Provider):
    """Terms hashed into signed buckets, at unit length: a stand-in with the right shape, for tests and dry runs."""

    name = "hash"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(self.dims)
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


class Http(Provider):
    """A model behind HTTP with JSON. A subclass says what is sent where, and where the text of the answer is."""

    timeout = 180

    def __init__(self, url: str, model: str, key: str = ""):
        self.url, self.model, self.key = url.rstrip("/"), model, key

    def request(self, prompt: str, system: str, max_tokens: int) -> tuple[str, dict]:
        raise NotImplementedError

    def text(self, answer: dict) -> str:
        raise NotImplementedError

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}

    def complete(self, prompt: str, system: str = "", max_tokens: int = 2000) -> str:
        path, body = self.request(prompt, system, max_tokens)
        asked = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers()})
        with urllib.request.urlopen(asked, timeout=self.timeout) as r:
            return self.text(json.load(r)) or ""


class ChatCompletions(Http):
    """Servers with a chat completions end point."""

    name = "chat"

    def request(self, prompt: str, system: str, max_tokens: int) -> tuple[str, dict]:
        told = [{"role": "system", "content": system}] if system else []
        return "/chat/completions", {"model": self.model, "max_tokens": max_tokens, "messages": [*told, {"role": "user", "content": prompt}]}

    def text(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]


class Generate(Http):
    """Servers with a plain generate end point."""

    name = "generate"

    def request(self, prompt: str, system: str, max_tokens: int) -> tuple[str, dict]:
        return "/api/generate", {"model": self.model, "prompt": prompt, "system": system, "stream": False, "options": {"num_predict": max_tokens}}

    def text(self, answer: dict) -> str:
        return answer["response"]


class Messages(Http):
    """Servers with a messages end point, whose system prompt stands apart."""

    name = "messages"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key} if self.key else {}

    def request(self, prompt: str, system: str, max_tokens: int) -> tuple[str, dict]:
        return "/messages", {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}], **({"system": system} if system else {})}

    def text(self, answer: dict) -> str:
        return "".join(x.get("text", "") for x in answer["content"])


def complete_json(provider: Provider, prompt: str, system: str = "", max_tokens: int = 2000) -> dict:
    """The answer's outermost JSON object; an empty one where there is none."""
    answer = provider.complete(prompt, system, max_tokens)
    start, end = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[start : end + 1]) if 0 <= start < end else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def completions(df: DataFrame, prompt: Column, provider: Provider, out: str = "answer") -> DataFrame:
    """df with the provider's answer to each row's prompt, in Arrow batches."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda p: provider.complete(p), na_action="ignore")

    return df.withColumn(out, ask(prompt))


def embeddings(df: DataFrame, text: Column, provider: Provider, out: str = "embedding", batch: int = 32) -> DataFrame:
    """A batch that fails is tried row by row; a row that fails gets null."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        done: list = []
        for i in range(0, len(s), batch):
            part = s.iloc[i : i + batch].tolist()
            try:
                got = provider.embed(part)
                if len(got) != len(part):
                    raise ValueError("count")
            except Exception:
                got = [_alone(provider, t) for t in part]
            done += got
        return pd.Series(done)

    return df.withColumn(out, embed(text))


def _alone(provider: Provider, text: str):
    try:
        return provider.embed([text])[0]
    except Exception:
        return None


# Prompts: what each call site asks, with the caps on what it is given.
PROMPTS: dict[str, Callable[..., Column]] = {
    "context": lambda doc, chunk: F.concat(F.lit("Place this passage in its document in two sentences.\nDocument:\n"), F.substring(doc, 1, 3000), F.lit("\nPassage:\n"), chunk),
    "entities": lambda text: F.concat(F.lit('List entities and relationships as JSON {"entities": [], "relationships": []}.\n'), F.substring(text, 1, 4000)),
    "hypothesis": lambda query: F.concat(F.lit("Write a passage of 200 to 400 words that answers: "), query),
    "decompose": lambda query: F.concat(F.lit('Split into at most four sub-queries, as JSON {"sub_queries": [{"query": "", "query_type": "", "depends_on": null}]}: '), query),
    "relevance": lambda query, text: F.concat(F.lit("Rate from 0 to 10 how well the passage answers the query.\nQuery: "), query, F.lit("\nPassage: "), F.substring(text, 1, 500)),
    "rewrite": lambda query, failed: F.concat(F.lit("Rewrite the query, which found only: "), F.substring(failed, 1, 450), F.lit("\nQuery: "), query),
    "summary": lambda texts: F.concat(F.lit("Summarise in at most 500 words:\n"), F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 800)), "\n\n")),
    "question": lambda text: F.concat(F.lit("Write a question that this passage answers, and the answer, as JSON.\n"), F.substring(text, 1, 3000)),
    "faithfulness": lambda answer, context: F.concat(F.lit("Rate from 0 to 1 how far the context supports the answer.\n"), F.substring(context, 1, 2000), F.lit("\nAnswer: "), answer),
}


def rating(answer: Column, default: float, top: float = 10.0) -> Column:
    """A number from an answer, cut to [0, top] and scaled to [0, 1]."""
    n = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n != "", n.cast("double")).otherwise(default) / top))
