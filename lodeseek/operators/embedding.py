"""Embedding providers and their batches; language-model providers."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped, embedding_text
from .chunking import estimate

BATCH_TOKENS, BATCH_ITEMS, MOST_CHARACTERS = 250_000, 2048, 1_000_000
TRIES, FIRST_DELAY, RERANK_DOCUMENTS = 3, 1.0, 5


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def generate(self, prompt: str, temperature: float = 0.3, max_tokens: int = 512) -> str: ...

    def rerank(self, query: str, documents: Sequence[str]) -> list[float]: ...


def batches(texts: Sequence[str], tokens: int = BATCH_TOKENS, items: int = BATCH_ITEMS) -> Iterator[list[int]]:
    """Places of the texts in order, so many that neither bound is passed; a text over the bound is alone."""
    held: list[int] = []
    used = 0
    for i, t in enumerate(texts):
        cost = estimate(t[:MOST_CHARACTERS])
        if held and (used + cost > tokens or len(held) >= items):
            yield held
            held, used = [], 0
        held.append(i)
        used += cost
    if held:
        yield held


class Rejected(Exception):
    """A request that the provider won't take as it is."""


def retried(call: Callable[[], object], tries: int = TRIES, delay: float = FIRST_DELAY, sleep: Callable[[float], None] = time.sleep):
    """The call's result; it is tried again, after doubling waits, when the provider is busy or fails."""
    for i in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code == 400:
                raise Rejected(str(e)) from e
            if e.code != 429 and e.code < 500 or i == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if i == tries - 1:
                raise
        sleep(delay * 2**i)
    raise RuntimeError("no try was made")


def embedded(texts: Sequence[str], ask: Callable[[list[str]], list[list[float]]], dimensions: int) -> list[list[float]]:
    """Vectors in the order of the texts. A rejected batch is halved; a rejected text gets the zero vector."""

    def of(part: list[str]) -> list[list[float]]:
        try:
            return ask(part)
        except Rejected:
            if len(part) == 1:
                return [[0.0] * dimensions]
            half = len(part) // 2
            return of(part[:half]) + of(part[half:])

    cut = [t[:MOST_CHARACTERS] for t in texts]
    return [v for b in batches(cut) for v in of([cut[i] for i in b])]


class HttpEmbedder:
    """A remote embedder that speaks the common JSON protocol: {input, model, dimensions} to data[].{index, embedding}."""

    def __init__(self, model: str, dimensions: int, key_env: str, url: str):
        self.model, self.dimensions, self.key_env, self.url = model, dimensions, key_env, url

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        def ask(part: list[str]) -> list[list[float]]:
            reply = retried(lambda: _post(self.url, self.key_env, {"input": part, "model": self.model, "dimensions": self.dimensions}))
            return [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]

        return embedded(texts, ask, self.dimensions)


class HttpLanguageModel:
    """A remote chat model; documents are scored a few at a time, and a part that fails scores 0."""

    def __init__(self, model: str, key_env: str, url: str):
        self.model, self.key_env, self.url = model, key_env, url

    def generate(self, prompt: str, temperature: float = 0.3, max_tokens: int = 512) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        return retried(lambda: _post(self.url, self.key_env, body))["choices"][0]["message"]["content"]

    def rerank(self, query: str, documents: Sequence[str]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(documents), RERANK_DOCUMENTS):
            part = documents[i : i + RERANK_DOCUMENTS]
            try:
                out += parse_scores(self.generate(scoring_prompt(query, part), 0.0), len(part))
            except Exception:
                out += [0.0] * len(part)
        return out


def scoring_prompt(query: str, documents: Sequence[str]) -> str:
    listed = "\n\n".join(f"<document {i}>\n{d}\n</document {i}>" for i, d in enumerate(documents, 1))
    return f"How relevant is each document to the query? Answer with {len(documents)} numbers from 0 to 1, separated by commas, and nothing else.\n\nQuery: {query}\n\n{listed}"


def parse_scores(reply: str, n: int) -> list[float]:
    import re

    out = []
    for part in reply.split(","):
        m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", part)
        out.append(min(1.0, max(0.0, float(m[0]))) if m else 0.0)
    return (out + [0.0] * n)[:n]


def _post(url: str, key_env: str, body: dict) -> dict:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_env, '')}"}
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=60) as r:
        return json.load(r)


class HashEmbedder:
    """A local embedder without a model: signed counts of hashed words. The same text has the same vector everywhere."""

    model = "hashed-words"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


def embed_chunks(unembedded: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """chunk_id, embedding, model, embedded_at of chunks as ``incremental.unembedded`` has them; ``make`` runs in each task."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for b in rows:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            vectors = embedder.embed(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.model] * len(ids))], ["chunk_id", "embedding", "model"])

    text = capped(embedding_text(F.col("file_path"), F.col("language"), F.col("chunk_type"), F.col("name"), F.col("content")))
    out = unembedded.select("id", text.alias("text")).mapInArrow(task, "chunk_id long, embedding array<float>, model string")
    return out.withColumn("embedded_at", F.current_timestamp())
