"""Toxicity by multiple-instance learning: only documents have labels, sentences get the scores.

A sentence's probability is the logistic of a bias plus the weights of its hashed words and word beginnings; a document's
is the noisy-or of its sentences, 1 - prod(1 - p). Both are learned together from the documents' labels.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, samples, words

SIZE, BEGINNINGS, ROUNDS, SUPPORT, LASSO, BIAS = 1 << 18, (4, 5, 6), 80, 3, 2e-4, -9.0
FOLDS, FOLD = 5, 0
_END = tuple(".!?")
_CLOSE = "\"')]»”"


class Sentences:
    """Sentences of some texts: they end at a word that ends in . ! or ?, and at line breaks."""

    def __init__(self, texts: list[str]):
        c = self.coded = words.Coded(texts)
        self.features = np.full((len(c.distinct), 1 + len(BEGINNINGS)), SIZE, np.int64)
        ends = np.zeros(len(c.distinct), bool)
        for i, w in enumerate(c.distinct):
            ends[i] = w == words.BREAK or w.rstrip(_CLOSE).endswith(_END)
            if b := words.bare(w):
                self.features[i, 0] = words.hashed(b, SIZE)
                for j, k in enumerate(BEGINNINGS, 1):
                    if len(b) >= k:
                        self.features[i, j] = words.hashed(f"{b[:k]}*", SIZE)
        after = ends[c.index]
        new = np.ones(len(c.index), bool)
        new[1:] = after[:-1]
        first = c.offsets[:-1][np.diff(c.offsets) > 0]
        new[first] = True
        self.of_word = np.cumsum(new) - 1
        self.n = int(self.of_word[-1]) + 1 if len(new) else 0
        self.first = np.flatnonzero(new)
        self.doc = c.doc[self.first]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        per_word = weights[self.features].sum(axis=1)
        return bias + words.summed(per_word[self.coded.index], self.of_word, self.n)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each sentence in its text, and the one after its last."""
        start = self.coded.where()
        last = np.append(self.first[1:], len(start)) - 1
        return start[self.first], start[last] + np.where(np.array([w == words.BREAK for w in self.coded.distinct], bool)[self.coded.index[last]], 0, self.coded.chars[last])


def noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) by document; 1 - p = 1 / (1 + e^z)."""
    return -np.expm1(-words.summed(np.logaddexp(0, np.clip(z, -40, 40)), doc, n))


def fit(texts: list[str], labels: list[int]) -> bytes:
    """Weights and bias as bytes; without both labels, a model that calls nothing toxic."""
    weights, bias = np.zeros(SIZE + 1), BIAS
    y = np.array(labels, float)
    if len(set(labels)) == 2:
        s, n = Sentences(texts), len(texts)
        c = s.coded
        pairs = np.unique(c.doc * np.int64(len(c.distinct)) + c.index)
        kinds = np.unique(np.repeat(pairs // len(c.distinct), s.features.shape[1]) * np.int64(SIZE + 1) + s.features[pairs % len(c.distinct)].ravel())
        seen = np.bincount(kinds % (SIZE + 1), minlength=SIZE + 1) >= SUPPORT
        seen[SIZE] = False
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        adam = words.Adam(0.15)
        b = np.array([bias])
        for _ in range(ROUNDS):
            z = s.scores(weights, b[0])
            p = np.clip(noisy_or(z, s.doc, n), 1e-9, 1 - 1e-12)
            slope = np.where(y == 1, -(1 - p) / p, 1.0) * weight
            dz = slope[s.doc] * words.logistic(z)
            g = np.zeros(SIZE + 1)
            by_word = np.bincount(c.index, dz[s.of_word], len(c.distinct))
            for j in range(s.features.shape[1]):
                g += np.bincount(s.features[:, j], by_word, SIZE + 1)
            g += LASSO * np.sign(weights)
            weights = adam.step("w", weights, g) * seen
            b = np.minimum(adam.step("b", b, np.array([dz.sum() * 0.1])), BIAS)
            adam.tick()
        weights[np.abs(weights) < 0.3] = 0
        bias = b[0]
    out = io.BytesIO()
    np.savez(out, weights=weights.astype(np.float32), bias=bias)
    return out.getvalue()


def score(documents: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and the sentences at or over ``threshold`` as spans of code points with their scores.

    Null and empty texts get the score of an empty sentence. One row out for each row in; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: SIZE weights

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.load(io.BytesIO(shared.value))
        weights, bias = got["weights"].astype(float), float(got["bias"])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b, texts in words.batches_of(batches):
            s = Sentences(texts)
            z = s.scores(weights, bias)
            p = noisy_or(z, s.doc, len(texts))
            start, end = s.spans()
            q = words.logistic(z)
            spans: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(q >= threshold).tolist():
                spans[s.doc[i]].append({"start": int(start[i]), "end": int(end[i]), "score": float(q[i])})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= threshold).cast(pa.int32()), pa.array(spans, span)], ["doc_id", "score", "predicted", "offending"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def op2_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (runtime.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = samples.fitted(samples.sample(documents, labels, "toxic", FOLDS, FOLD), fit)
    return score(documents, model).select("doc_id", samples.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted", "offending")
