"""Quality by a factorisation machine over hashed words, statistics of structure, and lengths.

score = logistic(b + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the pairwise interactions of all
features in time linear in a document's features. Statistics and lengths enter as one feature a range of values.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, samples, words

SIZE, FACTORS, EPOCHS, BATCH, RANGES = 1 << 15, 8, 12, 128, 10
FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
#: Borders of the ranges of each statistic: shares lie in 0..1, lengths are logarithms.
_SHARE = np.array([0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
_LOG = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.5])
STATS = [("upper", _SHARE), ("digit", _SHARE), ("punctuation", _SHARE), ("symbol", _SHARE), ("bar", _SHARE), ("distinct", _SHARE), ("repeat", _SHARE), ("top", _SHARE), ("lines", _SHARE), ("stops", _SHARE), ("ended", _SHARE), ("word_length", _LOG / 1.5), ("n_words", _LOG), ("n_lines", _LOG / 1.5), ("line_length", _LOG)]
N = SIZE + len(STATS) * RANGES
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b" \t\r\n"]


class Features:
    """x as sparse rows: ``row`` (sorted), ``feature``, ``value``."""

    def __init__(self, texts: list[str]):
        c, n = words.Coded(texts), len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.concatenate([[0], np.cumsum(size)])
        table = np.zeros(256, np.uint8)
        for k, chars in enumerate(_CLASSES, 1):
            table[list(chars)] = k
        kinds = table[data]
        share = {}
        for k, name in enumerate(("upper", "digit", "punctuation", "symbol", "bar"), 1):
            upto = np.concatenate([[0], np.cumsum(kinds == k)])
            share[name] = (upto[owner[1:]] - upto[owner[:-1]]) / np.maximum(size, 1)
        plain = [words.bare(w) for w in c.distinct]
        real = np.array([bool(w) for w in c.distinct], bool) & np.array([w != words.BREAK for w in c.distinct], bool)
        ended = np.array([w.endswith((".", "!", "?")) for w in c.distinct], bool)
        feature = np.array([words.hashed(w, SIZE) if w else SIZE for w in plain], np.int64)
        keep = real[c.index]
        doc, index, chars = c.doc[keep], c.index[keep], c.chars[keep]
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        pairs, times = np.unique(doc * np.int64(max(1, len(c.distinct))) + index, return_counts=True)
        of = pairs // max(1, len(c.distinct))
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (index[1:] == index[:-1])
        top = np.zeros(n)
        np.maximum.at(top, of, times)
        lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
        n_lines = np.array([len(x) for x in lines])
        short = np.bincount(doc, chars <= 3, n)
        share |= {
            "distinct": np.bincount(of, minlength=n) / count, "repeat": np.bincount(doc, same, n) / count, "top": top / count, "stops": short / count, "ended": np.bincount(doc, ended[index], n) / count,
            "lines": np.array([1 - len(set(x)) / max(1, len(x)) for x in lines]), "word_length": np.log1p(np.bincount(doc, chars, n) / count), "n_words": np.log1p(np.bincount(doc, minlength=n)), "n_lines": np.log1p(n_lines), "line_length": np.log1p(size / np.maximum(n_lines, 1)),
        }
        f = feature[pairs % max(1, len(c.distinct))]
        known = f < SIZE
        word_key = np.unique(of[known] * np.int64(N) + f[known])
        w_doc, w_feature = word_key // N, word_key % N
        w_value = 0.5 / np.sqrt(np.maximum(np.bincount(w_doc, minlength=n), 1))[w_doc]
        s_feature = np.stack([SIZE + i * RANGES + np.digitize(share[name], borders) for i, (name, borders) in enumerate(STATS)], axis=1)
        row = np.concatenate([w_doc, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(row, kind="stable")
        self.n = n
        self.row = row[order]
        self.feature = np.concatenate([w_feature, s_feature.ravel()])[order]
        self.value = np.concatenate([w_value, np.full(n * len(STATS), 0.5)])[order]
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    @classmethod
    def of_many(cls, texts: list[str]) -> Features:
        """As of all texts, made part by part."""
        parts, at = [], 0
        while at < len(texts):
            to, room = at, words.BATCH_BYTES
            while to < len(texts) and (to == at or room >= len(texts[to])):
                room -= len(texts[to])
                to += 1
            parts.append((at, cls(texts[at:to])))
            at = to
        out = cls.__new__(cls)
        out.n = len(texts)
        out.row = np.concatenate([p.row + o for o, p in parts]).astype(np.int32)
        out.feature = np.concatenate([p.feature for _, p in parts]).astype(np.int32)
        out.value = np.concatenate([p.value for _, p in parts])
        out.first = np.searchsorted(out.row, np.arange(out.n + 1))
        return out

    def terms(self, w: np.ndarray, v: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows a .. b: the sum without the bias, and sum v_if x_i. Every row has features."""
        at = slice(self.first[a], self.first[b])
        starts = self.first[a:b] - self.first[a]
        x = self.value[at]
        vx = v[self.feature[at]] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return np.add.reduceat(w[self.feature[at]] * x, starts) + 0.5 * ((s * s).sum(axis=1) - squares), s


def fit(texts: list[str], labels: list[int]) -> bytes:
    """The machine as bytes; without both labels it scores every text by the share of label 1 (0.5 without labels)."""
    y = np.array(labels, float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    w, v, bias = np.zeros(N), np.zeros((N, FACTORS)), np.log(share / (1 - share))
    if len(set(labels)) == 2:
        rng = np.random.default_rng(7)
        x = Features.of_many(texts)
        rare = np.bincount(x.feature, minlength=N) < 3
        x.value = np.where(rare[x.feature], 0.0, x.value)
        v = rng.normal(0, 0.05, (N, FACTORS))
        # classes count as in the population's rough shares of four to one, for a probability against THRESHOLD
        weight = np.where(y == 1, 1.5 / max(1, y.sum()), 1.0 / max(1, (1 - y).sum())) * len(y) / 2
        gw, gv, b, rate = np.full(N, 1e-6), np.full((N, FACTORS), 1e-6), bias, 0.15
        for epoch in range(EPOCHS):
            starts = np.arange(0, len(texts), BATCH)
            rng.shuffle(starts)
            for a in starts.tolist():
                to = min(a + BATCH, len(texts))
                z, s = x.terms(w, v, a, to)
                d = (words.logistic(z + b) - y[a:to]) * weight[a:to] / (to - a)
                at = slice(x.first[a], x.first[to])
                f, value, r = x.feature[at], x.value[at], x.row[at] - a
                dw = d[r] * value
                dv = dw[:, None] * (s[r] - v[f] * value[:, None])
                kinds, where = np.unique(f, return_inverse=True)
                sw = np.bincount(where, dw) + 1e-4 * w[kinds]
                sv = np.stack([np.bincount(where, dv[:, k]) for k in range(FACTORS)], axis=1) + 1e-4 * v[kinds]
                gw[kinds] += sw * sw
                gv[kinds] += sv * sv
                w[kinds] -= rate * sw / np.sqrt(gw[kinds])
                v[kinds] -= 0.3 * rate * sv / np.sqrt(gv[kinds])
                b -= 0.05 * d.sum()
        bias = b
        w[rare] = 0
        v[rare] = 0
    out = io.BytesIO()
    np.savez(out, w=w.astype(np.float32), v=v.astype(np.float32), bias=bias)
    return out.getvalue()


def scores(texts: list[str], w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
    x = Features(texts)
    return words.logistic(x.terms(w, v, 0, x.n)[0] + bias)


def score(documents: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``documents`` but score and predicted, and those two. Null text counts as empty; one row for each row in."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: N weights and factors
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*kept)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.load(io.BytesIO(shared.value))
        w, v, bias = got["w"].astype(float), got["v"].astype(float), float(got["bias"])
        for b, texts in words.batches_of(batches):
            p = scores(texts, w, v, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(p >= threshold).cast(pa.int32())], [*b.schema.names, "score", "predicted"])

    schema = rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return rows.mapInArrow(task, schema)


def trained(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> bytes:
    return samples.fitted(samples.sample(documents, labels, "quality", folds, fold), fit)


def op3_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (runtime.table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = score(documents.select("doc_id", "text"), trained(documents, labels))
    return out.select("doc_id", samples.held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
