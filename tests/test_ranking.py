"""Vectors, fusion, reranking."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import embedding, fusion, rerank, vector


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, None), (7, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = [(r["chunk_id"], round(r["distance"], 6)) for r in vector.search_vectors(df, [1.0, 0.0], 3).collect()]
    assert got == [(1, 0.0), (5, 0.0), (3, round(1 - 0.5**0.5, 6))]
    batch = vector.search_batch(df, [(9, [1.0, 0.0]), (8, [0.0, 3.0])], 2).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in batch] == [(8, 2), (8, 3), (9, 1), (9, 5)]


def lists(spark, rows):
    return spark.createDataFrame(rows, "source string, list_idx int, rank0 int, chunk_id long, score double")


def test_fusion_weights_ties_and_limits(spark):
    rows = [("bm25", 0, 0, 1, 0.9), ("bm25", 0, 1, 2, 0.8), ("bm25", 1, 0, 3, 0.7), ("vector", 0, 0, 2, 0.6), ("vector", 0, 1, 4, 0.5), ("bm25", 1, 1, 1, 0.95)]
    out = fusion.fuse(lists(spark, rows)).collect()
    assert [r["chunk_id"] for r in out] == [2, 1, 4, 3]
    assert out[0]["rrf"] == pytest.approx(2 / 62 + 2 / 61) and out[1]["rrf"] == pytest.approx(2 / 61 + 1 / 62)
    assert (out[1]["bm25"], out[1]["vector"], out[0]["vector"]) == (0.95, None, 0.6)
    assert fusion.fuse(lists(spark, rows), 2).count() == 2


def test_fusion_does_not_depend_on_row_order(spark):
    rows = [(s, i, r, random.Random(f"{s}{i}{r}").randrange(6), float(r)) for s, i, r in itertools.product(("bm25", "vector"), range(3), range(5))]
    rows = list({(x[0], x[1], x[3]): x for x in rows}.values())
    first = fusion.fuse(lists(spark, rows)).collect()
    assert fusion.fuse(lists(spark, rows[::-1]).repartition(5)).collect() == first


def test_blend(spark):
    rows = [(0, i, 1 / (61 + i), s) for i, s in enumerate([0.1, 0.9, 0.5, None, None])]
    df = spark.createDataFrame(rows, "k int, place int, score double, rerank double")
    out = [(r["place"], round(r["score"], 6)) for r in rerank.blended(df, 3, ["k"]).orderBy("position").collect()]
    want = []
    for i, s in enumerate([0.1, 0.9, 0.5]):
        p = i / 2
        want.append((i, round(((1 - p / 2) / (61 + i) + (0.5 + p / 2) * s) / 1.5, 6)))
    assert out == sorted(want, key=lambda x: -x[1]) + [(3, round(1 / 64, 6)), (4, round(1 / 65, 6))]


def test_replies(spark):
    df = spark.createDataFrame([("0.5, 2,abc,-1, .25 x", 7), (None, 2), ("1e-1,0.3", 1)], "r string, n int")
    assert [r[0] for r in df.select(rerank.parsed_scores(F.col("r"), F.col("n"))).collect()] == [[0.5, 1.0, 0.0, 0.0, 0.25, 0.0, 0.0], [0.0, 0.0], [0.1]]
    assert embedding.parse_scores("0.5, 2,abc,-1, .25 x", 7) == [0.5, 1.0, 0.0, 0.0, 0.25, 0.0, 0.0]
    reply = 'so: [{"type":"lex","text":" a "},{"type":"bad","text":"b"},{"type":"vec","text":"q"},{"type":"hyde"}] ok'
    for text in (reply, "nothing", "[broken", '[{"type":"lex","text":"x"}]'):
        got = spark.createDataFrame([(text,)], "r string").select(rerank.parsed_expansion(F.col("r"), F.lit(" q "))).first()[0]
        assert [(x["type"], x["text"]) for x in got] == rerank.parse_expansion(text, " q ")
    assert rerank.parse_expansion(reply, "q") == [("lex", "a")]


def test_batches():
    assert [list(b) for b in embedding.batches([])] == []
    assert [len(b) for b in embedding.batches(["a"] * 3000)] == [2048, 952]
    big = list(embedding.batches(["x" * 400_000] * 5))
    assert [len(b) for b in big] == [2, 2, 1] and sum(big, []) == [0, 1, 2, 3, 4]
    assert [len(b) for b in embedding.batches(["x" * 1_200_000, "y"])] == [1, 1]


def test_rejected_batches_are_halved_and_retries_wait():
    def ask(part):
        if "bad" in part:
            raise embedding.Rejected
        return [[1.0]] * len(part)

    assert embedding.embedded(["a", "bad", "b"], ask, 1) == [[1.0], [0.0], [1.0]]
    import urllib.error

    waits, tries = [], []

    def busy():
        tries.append(1)
        if len(tries) < 3:
            raise urllib.error.HTTPError("", 429, "", None, None)
        return "ok"

    assert embedding.retried(busy, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
