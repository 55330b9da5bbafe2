"""Registered queries by brute force, on small tables of their own."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from lodeseek.operators import fulltext, vector
from lodeseek.plans import registry


def test_whole_benchmark_items_are_asked(spark, tmp_path):
    items = {1: "the tall green house on a hill", 2: "green green house", 3: "no such words here"}
    texts = {1: "The tall house, green. On a hill! a", 2: "tall green only", 3: "green house green", 4: "a hill on the tall green house and so on", **{i: f"filler {i}" for i in range(5, 16)}}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "src1") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: re.findall(r"\w+", f"src1 {t}".lower()) for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for item, text in items.items():
        for doc, have in words.items():
            asked, rank = Counter(text.split()), 0.0
            for w, times in asked.items():
                n, f = sum(w in x for x in words.values()), have.count(w)
                idf = math.log((len(words) - n + 0.5) / (n + 0.5))
                rank -= times * max(idf, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(have) / mean))
            if set(asked) <= set(have):
                want[item, doc] = round(rank, 6)
    got = {(r["query_id"], r["chunk_id"]): round(r["rank"], 6) for r in registry.QUERIES["bm25_batch_queries"](spark, str(tmp_path)).collect()}
    assert got == want and {k for k in got if k[0] == 1} == {(1, 1), (1, 4)}


def test_copies_have_one_rank_whatever_the_order_of_its_parts(spark):
    words = [f"w{i}" for i in range(40)]
    times = {w: 1 + i % 7 for i, w in enumerate(words)}
    order = np.random.default_rng(3)
    rows = [(w, c, "content", list(range(times[w]))) for c in range(60) for w in order.permutation(words).tolist()]
    rows += [(w, 100 + i, "content", [0]) for i, w in enumerate(words)] + [("other", 200 + i, "content", [0]) for i in range(400)]
    index = spark.createDataFrame(rows, "term string, chunk_id long, col string, positions array<int>").coalesce(1)
    sizes = spark.createDataFrame([(c, 160 if c < 60 else 1) for c in sorted({r[1] for r in rows})], "chunk_id long, len long")
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, text string")
    got = fulltext.bm25_batch(index, sizes, asked, 100).collect()
    assert len(got) == 60 and len({r["rank"] for r in got}) == 1
    assert sorted(r["chunk_id"] for r in fulltext.bm25_batch(index, sizes, asked, 7).collect()) == list(range(7))


@pytest.mark.parametrize("name", ["store_search", "store_search_prefix_near"])
def test_all_hits_of_the_store_are_asked(spark, tmp_path, name):
    rows = [(c, t, "user", f"thble the th{c}x{t}") for c in range(1, 7) for t in range(3)] + [(1, 3, "user", "thbles then or that")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    want = {(f"conv_{c}.md", hashlib.md5((x + "!" * (c % 3 == 0 and t == 2)).encode()).hexdigest()) for c, t, _, x in rows if t < 3}
    assert {(r["file_path"], r["digest"]) for r in out.collect()} == want and out.count() == 18
    assert "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()  # any number of hits


def test_every_50th_vector_is_asked(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1300, 8)).astype("float32")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "t", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["knn_batch"](spark, str(tmp_path)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(q, int(c), n + 1) for q in range(0, 1300, 50) for n, c in enumerate(np.argsort(1 - unit[q] @ unit.T, kind="stable")[:10])}
    assert len(want) == 260 and {(r["query_id"], r["chunk_id"], r["place"]) for r in got} == want and len(got) == 260


def test_more_queries_than_a_batch_holds(spark, monkeypatch):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(23)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    whole = vector.search_batch(df, rows, 3).orderBy("query_id", "place").collect()
    monkeypatch.setattr(vector, "BATCH_QUERIES", 5)
    assert len(whole) == 69 and vector.search_batch(df, rows, 3).orderBy("query_id", "place").collect() == whole


def test_queries_of_a_table_in_blocks(spark, monkeypatch, tmp_path):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(23)] + [(50, [0.0, 0.0]), (51, [1.0, 0.0, 0.0]), (52, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = df.withColumnRenamed("chunk_id", "query_id")
    whole = vector.search_table(df, asked, 3, f"{tmp_path}/one").orderBy("query_id", "place").collect()
    assert {r["query_id"]: [x["chunk_id"] for x in whole if x["query_id"] == r["query_id"]][0] for r in whole if r["query_id"] < 23} == {i: i for i in range(23)}
    monkeypatch.setattr(vector, "BATCH_QUERIES", 5)
    assert vector.search_table(df, asked, 3, f"{tmp_path}/many").orderBy("query_id", "place").collect() == whole
    assert vector.search_table(df, asked.limit(0), 3, f"{tmp_path}/none").collect() == []


def test_pages_up_to_the_scanners_size(spark, tmp_path):
    pages = [None, "", "x", "é" * 2000, "a" * 1_048_576, "a" * 1_048_577, "é" * 524_289, "a\0b"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["size"], r["hash"]) for r in registry.QUERIES["scan_size_and_content"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(b := pages[i].encode()), hashlib.sha256(b).hexdigest()) for i in (2, 3, 4)}
