"""Toxicity and quality: held-out accuracy, spans, edges."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import quality, samples, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return d, l, {r["doc_id"]: (r["quality"], r["toxic"]) for r in l.collect()}


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_toxicity_on_held_out_documents(spark, labelled):
    d, l, known = labelled
    out = toxicity.op2_mil_toxicity(spark, SF).collect()
    assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in out)
    seen = [(r["predicted"], known[r["doc_id"]][1]) for r in out if r["held_out"] and r["doc_id"] in known]
    assert np.mean([p == y for p, y in seen]) >= 0.9
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in out:
        for s in r["offending"]:
            assert 0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) and s["score"] >= 0.5


def test_sentences_are_located():
    texts = ["Fine day here. You utter scum!\nAll good", "", "  ", "plain words only"] * 40
    y = [1, 0, 0, 0] * 40
    got = np.load(io.BytesIO(toxicity.fit(texts, y)))
    s = toxicity.Sentences(texts[:4])
    z = s.scores(got["weights"].astype(float), float(got["bias"]))
    start, end = s.spans()
    spans = [(s.doc[i], texts[s.doc[i]][start[i] : end[i]].strip()) for i in range(s.n)]
    assert (0, "You utter scum!") in spans and (0, "Fine day here.") in spans and (0, "All good") in spans
    assert toxicity.noisy_or(z, s.doc, 4)[0] > 0.5 > toxicity.noisy_or(z, s.doc, 4)[3]


def test_noisy_or_is_one_less_the_product():
    z, doc = np.array([0.3, -2.0, 1.0]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z, doc, 3) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])


def test_quality_on_held_out_documents(spark, labelled):
    d, _, known = labelled
    out = quality.op3_factorisation_quality(spark, SF).collect()
    assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in out)
    seen = [(r["predicted"], known[r["doc_id"]][0]) for r in out if r["held_out"] and r["doc_id"] in known]
    assert np.mean([p == y for p, y in seen]) >= 0.9


def test_pairwise_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    x = quality.Features(["One two two.\nThree | 4", "", "a b c d e f g"])
    w, v = rng.normal(size=quality.N), rng.normal(size=(quality.N, 4))
    got, _ = x.terms(w, v, 0, 3)
    for i in range(3):
        f, value = (a[x.first[i] : x.first[i + 1]] for a in (x.feature, x.value))
        pairs = sum(v[f[a]] @ v[f[b]] * value[a] * value[b] for a in range(len(f)) for b in range(a))
        assert got[i] == pytest.approx(w[f] @ value + pairs)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    rows = [(1, None), (2, ""), (3, "x " * 60_000), (3, "x " * 60_000), (None, "\x1e \n\n ."), (5, "é" * 9000)]
    df = spark.createDataFrame([(*r, 0.1, 9, "s") for r in rows], "doc_id long, text string, score double, predicted int, lang string")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, None), (2, 0, 0), (3, 1, 1), (3, 1, 1), (9, 3, 3)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        model = samples.fitted(samples.sample(df, lab, "toxic" if module is toxicity else "quality", 5, 0), module.fit)
        out = module.score(df, model).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    assert module.score(df.limit(0), model).count() == 0


def test_texts_of_a_sample_are_bounded_and_whole(spark):
    rows = spark.createDataFrame([(i, "x" * 10 ** (i % 4), i % 2) for i in range(40)] + [(40, None, 1)], "doc_id long, text string, y int")

    def fit(texts, ys):
        return repr(([len(t) for t in texts], ys)).encode()

    assert eval(samples.fitted(rows, fit)) == ([10 ** (i % 4) for i in range(40)] + [0], [i % 2 for i in range(40)] + [1])
    sizes, ys = eval(samples.fitted(rows, fit, 1500))
    assert len(sizes) == len(ys) and sum(sizes) <= 1500 and len(sizes) < 41 and set(sizes) <= {0, 1, 10, 100, 1000}
    assert samples.fitted(rows, fit, 1500) == samples.fitted(rows.orderBy(F.desc("doc_id")), fit, 1500)
    assert samples.fitted(rows.limit(0), fit) == b"([], [])"
