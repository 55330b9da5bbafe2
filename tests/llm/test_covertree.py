"""Top-k inner products against brute force."""

import numpy as np
import pytest

from lodeseek.llm import covertree


def brute(queries, vectors, k):
    out = []
    for q, a in dict(queries).items():
        near = sorted({(-int(np.dot(np.array(a, object), np.array(b, object))), i) for i, b in vectors if i != q and len(a) == len(b)})
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def ours(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("rows", [7, 64, 2048])
def test_equal_to_brute_force_with_ties_and_copies(spark, rows):
    rng = np.random.default_rng(rows)
    centres = rng.integers(-200, 200, (6, 12))
    x = (centres[rng.integers(0, 6, 400)] + rng.integers(-9, 9, (400, 12))).tolist()
    x[100:140] = [x[0]] * 40
    vectors = [*enumerate(x), (400, [1, 2, 3]), (401, [4, 5, 6]), (402, []), (403, [1 << 40] * 12)]
    vectors += vectors[:5]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>").repartition(3)
    queries = [v for v in vectors if v[0] % 7 == 0 or v[0] > 399]
    got = covertree.top_k(spark.createDataFrame(queries, "vec_id long, v array<long>"), df, 5, rows)
    assert ours(got) == brute(queries, vectors, 5)


def test_pruning_saves_comparisons():
    rng = np.random.default_rng(0)
    x = (rng.integers(-2000, 2000, (20, 8))[rng.integers(0, 20, 3000)] + rng.integers(-5, 5, (3000, 8))).astype(np.int64)
    best = covertree.Best(covertree.Tree(np.arange(3000), x), 5)
    assert covertree.search(best, covertree.Tree(np.arange(3000), x)) < 0.5 * 3000 * 3000


def test_tree_holds_its_invariants():
    rng = np.random.default_rng(2)
    x = (rng.integers(-2000, 2000, (30, 6))[rng.integers(0, 30, 2500)] + rng.integers(-40, 40, (2500, 6))).astype(np.int64)
    t = covertree.Tree(np.arange(2500), x)
    assert sorted(t.ids.tolist()) == list(range(2500)) and max(map(len, t.children)) > 4
    p, centres = t.points.astype(float), t.points[t.centre].astype(float)
    for i, kids in enumerate(t.children):
        own = p[t.first[i] : t.last[i]]
        assert np.isclose(np.sqrt(((own - centres[i]) ** 2).sum(axis=1)).max(), t.radius[i]) and t.radius[i] <= 2.0 ** t.level[i]
        if kids:
            assert [(t.first[c], t.last[c]) for c in sorted(kids, key=lambda c: t.first[c])][0][0] == t.first[i] and sum(t.last[c] - t.first[c] for c in kids) == len(own)
            assert all(t.radius[c] <= 2.0 ** (t.level[i] - 1) for c in kids)
            apart = np.sqrt(((centres[kids][:, None] - centres[kids][None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(kids))
            assert apart.min() > 2.0 ** (t.level[i] - 1) and 0 in np.sqrt(((centres[kids] - centres[i]) ** 2).sum(axis=1))


def test_blocks_that_cannot_reach_are_not_joined(spark):
    rng = np.random.default_rng(1)
    x = (rng.integers(-2000, 2000, (40, 8))[rng.integers(0, 40, 4000)] + rng.integers(-5, 5, (4000, 8))).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<long>")
    queries = df.where("vec_id % 50 = 0")
    met = []
    inner = covertree._hits
    try:
        covertree._hits = lambda pairs, *a: met.append(pairs.count()) or inner(pairs, *a)
        got = ours(covertree.top_k(queries, df, 5, 100))
    finally:
        covertree._hits = inner
    leaves = covertree._leaves(df, covertree.SAMPLE_ROWS)
    every = covertree.pairs_of_blocks(covertree._blocks(queries, leaves, 100), covertree._blocks(df, leaves, 100)).count()
    assert got == brute([(i, v) for i, v in enumerate(x) if i % 50 == 0], list(enumerate(x)), 5)
    print(met, every)
    assert len(leaves[8]) > 20 and sum(met) < 0.2 * every


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (50, [None, 1.0]), (100, [float("nan"), 1.0]), (1, [0.5, -0.001]), (2, None), (3, [float("inf"), 0.0]), (150, [1e300, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = {r["vec_id"]: r["v"] for r in covertree.quantised(df).collect()}
    assert got == {0: [256, 512], 1: [128, -1]}
    v = covertree.quantised(df)
    assert covertree.top_k(v.limit(0), v).count() == 0 and covertree.top_k(v, v.limit(0)).count() == 0
