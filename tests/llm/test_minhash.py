"""Near-duplicates against brute force over all pairs."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import minhash, shingles

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text). Component and set size of each row by comparing every pair."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or (rows[i][0] == rows[j][0] is not None and sets[i] and sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc) if doc is not None else None
    return sorted(((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def ours(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_components_equal_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = minhash.near_duplicates(df)
    assert ours(out) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


@pytest.mark.parametrize("rows_of_a_part", [minhash.PART_ROWS, 11])
def test_large_groups_of_near_copies_and_a_common_passage(spark, monkeypatch, rows_of_a_part):
    monkeypatch.setattr(minhash, "PART_ROWS", rows_of_a_part)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, passage, rows = word(60), word(30), []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 260):
        rows.append((i, " ".join(word(rng.integers(3, 30)) + passage + word(rng.integers(3, 30)))))
    for i in range(260, 280):
        rows.append((i, rows[i - 250][1].upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert ours(minhash.near_duplicates(df)) == brute(rows)


def test_every_pair_of_different_components_meets_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_ROWS", 5)
    rng = np.random.default_rng(8)
    shared = [f"s{x}" for x in rng.integers(0, 99999, 60)]
    # sets that share bands by a common passage, in three components and many single ones
    rows = [(i, " ".join(shared + [f"{i % 40 if i < 60 else i}x{k}" for k in range(30)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    inside = spark.createDataFrame([(0, 7, i) for i in range(80)], "band int, key long, class long")
    classes = spark.createDataFrame([(i, 86) for i in range(80)], "class long, n_shingles long")
    parts = spark.createDataFrame([(i, 0 if i < 50 else 50) for i in range(70)], "node long, component long")
    component = {i: 0 if i < 50 else 50 if i < 70 else i for i in range(80)}

    def pairs(group):
        at = group.select(["class", "component", "home", "asks", "other"]).to_pylist()
        return pa.table({k: pa.array([x[j] for x in [(i["class"], h["class"]) for i in at if i["asks"] for h in at if h["home"] and h["component"] != i["component"] and (not h["other"] or h["class"] > i["class"])]], pa.int64()) for j, k in enumerate("ab")})

    monkeypatch.setattr(minhash, "_unlinked", pairs)
    met = [tuple(sorted((r["a"], r["b"]))) for r in minhash._rest(inside, classes, parts, docs).collect()]
    assert sorted(met) == [(i, j) for i in range(80) for j in range(i + 1, 80) if component[i] != component[j]]


def test_nulls_short_texts_ties_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "É a b c d e"), (8, "é a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (None, "a b c d e")]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, component_id int, bands string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2, 7, True), (8, 2, 8, True), (9, 1, 9, True), (None, 1, 9, False)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17, 600])
def test_every_coordinate_is_filled_and_estimates_are_near(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    y = np.concatenate([x[: len(x) // 2], rng.integers(0, 1 << 62, len(x) - len(x) // 2).astype(np.uint64)])
    a, b = minhash.sketches([x, y])
    assert (a != minhash._FULL).all() and (b != minhash._FULL).all()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert n < 10 or abs((a == b).mean() - true) < 0.2


def test_shingle_hashes_separate_and_join_the_right_texts():
    a, b, c, d = shingles.shingle_sets(["a b c d e f", "A  b\nc d e f", "a b c d e  g", "ab"])
    assert list(a) == list(b) and len(np.intersect1d(a, c)) == 1 and len(d) == 1
