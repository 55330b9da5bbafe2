"""Line deduplication and decontamination against their SQL and by cases."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, lines, queries

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, got = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


def brute_lines(docs, window, chars):
    """Lines covered by a qualifying run that occurs before, by trying all runs."""
    seqs = {d: [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")] for d, t in docs}
    seen, gone = {}, set()
    for d in sorted(seqs):
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = tuple(x for _, x in s[a:b])
                if len(run) >= window or sum(map(len, run)) >= chars:
                    if run in seen and seen[run] != (d, a):
                        gone |= {(d, i) for i, _ in s[a:b]}
                    seen.setdefault(run, (d, a))
    return gone


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = ["a", "b", " a ", "c" * 12, "d" * 25, "", "e", "f"]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(1, 14)))) for i in range(60)]
    gone = brute_lines(docs, 3, 20)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(df, 3, 20).collect()} == want


def test_fingerprints_are_the_minima_of_all_windows(spark):
    rng = np.random.default_rng(6)
    docs = [(i, "\n".join(rng.choice([f"w{k}" for k in range(50)], rng.integers(1, 60)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["place"]) for r in lines.fingerprints(df, 6, 10**6).collect()}
    h = {r["x"]: r["h"] for r in spark.createDataFrame([(f"w{k}",) for k in range(50)], "x string").selectExpr("x", "xxhash64(x) h").collect()}
    want = set()
    for d, t in docs:
        s = [h[x] for x in t.split("\n")]
        for a in range(len(s) - 5):
            want.add((d, max(i for i in range(a, a + 6) if s[i] == min(s[a : a + 6]))))
    assert got == want and len(got) < 0.45 * sum(max(0, t.count("\n") - 4) for _, t in docs)


def test_lines_are_found_by_their_fingerprints_alone(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne")], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.drop_repeated_lines(df).collect()) == ["a\nb\nc\nd", "e"]
    prints = lines.fingerprints
    monkeypatch.setattr(lines, "fingerprints", lambda *a: prints(*a).where("place <> 1 AND place <> 2 AND place <> 0"))
    assert sorted(r["text"] for r in lines.drop_repeated_lines(df).collect()) == ["a\nb\nc\nd", "a\nb\nc\ne"]


def test_line_edges(spark):
    long = "\n".join(f"line number {i} of the passage" for i in range(2000))
    docs = [(1, long), (2, f"own\n{long}\nend"), (3, None), (4, ""), (5, "\n\n"), (6, "short\nshort"), (7, "x"), (7, "x"), (None, "q\nr\ns"), (9, "q\nr\ns")]
    df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, n_removed int, _gone string")
    out = lines.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "_gone", "n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str)
    want = [(1, long, 0), (2, "own\nend", 2000), (3, None, 0), (4, "", 0), (5, "\n\n", 0), (6, "short\nshort", 0), (7, "x", 0), (7, "x", 0), (None, "q\nr\ns", 0), (9, "", 3)]
    assert got == sorted(want, key=str)
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_decontamination_cases(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 9999, n)]
    item, other = word(40), word(40)
    edited = list(item)
    edited[20] = "changed"
    docs = {
        1: word(500) + item + word(500), 2: word(30) + [w.upper() for w in item] + word(3), 3: word(50) + edited + word(50), 4: item[:36], 5: word(200) + item[:20] + word(100),
        6: word(300), 7: item + word(20) + other + word(9) + item, 8: word(9000) + other, 9: item[:20] + ["in", "the", "middle"] + item[20:],
    }
    rows_ = [(d, " ".join(w)) for d, w in docs.items()] + [(10, None), (11, ""), (12, "tiny item"), (13, "a tiny  ITEM b"), (1, " ".join(docs[1])), (None, " ".join(docs[1]))]
    items = [(100, " ".join(item)), (101, " ".join(other)), (102, "Tiny item"), (103, None), (104, " "), (100, " ".join(item))]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows_], "doc_id long, text string, similarity double, item_id string")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 4)) for r in decontaminate.contamination(df, bench).collect()}
    assert set(got) == {(1, 100), (2, 100), (3, 100), (4, 100), (7, 100), (7, 101), (8, 101), (12, 102), (13, 102), (None, 100)}  # 9: 29 of 36 shingles, 0.67
    assert got[1, 100] == (500, 40, 1.0) and got[7, 100][0] == 0 and got[4, 100] == (0, 36, round(32 / 36, 4)) and got[13, 102] == (1, 2, 1.0)
    assert got[3, 100] == (50, 40, round(31 / 41, 4))
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).count() == 0


def test_all_texts_of_an_item_are_searched(spark):
    passages = [" ".join(f"{w}{k}" for k in range(12)) for w in ("ask", "say", "nil", "void")]
    bench = spark.createDataFrame([(1, passages[0]), (1, passages[1]), (1, passages[1].upper()), (1, "tiny words"), (None, passages[2]), (None, passages[3])], "item_id long, text string")
    docs = [(i, f"some words {p} at the end") for i, p in enumerate(passages)] + [(4, f"a {passages[0]} b c {passages[1]}"), (5, f"so tiny words {passages[0]} z"), (6, "tiny words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["start"], r["n_words"], r["similarity"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == [(0, 1, 2, 12, 1.0), (1, 1, 2, 12, 1.0), (2, 0, 2, 12, 1.0), (3, 0, 2, 12, 1.0), (4, 1, 1, 12, 1.0), (5, 1, 1, 2, 1.0), (6, 1, 0, 2, 1.0)]


def test_windows_that_differ_by_a_repeated_shingle(spark):
    rest = [" ".join(f"r{i}x{k}" for k in range(86)) for i in range(8)]
    bench = spark.createDataFrame([(i, "mo " * 14 + "na " * 4 + r) for i, r in enumerate(rest)], "item_id long, text string")
    df = spark.createDataFrame([(i, "na " * 18 + r) for i, r in enumerate(rest)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["n_words"], r["similarity"]) for r in decontaminate.contamination(df, bench).collect())
    assert got == [(i, i, 0, 104, 86 / 114) for i in range(8)]


def test_simhash_finds_the_windows_and_spares_the_rest(spark):
    """Recall of the fingerprints against all pairs of windows and items, and the share of pairs that they let through."""
    rng = np.random.default_rng(12)
    items, docs = [], []
    for i in range(60):
        n = int(rng.integers(12, 70))
        words = [f"w{x}" for x in rng.integers(0, 400, n)]
        if i % 5 == 0:
            words[3:9] = ["so"] * 6
        items.append((i, " ".join(words)))
        for k in range(4):
            edited = list(words)
            for _ in range(k):
                edited[int(rng.integers(0, n))] = "changed"
            own = [f"x{x}" for x in rng.integers(0, 400, 40)]
            docs.append((4 * i + k, " ".join(own + edited + own[::-1])))
    split = {i: t.split() for i, t in items}
    want, near = set(), 0

    def bag(w):
        return Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))

    for d, t in docs:
        w = t.split()
        for i, x in split.items():
            b = bag(x)
            for s in range(len(w) - len(x) + 1):
                if set(map(tuple, zip(*(w[s + k :] for k in range(5)), strict=False))) & set(b):
                    a = bag(w[s : s + len(x)])
                    both = sum((a & b).values())
                    if both and 4 * both >= 3 * (2 * sum(b.values()) - both):
                        want.add((d, i, s))
                    near += both > 0
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    coded = bench.select("item_id", decontaminate._words("text").alias("w")).select("item_id", F.xxhash64("w").alias("u"), decontaminate._shingles(F.col("w"), 5).alias("sh")).withColumn("n", F.size("sh"))
    _, windows = decontaminate.windows_of(df, coded, 5)
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.candidates(windows, coded, 70).collect()}
    assert len(want) > 120 and len(want & got) >= 0.99 * len(want)
    assert len(got) < 0.5 * near  # windows that overlap a match by most of it are close, too
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()}
    assert found == {(d, i) for d, i, _ in want}
