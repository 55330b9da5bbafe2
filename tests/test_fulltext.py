"""Full-text search against SQLite's FTS5, an independent engine."""

import sqlite3

import pytest

from lodeseek.operators import fulltext

TEXTS = [
    "the quick brown fox jumps over the lazy dog",
    "function validateToken(token) { return token.length > 3 }",
    "token validation: validate the token, then the quick check",
    "",
    "lazy lazy lazy cat; func_50 and func 51",
    "quick quick brown Été déjà",
    "dog the brown quick",
]
NAMES = ["fox", "validateToken", None, "empty", "func_50", "the quick", "dog"]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(i, i, t, n) for i, (t, n) in enumerate(zip(TEXTS, NAMES, strict=True))], "id long, file_id long, content string, name string")
    return fulltext.postings(chunks).cache(), fulltext.lengths(chunks).cache()


def oracle(query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content, name)")
    db.executemany("INSERT INTO t(rowid, content, name) VALUES (?, ?, ?)", [(i, t, n) for i, (t, n) in enumerate(zip(TEXTS, NAMES, strict=True))])
    return dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,)).fetchall())


@pytest.mark.parametrize(
    ("ours", "theirs"),
    [
        ("quick brown", '"quick" "brown"'),
        ("func_50", '"func_50"'),
        ("quick quick", '"quick" "quick"'),
        ('"brown fox" OR token', '"brown fox" OR token'),
        ("quick NOT dog", "quick NOT dog"),
        ("{name} : quick OR lazy", "{name} : quick OR lazy"),
        ("- {name} : quick AND the", "- {name} : quick AND the"),
        ("valid* AND token", "valid* AND token"),
        ("NEAR(quick dog, 2) OR cat", "NEAR(quick dog, 2) OR cat"),
        ('^quick OR "zzz"', '^quick OR "zzz"'),
        ('"lazy" + dog', '"lazy" + dog'),
        ("(lazy OR quick) AND brown", "(lazy OR quick) AND brown"),
        ("ete DÉJÀ", '"ete" "DÉJÀ"'),
    ],
)
def test_hits_and_ranks(tables, ours, theirs):
    want = oracle(theirs)
    got = {r["chunk_id"]: r["rank"] for r in fulltext.bm25(*tables, ours).collect()}
    assert set(got) == set(want)
    if "NEAR" not in ours and "^" not in ours:
        assert got == pytest.approx(want, abs=1e-9)


def test_empty_query_asks_nothing(tables):
    assert fulltext.bm25(*tables, " ++ ") is None


def test_batch_equals_single_queries(spark, tables):
    asked = [(1, "quick brown"), (2, "token"), (3, "nowhere"), (4, "lazy lazy")]
    out = fulltext.bm25_batch(*tables, spark.createDataFrame(asked, "query_id long, text string"), 10).collect()
    for i, q in asked:
        single = {r["chunk_id"]: round(r["rank"], 9) for r in fulltext.bm25(*tables, q).collect()}
        assert {r["chunk_id"]: round(r["rank"], 9) for r in out if r["query_id"] == i} == single


def test_words_with_marks_are_found_in_any_form(spark):
    texts = ["a Tőzsde index", "x čas y", "Łódź żółw", "e\u0301te\u0301 here", "été there", "한국 text", "İstanbul", "Ångström"]
    chunks = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, content string, name string")
    index, sizes = fulltext.postings(chunks), fulltext.lengths(chunks)

    def hits(q):
        found = fulltext.bm25(index, sizes, q)
        return sorted(r["chunk_id"] for r in found.collect())

    for q, want in [("Tőzsde", [0]), ("tozsde", [0]), ("čas", [1]), ("cas", [1]), ("c\u030cas", [1]), ("Łódź", [2]), ("zołw", [2]), ("été", [3, 4]), ("e\u0301te\u0301", [3, 4]), ("한국", [5]), ("istanbul", [6]), ("angstrom", [7])]:
        assert hits(q) == want, q


def test_postings_of_some_terms(spark):
    chunks = spark.createDataFrame([(1, "b a b func_50", None), (2, "", "a"), (3, None, "x")], "id long, content string, name string")
    every = {(r["term"], r["chunk_id"], r["col"]): r["positions"] for r in fulltext.postings(chunks).collect()}
    assert every == {("b", 1, "content"): [0, 2], ("a", 1, "content"): [1], ("func", 1, "content"): [3], ("50", 1, "content"): [4], ("a", 2, "name"): [0], ("x", 3, "name"): [0]}
    some = {(r["term"], r["chunk_id"]) for r in fulltext.postings(chunks, ["a"], ["fu"]).collect()}
    assert some == {("a", 1), ("a", 2), ("func", 1)}
    assert "Exchange" not in fulltext.postings(chunks)._jdf.queryExecution().executedPlan().toString()
