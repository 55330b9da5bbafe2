"""Scalar functions, inline filters and the query compiler."""

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import filters as fl
from lodeseek.functions import text as tx
from lodeseek.operators import textquery as tq


@pytest.mark.parametrize(
    ("raw", "text", "changes"),
    [
        ("find auth path:src/api", "find auth", {"path": ["src/api"]}),
        ("-path:tests/ x -ext:md y", "x y", {"not_path": ["tests/"], "not_ext": [".md"]}),
        ("ext:ts ext:.tsx", "", {"ext": [".ts", ".tsx"]}),
        ("path: keep", "path: keep", {}),
        ("file:a.ts -file:b.ts http://x", "http://x", {"file": ["a.ts"], "not_file": ["b.ts"]}),
        ("  ", "", {}),
    ],
)
def test_parse_query(raw, text, changes):
    assert fl.parse_query(raw) == (text, fl.QueryFilters(**changes))
    assert bool(fl.parse_query(raw)[1]) == bool(changes)


def test_predicates(spark):
    paths = ["src/api/a.ts", "src/apix/a.ts", "src/api", "lib/a.d.ts", "a.ts", "lib/A.TS"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")

    def kept(**kinds):
        return [r[0] for r in fl.apply_filters(df, fl.QueryFilters(**kinds)).collect()]

    assert kept(path=["src/api"]) == ["src/api/a.ts", "src/api"]
    assert kept(path=["src/api/"]) == ["src/api/a.ts"]
    assert kept(ext=[".d.ts"]) == ["lib/a.d.ts"]
    assert kept(file=["a.ts"]) == ["src/api/a.ts", "src/apix/a.ts", "a.ts"]
    assert kept(file=["api/a.ts"]) == ["src/api/a.ts"]
    assert kept(path=["src/api", "lib"], ext=[".ts"], not_file=["a.d.ts"]) == ["src/api/a.ts"]
    assert kept(path=["lib"], not_path=["lib"]) == []


def test_names(spark):
    rows = [("a/b.TS",), (".bashrc",), ("x/Dockerfile.dev",), ("Makefile",), ("p.tar.gz",), ("b.min.map",), ("a.b/noext",), ("CMakeLists.txt",)]
    p = F.col("p")
    out = spark.createDataFrame(rows, "p string").select(tx.extension(p), tx.language(p), tx.is_source_name(p), tx.is_binary_name(p)).collect()
    assert [tuple(r) for r in out] == [(".ts", "typescript", True, False), ("", None, True, False), (".dev", "dockerfile", True, False), ("", "makefile", True, False), (".gz", None, False, True), (".map", None, False, True), ("", None, True, False), (".txt", "cmake", True, False)]


def test_texts(spark):
    df = spark.createDataFrame([("Été_2 naïve x-Y", None, "n", ""), ("", "k", None, "n")], "a string, b string, c string, d string")
    rows = df.select(tx.tokens(F.col("a")), tx.token_estimate(F.col("a")), tx.embedding_text(F.lit("p"), F.col("b"), F.col("d"), F.col("c"), F.col("a")), tx.rerank_document(F.col("b"), F.col("c"), F.lit("p"), F.lit("t")), tx.truncated(F.col("a"), 8)).collect()
    assert list(rows[0]) == [["ete", "2", "naive", "x", "y"], 4, "file: p | name: n | code: Été_2 naïve x-Y", "[chunk] n (p)\nt", "Été_2..."]
    assert list(rows[1]) == [[], 0, "file: p | language: k | type: n", "[k] p\nt", ""]


def test_compiler():
    two = tq.compile_query("func_50 ++")
    assert two == tq.Phrase(("func", "50"))
    assert tq.compile_query("") is None and tq.compile_query("++ --") is None
    assert [p.tokens for p in tq.phrases(tq.compile_query("a a"))] == [("a",), ("a",)]
    tree = tq.compile_query('"x y" AND b* OR c NOT d')
    assert tree.op == "or" and tree.parts[0].parts[1].prefix and tree.parts[1].op == "not"
    assert tq.compile_query("{name} : a AND b").parts[0].columns == ("name",)
    assert tq.compile_query("NEAR(a b, 2) OR ^z").parts[0].distance == 2
    for bad in ("foo[0]", "a AND", '"open', "{bad} : a", "NOT a", "NEAR(a, x) AND b", "( a OR b"):
        with pytest.raises(ValueError):
            tq.compile_query(bad)
