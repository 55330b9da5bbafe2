"""Chunkers: cover, bounds, names."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.operators import chunking as c

TS = """import { a } from "./a";

export interface Foo { x: number }

export class Bar extends Foo {
  run(z: string): void {
    return;
  }
}

export const handler = async (e) => {
  return "}";
};

function plain() { return 1 }
"""


def test_typescript_and_python_and_go():
    found = {(x.kind, x.name): x for x in c.chunk_text(TS, "a.ts")}
    assert set(found) == {("interface", "Foo"), ("class", "Bar"), ("function", "handler"), ("function", "plain")}
    bar = found["class", "Bar"]
    assert bar.content.startswith('import { a } from "./a";\n\nexport class Bar') and (bar.start_line, bar.end_line) == (5, 9)
    py = "import os\n\n@deco\ndef f():\n    pass\n\nclass C:\n    def m(self): pass\n\nX = 1\n"
    assert [(x.kind, x.name, x.start_line, x.end_line) for x in c.chunk_text(py, "a.py")] == [("function", "f", 3, 5), ("class", "C", 7, 8), ("block", None, 10, 10)]
    go = 'package m\n\nimport "fmt"\n\nfunc (r *R) Do() error {\n\treturn nil\n}\n\ntype R struct {\n\ta int\n}\n'
    assert [(x.kind, x.name) for x in c.chunk_text(go, "m.go")][1:] == [("function", "Do"), ("type", "R")]


def test_other_languages():
    kt = "package a\nimport b\n\nclass K(val x: Int) {\n  fun m() = 1\n}\n\nfun top(): Int {\n  return 2\n}\n"
    assert {("class", "K"), ("function", "top")} <= {(x.kind, x.name) for x in c.chunk_text(kt, "a.kt")}
    sw = "import UIKit\n\nstruct S {\n  let a: Int\n}\n\nprotocol P {\n}\n\nfunc go() -> Int {\n  return 1\n}\n"
    assert {("struct", "S"), ("protocol", "P"), ("function", "go")} <= {(x.kind, x.name) for x in c.chunk_text(sw, "a.swift")}
    dart = "import 'a';\n\nclass D {\n  int x = 1;\n}\n\nint add(int a, int b) {\n  return a + b;\n}\n"
    assert {("class", "D"), ("function", "add")} <= {(x.kind, x.name) for x in c.chunk_text(dart, "a.dart")}


def test_broken_and_unknown_files_fall_back():
    assert [x.kind for x in c.chunk_text("def f(:\n", "a.py")] == ["module"]
    assert [x.kind for x in c.chunk_text("function x( {", "a.ts")] == ["module"]
    assert [x.kind for x in c.chunk_text("plain", "a.txt")] == ["module"]
    assert c.chunk_text("", "a.ts") == [] and c.chunk_text("  \n", "x") == []


def test_long_function_is_cut():
    body = "\n".join(f"    x{i} = compute_something({i}) + {i}" for i in range(500))
    found = c.chunk_text(f"def big():\n{body}\n", "a.py")
    assert len(found) > 1 and all(c.estimate(x.content) <= 900 for x in found) and {x.name for x in found} == {"big"}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t"), max_size=90), max_size=60), st.integers(5, 40))
def test_windows_cover_all_text_within_the_bound(lines, most):
    content = "\n".join(lines)
    found = c.bounded(c.token_windows(content, most, 0.15), most)
    assert all(c.estimate(x.content) <= most for x in found)
    covered = {i for x in found for i in range(x.start_line, x.end_line + 1)}
    assert all(i in covered for i, line in enumerate(content.split("\n"), 1) if line.strip())


def test_windows_end_before_the_least_indented_line_or_after_a_blank_one():
    lines = [f"    x{i} = {i}" for i in range(20)]
    lines[9] = "def f9():"
    first = c.token_windows("\n".join(lines), 30, 0.0)[0]
    assert first.end_line == 9 and c.token_windows("\n".join(lines), 30, 0.0)[1].content.startswith("def f9():")
    lines[8] = ""
    assert c.token_windows("\n".join(lines), 30, 0.0)[0].end_line == 9
    assert c.best_split(["a", "b", "", "d"], 1, 1) == 3 and c.best_split(["a", "", "c", "d"], 2, 2) == 2
    assert c.best_split(["  a", " b", "  c"], 2, 2) == 1 and c.best_split([" a", " b"], 1, 1) == 0


def test_repeating_window_ends():
    content = "\n".join(["x"] * 8 + [""] + ["y" * 3559] * 2)
    assert len(c.token_windows(content)) < 20


def test_in_tasks(spark):
    df = spark.createDataFrame([(1, "a.py", "def f():\n    pass\n"), (2, "b.txt", "x\n" * 5000), (3, "c.txt", None)], "file_id long, path string, content string")
    rows = c.chunk_files(df, 100).collect()
    assert {r["file_id"] for r in rows} == {1, 2}
    for f in (1, 2):
        assert sorted(r["seq"] for r in rows if r["file_id"] == f) == list(range(sum(r["file_id"] == f for r in rows)))
    slices = c.fixed_slices(df, "file_id", "content", 3000).where("file_id = 2").agg(F.sum(F.length("content"))).first()[0]
    assert slices == 10_000
