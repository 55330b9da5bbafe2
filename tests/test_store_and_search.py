"""Stores on disk, incremental updates, the pipeline, the command line, tools, streaming."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeseek import schemas
from lodeseek.operators import incremental
from lodeseek.operators.embedding import HashEmbedder
from lodeseek.plans import cli, ingest, tools
from lodeseek.plans.search import Searcher
from lodeseek.plans.store import Store
from lodeseek.sources import git, scan
from lodeseek.sources.collections import Registry
from lodeseek.sources.config import built, load_config, merged
from lodeseek.streaming import ingest as streaming

CHUNKS = "file_id long, seq int, start_line int, end_line int, chunk_type string, name string, content string"


def chunk_rows(spark, file_id, texts):
    return incremental.with_hash(spark.createDataFrame([(file_id, i, i, i, "function", f"f{i}", t) for i, t in enumerate(texts)], CHUNKS))


def touched(spark, file_id):
    return spark.createDataFrame([(file_id,)], "file_id long")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def scanned(spark, rows):
    return spark.createDataFrame([("r", p, h, None) for p, h in rows], "repo_id string, path string, hash string, language string")


def test_numbers_are_gapless_and_in_order_where_ranges_are_sampled(spark):
    wide = F.concat(*[F.sha2(F.concat(F.col("k").cast("string"), F.lit(str(i))), 512) for i in range(3)])
    rows = spark.range(0, 30000, 1, 8).select((F.col("id") * 7919 % 30011).alias("k")).select((F.col("k") % 97).cast("string").alias("path"), F.when(F.col("k") % 97 > 3, F.col("k")).alias("seq"), wide.alias("content"), F.col("k").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = incremental.numbered(rows, 500, ["path", "seq"]).select("id", "path", "seq", "n", "content").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r["id"] for r in got) == list(range(501, 30501)) and len({r["n"] for r in got}) == 30000
    by_id = [(r["path"], -1 if r["seq"] is None else r["seq"]) for r in sorted(got, key=lambda r: r["id"])]
    assert by_id == sorted(by_id)
    assert incremental.numbered(rows.limit(0), 500, ["path", "seq"]).collect() == []


def test_many_new_files_are_all_kept(spark):
    path = F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(".md"))
    seen = spark.range(0, 40000, 1, 4).select(F.lit("r").alias("repo_id"), path.alias("path"), F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 512).alias("hash"), F.lit("markdown").alias("language"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        files, _ = incremental.upsert_files(spark.createDataFrame([], schemas.FILES), seen, 7)
        got = files.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({r["path"] for r in got}) == 40000 and sorted(r["id"] for r in got) == list(range(8, 40008))


def test_store_keeps_ids_and_vectors_of_unchanged_chunks(spark, store):
    store.upsert_repository("r", "/r")
    store.upsert_repository("r", "/r2", "abcd")
    assert [tuple(r)[:3] for r in store.table("repositories").collect()] == [("r", "/r2", "abcd")]
    status = {r["path"]: r["status"] for r in store.upsert_files(scanned(spark, [("a", "1"), ("b", "2")])).collect()}
    assert status == {"a": "new", "b": "new"}
    ids = {r["path"]: r["id"] for r in store.table("files").collect()}
    assert {r["path"]: r["status"] for r in store.upsert_files(scanned(spark, [("a", "1"), ("b", "3")])).collect()} == {"a": "unchanged", "b": "changed"}
    assert {r["path"]: r["id"] for r in store.table("files").collect()} == ids

    a = ids["a"]
    texts = [f"alpha {i}" for i in range(20)]
    store.replace_chunks(touched(spark, a), chunk_rows(spark, a, texts))
    old = {r["seq"]: r["id"] for r in store.table("chunks").collect()}
    store.insert_embeddings(spark.createDataFrame([(i, [1.0, 0.0], "m", None) for i in old.values()], "chunk_id long, embedding array<float>, model string, embedded_at timestamp"))
    texts[3] = "changed"
    del texts[10]
    texts.insert(0, "first")
    assert store.replace_chunks(touched(spark, a), chunk_rows(spark, a, texts)) == 2
    new = {r["content"]: r["id"] for r in store.table("chunks").collect()}
    assert len(new) == 20 and new["alpha 0"] == old[0] and new["alpha 19"] == old[19]
    assert min(new["first"], new["changed"]) > max(old.values())
    assert [r["content"] for r in store.file_chunks(a).collect()] == texts
    assert store.table("vectors").count() == 18 and store.unembedded().count() == 2
    assert store.stats().first().asDict() == {"repositories": 1, "files": 2, "active_files": 2, "chunks": 20, "embedded": 18, "pending": 2}
    assert store.search_bm25("alpha", 100).count() == 18

    with pytest.raises(ValueError):
        store.replace_chunks(touched(spark, 999), chunk_rows(spark, 999, ["x"]))
    assert store.table("chunks").count() == 20
    assert store.deactivate_files(store.file("r", "a").select("id")) == 1
    assert store.search_bm25("alpha").count() == 0 and store.search_vector([1.0, 0.0]).count() == 0
    assert store.cleanup() == (20, 18) and store.table("chunks").count() == 0
    again = Store(spark, store.root)
    assert again.active_files("r").count() == 1 and again.state["chunk_id"] == store.state["chunk_id"]
    store.vacuum()
    store.clear_all()
    assert store.stats().first()["files"] == 0 and store.table("repositories").count() == 1


def test_a_change_writes_the_buckets_of_its_files_alone(spark, store):
    store.upsert_files(scanned(spark, [(f"p{i}", str(i)) for i in range(40)]))
    ids = [r["id"] for r in store.table("files").orderBy("id").collect()]
    every = spark.createDataFrame([(i,) for i in ids], "file_id long")
    rows = spark.createDataFrame([(i, k, k, k, "function", f"f{k}", f"word{i} text{k}") for i in ids for k in range(3)], CHUNKS)
    store.replace_chunks(every, incremental.with_hash(rows))
    store.insert_embeddings(store.table("chunks").select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit("m").alias("model"), F.lit(None).cast("timestamp").alias("embedded_at")))
    before = {n: dict(store.state["tables"][n]) for n in ("chunks", "vectors", "postings", "lengths")}
    assert len(before["chunks"]) > 15
    store.replace_chunks(touched(spark, ids[7]), chunk_rows(spark, ids[7], ["changed words"]))
    for n, was in before.items():
        now = store.state["tables"][n]
        assert sum(now.get(b) != p for b, p in was.items()) == 1 and set(now) <= set(was), n
    assert store.table("chunks").count() == 118 and store.table("vectors").count() == 117
    assert store.search_bm25("changed").count() == 1 and store.search_bm25(f"word{ids[7]}").count() == 0 and store.search_bm25(f"word{ids[8]}").count() == 3
    again = Store(spark, store.root)
    assert again.search_bm25("changed").count() == 1
    store.vacuum()
    assert again.number < store.number and Store(spark, store.root).table("chunks").count() == 118
    with pytest.raises(RuntimeError):
        again.clear_vectors()
        again.clear_vectors()


class Model:
    def __init__(self, fail=False):
        self.fail = fail

    def generate(self, prompt, temperature=0.3, max_tokens=512):
        if self.fail:
            raise RuntimeError
        return '[{"type":"lex","text":"parse"},{"type":"vec","text":"read file"},{"type":"lex","text":"token"}]'

    def rerank(self, query, documents):
        if self.fail:
            raise RuntimeError
        return [9.0 if "parse" in d else 1.0 for d in documents]


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        "src/auth.py": "import os\n\ndef check_token(token):\n    return token == os.environ['T']\n",
        "src/parse.py": "def parse(text):\n    return text.split()\n",
        "lib/token.ts": "export function token(x) { return x }\n",
        "node_modules/x.js": "token",
        ".hidden/y.py": "token",
        "pic.png": "token",
        "empty.py": "",
        "data.xyz": "token",
        "nul.py": "a\0b",
        "README": "token docs",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "big.py").write_bytes(b"x" * 2000)
    return root


def test_scan(spark, source):
    rows = {r["path"]: r for r in scan.scan(spark, str(source), "proj", max_file_size=1000).collect()}
    assert set(rows) == {"src/auth.py", "src/parse.py", "lib/token.ts", "README"}
    assert rows["lib/token.ts"]["language"] == "typescript" and rows["README"]["language"] is None
    assert rows["src/parse.py"]["size"] == len(rows["src/parse.py"]["content"])


def test_search_modes_filters_and_failures(spark, store, source):
    ingest.index(store, str(source), load_config("/nowhere", environment={}))
    assert ingest.embed(store, lambda: HashEmbedder(32)) == store.table("chunks").count()
    assert ingest.embed(store, lambda: HashEmbedder(32)) == 0
    s = Searcher(store, HashEmbedder(32), Model())
    paths = lambda r: [x["file_path"] for x in r.results.collect()]
    assert set(paths(s.search("token", "bm25"))) == {"src/auth.py", "lib/token.ts", "README"}
    assert set(paths(s.search("token path:src", "bm25"))) == {"src/auth.py"}
    assert paths(s.search("token -path:src ext:ts", "bm25")) == ["lib/token.ts"]
    full = s.search("token path:src", "bm25").results.first()["score"]
    assert full in [r["score"] for r in s.search("token", "bm25").results.collect()]
    assert len(paths(s.search("token", "vector", 2))) == 2
    timed = s.search("token", "hybrid", 10, True, True, benchmark=True)
    assert {"expand", "bm25", "vector", "fusion", "rerank", "total"} <= set(timed.timing) and timed.counts["bm25"] > 0
    assert paths(timed) == paths(s.search("token", "hybrid", 10, True, True))
    assert timed.results.first()["file_path"] == "src/parse.py"
    plain = paths(s.search("token", "hybrid"))
    assert paths(Searcher(store, HashEmbedder(32), Model(True)).search("token", "hybrid", 20, True, True)) == plain
    assert paths(Searcher(store).search("token", "vector")) == []
    assert paths(s.search("zzzz", "bm25")) == []

    t = tools.Tools(store, lambda: s, "c")
    call = lambda name, **a: tools.respond(t, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert "src/auth.py" in call("search", query="token")["content"][0]["text"]
    assert "score" in call("query", query="token")["content"][0]["text"]
    assert "def parse" in call("get_file", path="src/parse.py")["content"][0]["text"]
    chunk = store.table("chunks").first()["id"]
    assert f"Chunk ID: {chunk}" in call("get_chunk", chunk_id=chunk)["content"][0]["text"]
    assert "chunks" in call("status")["content"][0]["text"]
    assert call("search", query="path:x")["isError"] and call("nope")["isError"]
    assert len(tools.respond(t, {"id": 2, "method": "tools/list"})["result"]["tools"]) == 5


def run_git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_git_update_and_command_line(spark, source, tmp_path):
    run_git(source, "init", "-q")
    run_git(source, "add", ".")
    run_git(source, "commit", "-qm", "one")
    c = cli.Commands(spark, Registry(tmp_path / "home"))
    c.run(["init", "proj", str(source), "--update-cmd", "touch hooked"])
    with pytest.raises(ValueError):
        c.run(["init", "proj", str(source)])
    with pytest.raises(ValueError):
        c.run(["init", "bad name", "x"])
    assert "5 new" in c.run(["index", "proj"])
    assert "5 unchanged" in c.run(["update", "proj"]) and (source / "hooked").exists()
    (source / "hooked").unlink()
    first = git.current_commit(str(source))
    run_git(source, "mv", "src/parse.py", "src/parser.py")
    (source / "src/auth.py").write_text("def changed_token(): pass\n")
    (source / "lib/token.ts").unlink()
    run_git(source, "add", "-A")
    run_git(source, "commit", "-qm", "two")
    changes = git.detect_changes(spark, str(source), first)
    assert {(r["status"], r["path"], r["old_path"]) for r in changes.changes.collect()} == {("modified", "src/auth.py", None), ("renamed", "src/parser.py", "src/parse.py"), ("deleted", "lib/token.ts", None)}
    assert git.detect_changes(spark, str(source), "zz").full_scan and git.detect_changes(spark, str(source), "abcdef12").full_scan
    assert c.run(["update", "proj"]).startswith("1 new, 1 changed, 0 unchanged, 2 removed files")
    assert "src/auth.py" in c.run(["search", "proj", "changed_token"]) and c.run(["search", "proj", "check_token"]) == "No results found."
    assert "src/parser.py" in c.run(["query", "proj", "parse", "--limit", "3"])
    c.run(["copy", "proj", "two", str(source)])
    c.run(["export", "proj", str(tmp_path / "out")])
    c.run(["import", "three", str(tmp_path / "out"), str(source)])
    assert [x.split("\t")[0] for x in c.run(["list"]).split("\n")] == ["proj", "three", "two"]
    assert "src/parser.py" in c.run(["get", "three", "src/parser.py"]) and "chunks: " in c.run(["status", "two"])
    c.run(["set-update-cmd", "proj", "true"])
    assert c.registry.get("proj").update_command == "true" and "max_tokens" in c.run(["config"])
    c.registry.remove("two", delete=True)
    assert c.registry.names() == ["proj", "three"] and "Usage" in c.run([])
    with pytest.raises(ValueError):
        c.run(["nothing"])


def test_arguments_and_settings(tmp_path):
    assert cli.parse_arguments(["search", "c", "--limit", "3", "q", "--no-expand", "x", "--a=b"]) == ("search", ["c", "q", "x"], {"limit": "3", "no-expand": True, "a": "b"})
    assert cli.parse_arguments(["--help"])[0] == "help"
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    env = {"LODESEEK_CHUNKER_MAX_TOKENS": "50", "LODESEEK_EMBEDDER_PROVIDER": "local"}
    c = load_config(tmp_path, environment=env)
    assert c.chunker.max_tokens == 50 and c.embedder.provider == "local" and c.chunker.overlap == 0.15
    for bad in ({"chunker": {"overlap": 2}}, {"llm": {"provider": "x"}}, {"scanner": {"max_file_size": 0}}, {"scanner": {"exclude": "x"}}):
        with pytest.raises(ValueError):
            built(bad)


def test_stream_of_changes(spark, store, tmp_path):
    folder = tmp_path / "changes"
    folder.mkdir()
    rows = [("r", "a.py", "added", "def alpha(): pass", "2024-01-01T00:00:00"), ("r", "b.py", "added", "def beta(): pass", "2024-01-01T00:00:01"), ("r", "a.py", "deleted", None, "2024-01-01T00:00:02")]
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("repo_id", "path", "status", "content", "at"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("repo_id string, path string, status string, content string, at timestamp").json(str(folder))
    streaming.start(stream, store, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert [r["path"] for r in store.table("files").where("active = 1").collect()] == ["b.py"]
    batch = spark.createDataFrame(rows[1:2], "repo_id string, path string, status string, content string, at string").withColumn("at", F.to_timestamp("at"))
    before = store.table("chunks").collect()
    streaming.apply_batch(store, batch)
    assert store.table("chunks").collect() == before and store.search_bm25("beta").count() == 1
