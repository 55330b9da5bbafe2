"""Packing and token files: exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lodeseek.llm import packing, runtime, token_files, tokens

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "a<|endoftext|>b it's THE'LL x's 12ab é é.", "word.,'s don't. İstanbul ΣΑΣ. ß!!", "a b\u0085c d​.", "'s.'t ..'s.", "::a:: a1. 한국어. 日本語, ﬁx", "﻿hi a_b. İ. ẞ, 𝒳y", "don't'll'S 'S's'"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (20_001, "long words " * 5000), (20_001, "long words " * 5000)]
    return rows, spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, length int, offset string").repartition(5)


def encoded(text, end):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end] if text is not None else [end]


@pytest.fixture(scope="module")
def truth(docs):
    t = Tokenizer.from_file(PATH)
    return {d: t.encode(x or "", add_special_tokens=False).ids for d, x in docs[0]}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_are_encoded_as_whole_texts_are(docs, truth):
    flat, n = tokens.encoder(PATH).encode([x or "" for _, x in docs[0]])
    at = np.cumsum(n) - n
    assert [list(flat[a : a + k]) for a, k in zip(at, n, strict=True)] == [truth[d] for d, _ in docs[0]]


def test_packing(spark, docs, truth):
    rows, df = docs
    out = packing.pack_documents(df, PATH).collect()
    want = Counter()
    for d, _ in rows:
        ids = [*truth[d], 0]
        want.update((d, p // 2048, p, len(ids[p : p + 2048]), crc(ids[p : p + 2048])) for p in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = Counter(rng.integers(1, 101, rng.integers(1, 300)).tolist())
        plan = packing.two_fit_plan(counts, 100)
        used = Counter()
        for bin_, copies in plan:
            assert sum(bin_) <= 100 and copies > 0
            for x in bin_:
                used[x] += copies
        assert used == counts
    assert packing.two_fit_plan({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [([60, 25, 15], 1), ([30], 1)]


def test_ids_go_along(spark, docs, truth):
    out = packing.pack_documents(docs[1].where("doc_id < 20"), PATH, with_ids=True).collect()
    assert all(list(r["ids"]) == [*truth[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]] for r in out)


def test_token_files(spark, docs, truth):
    rows, df = docs
    folder = runtime.scratch_path(spark, "tokens")
    files = token_files.write_token_files(df, PATH, folder, files=3)
    out = sorted(token_files.read_token_files(files, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted(d for d, _ in rows)
    at = 0
    for r in out:
        ids = [*truth[r["doc_id"]], 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    first = token_files.Reader(folder, *min((r["k"], r["attempt"]) for r in files.collect()))
    batch = first.ids.get_batch(0)
    assert batch.schema.field("ids").type.list_size == 2048 and batch.schema.field("mask").type.list_size == 2048
    last = first.ids.get_batch(first.ids.num_record_batches - 1).column("mask").flatten().to_numpy(zero_copy_only=False)
    kept = sum(first.ids.get_batch(i).column("mask").flatten().true_count for i in range(first.ids.num_record_batches))
    assert kept == sum(b.column("n_tokens").to_numpy().sum() for b in first.documents()) and last[0]
    empty = runtime.scratch_path(spark, "none")
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), PATH, empty), empty).count() == 0


def test_pieces_with_clashing_columns_null_ids_and_bad_lengths(spark):
    rows = [(None, 0, 5, 1, "a"), (None, 0, 5, 2, "b"), (1, 0, 3, 3, "c"), (1, 0, 3, 3, "c"), (2, 0, 8, 4, "d")]
    schema = "doc_id long, piece int, length long, first int, _rank string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(7) for c in ("_salt", "_n", "_row", "_before", "_first", "copies", "times", "sequence", "place", "_length", "offset")})
    got = packing.pack(df, 8).collect()
    assert len(got) == 5 and sorted(r["first"] for r in got) == [1, 2, 3, 3, 4] and all(r["times"] == 7 for r in got)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sorted(x) for x in held.values()) == [[(0, 5), (5, 3)], [(0, 5), (5, 3)], [(0, 8)]]
    for bad in (0, 9, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, bad)], "doc_id long, piece int, length long"), 8)


def test_files_of_other_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(None, "none"), (1, "one two"), (1, "one two"), (2, "")], "doc_id long, text string")
    folder = f"file://{tmp_path}/files"
    files = token_files.write_token_files(df, PATH, folder, files=2)
    want = sorted(map(tuple, token_files.read_token_files(files, folder).collect()), key=str)
    assert len(want) == 4 and len(set(want)) == 4
    r = files.first()
    for a in token_files._names(f"{tmp_path}/files", r["k"], r["attempt"] + 1000):
        open(a, "wb").write(b"half a file of an attempt that was lost")
    assert sorted(map(tuple, token_files.read_token_files(files, folder).collect()), key=str) == want
