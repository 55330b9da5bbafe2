"""Repeated substrings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lodeseek.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows, size, keep_first):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count, seen = Counter(r[i : i + size] for _, r in raw for i in range(len(r) - size + 1)), set()
    out = []
    for d, r in sorted(raw, key=lambda x: x[0]):
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - size + 1):
            w = r[i : i + size]
            if (w in seen) if keep_first else count[w] > 1:
                gone[i + 1 : i + 1 + size] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        out.append((d, len(r), len(r) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def ours(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.drop("kept", "spans").collect())


@pytest.mark.parametrize("keep_first", [False, True])
def test_documents_equal_brute_force(spark, keep_first):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert ours(substrings.remove_repeats(df, 400, keep_first)) == brute(rows, 400, keep_first)


@pytest.mark.parametrize(("limit", "piece"), [(2000, 1_000_000), (3, 70)])
def test_passages_periods_and_edges(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(substrings, "SURROUNDINGS", limit)
    monkeypatch.setattr(substrings, "PIECE", piece)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage = text(90)
    rows = [(i, text(rng.integers(0, 60)) + passage[rng.integers(0, 30) : 90 - rng.integers(0, 30)] + text(rng.integers(0, 60))) for i in range(60)]
    rows += [(100, "ab" * 100), (101, "x" * 41), (102, "x" * 40), (103, ""), (104, None), (105, passage), (106, passage + passage)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, t int, h string").repartition(5)
    assert ours(substrings.remove_repeats(df, 40, False)) == brute(rows, 40, False)
    assert ours(substrings.remove_repeats(df.limit(0), 40, False)) == []


def test_longest_previous_factors():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 2, 300), np.zeros(50), rng.integers(0, 2, 300)]).astype(np.uint8) + 1
    raw, (before, after) = data.tobytes(), substrings.longest_previous(data, 20)
    for i in range(len(raw) - 20):
        w = raw[i : i + 20]
        assert (before[i] >= 20) == (0 <= raw.find(w) < i)
        assert (after[i] >= 20) == (raw.rfind(w) > i)


def test_marks_between_surroundings_match_no_text(spark):
    # each text's repeat begins after a byte that may be the number of a mark, too
    rng = np.random.default_rng(9)
    rows = [(i, (chr(32 + i % 90) + "".join(rng.choice(list("abcdefgh"), 30))) * 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert ours(substrings.remove_repeats(df, 40, True)) == brute(rows, 40, True)


def test_null_ids_and_repeated_rows(spark):
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh"), 90))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "z" + text), (None, "other"), (3, None)], "doc_id long, text string")
    removed = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeats(df, 40, True).collect())
    assert removed == [(0, 5, 0), (0, 90, 0), (1, 90, 90), (1, 90, 90), (2, 91, 90), (3, 0, 0)]


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    # n_bytes is what a text had, n_removed what was caught of it
    rng = np.random.default_rng(11)
    text = lambda n, letters="abcdefgh": " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    passages = {"short": text(57), "edge": text(57) + "x", "whole": text(57) + "xy", "long": text(90), "accents": text(57, "äbéöñçüd")}
    rows, planted = [], {}
    for kind, passage in passages.items():
        for side in "[]":
            planted[len(rows)] = kind
            rows.append((len(rows), f"{text(40)} {side}{passage}{side} {text(40)}"))
    rows += [(len(rows) + i, text(n)) for i, n in enumerate((0, 1, 60, 400))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op5_longest_previous_factor(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 400, False)
    size = {k: len(v.encode()) for k, v in passages.items()}
    assert [*size.values()][:3] == [398, 399, 400] and all(len(v.split()) > 50 for v in passages.values())
    for r in got:
        assert r["n_bytes"] == len(rows[r["doc_id"]][1].encode())
        n = size.get(planted.get(r["doc_id"]), 0)
        assert r["n_removed"] == (n if n >= 400 else 0)
