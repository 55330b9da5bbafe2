"""Exact removal of repeated byte strings by longest-previous-factor arrays.

Every window of ``size`` bytes names the KGRAM-byte string of smallest hash in it as its anchor, so equal windows have
equal anchors, in equal places. Anchors are counted by hash. Copies of an anchor with the same bytes all around are one
kind, and all windows of a kind that has copies recur. Where an anchor has several kinds, mostly at the ends of matches,
their bytes are laid end to end in tasks of bounded size and sorted into a suffix array, and its longest-previous-factor
array, from the previous and next smaller positions in suffix order, tells which windows occur before (and, mirrored,
after). Only where one anchor has more than SURROUNDINGS kinds, their windows are counted by hash, dealt out over all
tasks, so that no group has to fit one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, shingles, words

SIZE, KGRAM = 400, 200
#: Different surroundings of one anchor that go into suffix arrays, and bytes in one array.
SURROUNDINGS, CHUNK_BYTES = 2000, 600_000
#: Bytes of a text that are searched for anchors at a time.
PIECE = 1_000_000
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _LOW = 24, np.uint64((1 << 24) - 1)
ANCHORS = "doc_id long, t long, h long, c long, s int, n int, at int"


class Hashes:
    """Hashes of any part of ``data``, from sums of its beginnings."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = shingles._powers_of(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.upto[1:])

    def of(self, start, end) -> np.ndarray:
        return shingles.mixed((self.upto[end] - self.upto[start]) * self.inverse[start])


def anchors(data: np.ndarray, sizes: np.ndarray, size: int = SIZE, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, start of the first window, number of windows, anchor's place after that start, hashes of the anchor and of all its windows' bytes."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    first = np.cumsum(sizes) - sizes
    if len(data) < size:
        return none
    hashes = Hashes(data)
    at = np.arange(len(data) - kgram + 1)
    m = (hashes.of(slice(0, len(at)), slice(kgram, None)) & ~_LOW) | at.astype(np.uint64)
    span, width = size - kgram + 1, 1
    while 2 * width <= span:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    n = np.maximum(sizes - size + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(sizes)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[text]
    if not len(start):
        return none
    place = (m[start] & _LOW).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(start)))
    s, a = start[run], place[run]
    whole = hashes.of(s, s + count - 1 + size) ^ shingles.mixed(((a - s) * 4096 + count).astype(np.uint64))
    return text[run], s - first[text[run]], count, a - s, hashes.of(a, a + kgram), whole


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))


def _anchor_rows(texts: DataFrame, size: int, kgram: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, strings in words.batches_of(batches, 2 * PIECE):
            raw = [x.encode("utf-8", "surrogatepass") for x in strings]
            # pieces with all windows of each text; where a long text is cut, so is a run of windows, and both parts count
            pieces = [(i, o, r[o : o + PIECE + size - 1]) for i, r in enumerate(raw) for o in range(0, max(1, len(r) - size + 1), PIECE)]
            at = 0
            while at < len(pieces):
                to, room = at, 2 * PIECE
                while to < len(pieces) and (to == at or room >= len(pieces[to][2])):
                    room -= len(pieces[to][2])
                    to += 1
                own = pieces[at:to]
                piece, s, n, a, h, c = anchors(np.frombuffer(b"".join(p[2] for p in own), np.uint8), np.array([len(p[2]) for p in own], np.int64), size, kgram)
                ids, ts = (b.column(k).take(pa.array([own[i][0] for i in piece], pa.int64())) for k in ("doc_id", "t"))
                s = s + np.array([p[1] for p in own], np.int64)[piece]
                yield pa.RecordBatch.from_arrays([ids, ts, pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (s, n, a))], ["doc_id", "t", "h", "c", "s", "n", "at"])
                at = to

    return texts.mapInArrow(task, ANCHORS)


def suffix_order(data: np.ndarray, reach: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions in the order of their suffixes, compared up to ``reach`` bytes or more, then by position; and ranks by prefix lengths."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    rank, length = np.unique(key, return_inverse=True)[1], 8
    ranks = [(length, rank)]
    while length < reach:
        after = np.zeros(n, np.int64)
        after[: max(0, n - length)] = rank[length:] + 1
        rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1]
        length *= 2
        ranks.append((length, rank))
    return np.argsort(rank, kind="stable"), ranks


def common_prefix(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, in steps of eight, up to twice the longest ranked length."""
    n, out = len(ranks[0][1]), np.zeros(len(a), np.int64)
    for length, rank in reversed(ranks):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
        out += np.where(same, length, 0)
    return out


def _smaller_before(order: np.ndarray) -> np.ndarray:
    """For each place in ``order`` the nearest place before it with a smaller value, or -1."""
    out, at = np.arange(len(order)) - 1, np.arange(len(order))
    while True:
        bad = at[(out[at] >= 0)]
        bad = bad[order[out[bad]] > order[bad]]
        if not len(bad):
            return out
        out[bad] = out[out[bad]]
        at = bad


def longest_previous(data: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the longest prefix of its suffix that starts at a smaller position too, and at a larger one.

    Exact in steps of eight below ``reach``, and at least ``reach`` exactly where the true length is.
    """
    order, ranks = suffix_order(data, reach)
    n, found = len(data), []
    for values in (order, n - 1 - order):
        before = _smaller_before(values)
        after = n - 1 - _smaller_before(values[::-1])[::-1]
        best = np.zeros(n, np.int64)
        for near, some in ((before, before >= 0), (after, after < n)):
            near = np.where(some, near, 0)
            a, b = order[some], order[near[some]]
            length = common_prefix(ranks, a, b)
            close = np.flatnonzero((length < reach) & (length + 8 > reach))
            if len(close):  # the last bytes one by one
                more = length[close]
                for k in range(7):
                    x, y = a[close] + more, b[close] + more
                    ok = (x < n) & (y < n) & (more == length[close] + k)
                    more = more + (ok & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]))
                length[close] = more
            best[some] = np.maximum(best[some], length)
        by_place = np.zeros(n, np.int64)
        by_place[order] = best
        found.append(by_place)
    return found[0], found[1]


def _settled(batches: Iterator[pa.RecordBatch], size: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Of kinds (h, c, n windows, bytes), sorted by h and then by position: runs of their windows that recur, as h, c, a, b."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        # no text has the byte at both ends of a mark, so no match goes into one or comes out of it
        marks = [b"\xff" + i.to_bytes(6, "big") + b"\xff" for i in range(len(rows))]
        data = np.frombuffer(b"".join(r[3] + m for r, m in zip(rows, marks, strict=True)), np.uint8)
        before, after = longest_previous(data, size)
        again = before >= size
        if not keep_first:
            again |= after >= size
        out, at = [], 0
        for h, c, n, raw in rows:
            hit = np.concatenate([[False], again[at : at + n], [False]])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            out += [(h, c, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            at += len(raw) + 8
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["h", "c", "a", "b"])

    rows, group, held = [], [], 0  # whole groups, and the one that may go on
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("h", "c", "n", "bytes")), strict=True):
            if group and group[0][0] != row[0]:
                rows, group = rows + group, []
                if held >= CHUNK_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            group.append(row)
            held += len(row[3])
    if rows or group:
        yield flush(rows + group)


def _window_names(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each window: h, c, w (its place), k1 and k2 (a 128-bit name of its bytes and place by the anchor)."""
    for b in batches:
        for h, c, n, at, raw in zip(*(b.column(k).to_pylist() for k in ("h", "c", "n", "at", "bytes")), strict=True):
            w = np.arange(n)
            hashes = Hashes(np.frombuffer(raw, np.uint8))
            k1 = hashes.of(w, w + size)
            k2 = hashes.of(w, w + size // 2) ^ shingles.mixed((w - at + 100_000).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(w.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["h", "c", "w", "k1", "k2"])


def repeated_spans(documents: DataFrame, size: int = SIZE, keep_first: bool = True, kgram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole texts (doc_id, text, t), and doc_id, t, spans: covered byte ranges [a, b) of those that have any; they may overlap."""
    kgram = kgram or max(1, size // 2)
    spark = documents.sparkSession
    texts = _texts(documents)
    found = runtime.written(_anchor_rows(texts.select("doc_id", "text", "t"), size, kgram), "anchors")
    twice = runtime.written(found.groupBy("h").agg(F.count("*").alias("total")).where("total > 1"), "twice")
    again = runtime.written(runtime.joined_unevenly(found, twice, ["h"], "total").drop("total"), "again")
    place = F.struct("doc_id", "t", "s")
    kinds = runtime.written(again.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "t", "s", "n", "at")).alias("first")), "kinds")
    # the bytes of one of each kind, where an anchor has several
    many = runtime.written(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "many")
    reps = runtime.joined_unevenly(kinds, many, ["h"], "kinds").select("h", "c", "kinds", "first.*")
    asked = reps.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "c", "kinds", "s", "n", "at")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, text, want in zip(*(b.column(k).to_pylist() for k in ("doc_id", "t", "text", "asked")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_pylist([{**x, "doc_id": doc, "t": t, "bytes": raw[x["s"] : x["s"] + x["n"] - 1 + size]} for x in want], cut_schema)

    cut_schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("kinds", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())])
    keyed = asked.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "asked")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    held = texts.dropDuplicates(["doc_id", "t"]).join(keyed, same).select("doc_id", "t", "text", "asked")
    around = runtime.written(held.mapInArrow(cut, "h long, c long, kinds long, doc_id long, t long, s int, n int, at int, bytes binary"), "around")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = around.where(F.col("kinds") <= SURROUNDINGS).repartition(parts, "h").sortWithinPartitions("h", "doc_id", "t", "s").select("h", "c", "n", "bytes")
    runs = dealt.mapInArrow(lambda x: _settled(x, size, keep_first), "h long, c long, a int, b int")
    named = around.where(F.col("kinds") > SURROUNDINGS).select("h", "c", "n", "at", "bytes", "doc_id", "t", "s")
    windows = named.select("h", "c", "n", "at", "bytes").mapInArrow(lambda x: _window_names(x, size), "h long, c long, w int, k1 long, k2 long")
    windows = runtime.written(windows.join(named.select("h", "c", place.alias("place")), ["h", "c"]), "windows")
    counted = windows.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("place").alias("least")).where("m > 1")
    hot = runtime.joined_unevenly(windows, runtime.written(counted, "counted"), ["k1", "k2"], "m")
    if keep_first:
        hot = hot.where("place > least")
    runs = runs.unionByName(hot.select("h", "c", F.col("w").alias("a"), (F.col("w") + 1).alias("b")))
    runs = runs.groupBy("h", "c").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    runs = kinds.select("h", "c", "copies", F.struct("first.doc_id", "first.t", "first.s").alias("first")).join(runs, ["h", "c"], "left")
    runs = runtime.written(runs.where("copies > 1 OR runs IS NOT NULL"), "runs")
    rows = runtime.joined_unevenly(again, runs, ["h", "c"], "copies")
    copy = (F.col("copies") > 1) & ((place > F.col("first")) if keep_first else F.lit(True))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    rows = rows.select("doc_id", "t", "s", F.explode(F.when(copy, whole).otherwise(F.col("runs"))).alias("r"))
    rows = rows.select("doc_id", "t", (F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b") - 1 + size).alias("b"))
    spans = rows.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return texts, spans


def remove_repeats(documents: DataFrame, size: int = SIZE, keep_first: bool = True, kgram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans (maximal removed runs) of each row.

    A byte goes if it is in a string of ``size`` bytes that occurs before, by (doc_id, position), or with
    ``keep_first=False`` anywhere else. Null texts count as empty. Copies of a whole row (same doc_id and text) are one
    document for the order, and still copies of each other with ``keep_first=False``. A null doc_id comes first in the
    order, and null doc_ids with other texts are other documents. No rows in: no rows out. Other columns are ignored.
    """
    texts, spans = repeated_spans(documents, size, keep_first, kgram)
    keyed = spans.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "spans")
    joined = texts.join(keyed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "spans")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, got in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
                raw, runs = text.encode("utf-8", "surrogatepass"), []
                for x in sorted((y["a"], y["b"]) for y in got or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                edges = [0, *(e for r in runs for e in r), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"a": a, "b": z} for a, z in runs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return joined.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a:long,b:long>>")


def op5_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(runtime.table(spark, sf_dir, "documents"), SIZE, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
