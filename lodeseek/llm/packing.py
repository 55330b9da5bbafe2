"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily with the longest pieces that fit; then its smallest piece gives way to the two unpacked pieces
that fill the gap so widened most tightly. Only lengths matter to that, and there are at most ``capacity`` of them, so
the bins are planned over the histogram of lengths: a plan is a bin's lengths and how many bins are alike. Each piece
finds its place from its rank among the pieces of its length, in salted groups of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, tokens

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that a task ranks together.
GROUP_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, first long, copies long, times long, sequence long, place long"


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, n in tokens.encoded(batches, tokenizer, end_id):
            flat = flat.astype("<u4")
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            out = [pa.array([ids[i] for i in doc], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                offsets = pa.array(np.concatenate([at, at[-1:] + length[-1:]]), pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)]
            yield pa.RecordBatch.from_arrays(out, names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def two_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, number of such bins) for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece has {length} ids; a sequence holds 1 to {capacity}")
        left[length] = n
    scale, plan = np.arange(capacity + 1), []

    def fill(bin_: list[int], used: Counter, gap: int) -> int:
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            while len(fits) and left[fits[-1]] <= used[int(fits[-1])]:
                fits = fits[:-1]
            if not len(fits):
                break
            length = int(fits[-1])
            times = min(gap // length, int(left[length]) - used[length])
            bin_ += [length] * times
            used[length] += times
            gap -= times * length
        return gap

    while left.any():
        bin_: list[int] = []
        used: Counter = Counter()
        gap = fill(bin_, used, capacity)
        while gap and len(bin_):
            smallest = min(bin_)
            room = gap + smallest
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            reach = np.maximum.accumulate(np.where(free > 0, scale, 0))
            a = np.flatnonzero(free[: room + 1] > 0)
            b = reach[np.minimum(room - a, a)]
            b = np.where((b == a) & (free[a] < 2), reach[np.maximum(np.minimum(room - a, a) - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if not len(total) or total.max() <= smallest:
                break
            best = int(total.argmax())
            bin_.remove(smallest)
            used[smallest] -= 1
            for length in (int(a[best]), int(b[best])):
                bin_.append(length)
                used[length] += 1
            gap = fill(bin_, used, room - int(total[best]))
        used = +used
        copies = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * copies
        plan.append((sorted(bin_, reverse=True), copies))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, ...]]:
    """For each length, which ranks go to which sequences and offsets."""
    rows, ranks, sequence = [], Counter(), 0
    for bin_, copies in plan:
        place = 0
        for length, times in Counter(bin_).items():
            rows.append((length, ranks[length], copies, times, sequence, place))
            ranks[length] += copies * times
            place += length * times
        sequence += copies
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (in place of such columns) to rows of pieces (doc_id, piece, length and more), which must be written already.

    Every piece gets exactly one place; the plan sent to the driver and broadcast depends on ``capacity`` alone (at most
    ``capacity`` lengths), not on the number of documents. No rows in: no rows out. Ties in (doc_id, piece), as of
    repeated rows and null doc_ids, get places of their own. A length that is null or out of range is a ValueError.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = ("_salt", "_n", "_before", "_row", "_rank", "_length", "_first", "_copies", "_times", "_sequence", "_place")
    salt, n, first, row, rank, length, start, copies, times, sequence, place = runtime.fresh(pieces.columns, *names)
    slots = spark.createDataFrame(_slots(two_fit_plan(counts, capacity)), SLOTS).toDF(length, start, copies, times, sequence, place)
    groups = max(1, -(-max(counts.values(), default=1) // GROUP_ROWS))
    salted = pieces.select(*own).withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select("length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    order = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    ranked = salted.withColumn(row, F.row_number().over(order) - 1)
    ranked = ranked.join(runtime.joined_side(runtime.written(sums, "groups")), ["length", salt]).withColumn(rank, F.col(first) + F.col(row))
    q = F.col(rank) - F.col(start)
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col(length)) & (q >= 0) & (q < F.col(copies) * F.col(times)))
    return placed.select(
        *own,
        (F.col(sequence) + F.floor(q / F.col(times))).cast("long").alias("sequence_id"),
        (F.col(place) + (q % F.col(times)) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text; other columns are ignored) as packed pieces, with their ids if ``with_ids``.

    A null or empty text is the single id ``end_id``; a null doc_id stays null. Texts are encoded whole and once.
    """
    return pack(runtime.written(token_pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def op6_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
