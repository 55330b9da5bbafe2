"""A bounded sample of labelled documents, and a fit on it in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Labelled rows of each class that a classifier is fitted on, at most.
SAMPLE_ROWS = 3000
#: Characters of all texts of a sample, at most; texts count whole or not at all.
SAMPLE_CHARACTERS = 32_000_000


def held_out(doc_id: str, folds: int, fold: int):
    """Whether a document belongs to the fold that no classifier may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and y of at most ``rows`` labelled documents of each class outside the held-out fold, chosen by a hash of doc_id.

    Labels other than 0 and 1, null labels and null doc_ids take no part; of repeated doc_ids one label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    each = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = runtime.written(each[0].unionByName(each[1]).dropDuplicates(["doc_id"]), "chosen")  # 2 * rows at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fitted(rows: DataFrame, fit: Callable[[list[str], list[int]], bytes], characters: int = SAMPLE_CHARACTERS) -> bytes:
    """``fit(texts, labels)``, run on one executor; it runs again there if that executor is lost.

    Rows come in doc_id order. Where their texts have more than ``characters``, rows are taken by a hash of doc_id, each
    whole, and those that don't fit any more are left out of the fit.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, str, int]] = []
        room = characters
        for b in batches:
            for doc, text, y in zip(*(b.column(k) for k in ("doc_id", "text", "y")), strict=True):
                t = text.as_py() or ""
                if len(t) <= room:
                    room -= len(t)
                    own.append((doc.as_py(), t, y.as_py()))
        own.sort()
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit([t for _, t, _ in own], [y for _, _, y in own])], pa.binary())})

    one = rows.select("doc_id", "text", "y").dropDuplicates(["doc_id"]).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = one.mapInArrow(task, "model binary").collect()
    return bytes(got[0]["model"]) if got else fit([], [])
