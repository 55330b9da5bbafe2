"""Token ids in Arrow files of fixed-size-list batches, for zero-copy random access.

``ids-<k>-<attempt>.arrow`` is an Arrow file whose record batches hold ``ids`` (fixed-size list of ``sequence`` unsigned integers)
and ``mask`` (fixed-size list of booleans, false where the last sequence is padded). Documents follow each other in
ascending doc_id, over files in the order of k. ``docs-<k>-<attempt>.arrow`` has each document's doc_id, start in its ids file and
number of ids. Equal-length sequences make the place of any id a division, and a memory map reads it without a copy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, tokens

SEQUENCE, END_ID, BATCH_SEQUENCES = 2048, 2, 128
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


def _names(root: str, k: int, attempt: int) -> list[str]:
    return [f"{root}/{kind}-{k:06d}-{attempt}.arrow" for kind in ("ids", "docs")]


class Writer:
    """One pair of files, of one attempt of a task; ids and documents are added in order."""

    def __init__(self, folder: str, k: int, attempt: int, dtype: np.dtype, sequence: int = SEQUENCE):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = _names(root, k, attempt)
        self.dtype, self.sequence, self.schema = dtype, sequence, _schema(dtype, sequence)
        self.sinks = [self.fs.open_output_stream(a) for a in self.names]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, DOCS), strict=True)]
        self.rest, self.total = np.zeros(0, dtype), 0

    def add(self, doc_ids: list, flat: np.ndarray, n: np.ndarray) -> None:
        self.files[1].write(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(self.total + np.cumsum(n) - n), pa.array(n)], schema=DOCS))
        self.total += len(flat)
        self.rest = np.concatenate([self.rest, flat])
        step = self.sequence * BATCH_SEQUENCES
        while len(self.rest) >= step:
            self._write(self.rest[:step], step)
            self.rest = self.rest[step:]

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.files[0].write(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if n := len(self.rest):
            self._write(np.concatenate([self.rest, np.zeros(-n % self.sequence, self.dtype)]), n)
        for file, sink in zip(self.files, self.sinks, strict=True):
            file.close()
            sink.close()


class Reader:
    """Random access to one pair of files."""

    def __init__(self, folder: str, k: int, attempt: int):
        where, root = fs.FileSystem.from_uri(folder)
        opened = [pa.memory_map(x) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(x) for x in _names(root, k, attempt)]
        self.ids, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.sequence = self.ids.schema.field("ids").type.list_size
        self.step = 0 if not self.ids.num_record_batches else self.sequence * self.ids.get_batch(0).num_rows
        self.at, self.now = -1, np.zeros(0)

    def batch(self, i: int) -> np.ndarray:
        """The ids of a record batch, viewed in place."""
        if i != self.at:
            self.at, self.now = i, self.ids.get_batch(i).column(0).flatten().to_numpy()
        return self.now

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start .. start + n, as views of the batches that hold them."""
        while n:
            i, at = divmod(start, self.step)
            part = self.batch(i)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.docs.num_record_batches):
            yield self.docs.get_batch(i)


def write_token_files(documents: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, files: int | None = None) -> DataFrame:
    """Writes documents (doc_id, text) to ``folder`` and returns a written table of the files: k, attempt, n_docs, n_tokens.

    A null or empty text is ``end_id`` alone; a null doc_id comes first. Equal doc_ids are all kept, in any order. Each
    attempt of a task writes files of its own and nothing is renamed; the table names those of the attempts that count,
    so that a lost executor's half files, or a task that ran twice, are never read.
    No rows: no files.
    """
    spark = documents.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, docs = TaskContext.get(), None, 0
        k, attempt = context.partitionId(), context.taskAttemptId()
        dtype = tokens.encoder(tokenizer).dtype
        for ids, flat, n in tokens.encoded(batches, tokenizer, end_id):
            writer = writer or Writer(folder, k, attempt, dtype, sequence)
            writer.add(ids, flat, n)
            docs += len(ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "attempt": pa.array([attempt], pa.int64()), "n_docs": [docs], "n_tokens": [writer.total]})

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return runtime.written(dealt.mapInArrow(write, "k int, attempt long, n_docs long, n_tokens long"), "files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start among the ids of all files, n_tokens, ids_crc32 of the ids as 32-bit integers."""
    spark = files.sparkSession
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("k", "attempt", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, attempt, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(folder, k, attempt)
                for docs in reader.documents():
                    crcs = []
                    for start, n in zip(docs["start"].to_pylist(), docs["n_tokens"].to_pylist(), strict=True):
                        crc = 0
                        for part in reader.tokens(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([docs["doc_id"], pa.array(docs["start"].to_numpy() + base), docs["n_tokens"], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = based.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = runtime.scratch_path(spark, "tokens")
    files = write_token_files(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(files, folder)
