"""Exact cosine search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one batch, which go to every task.
BATCH_QUERIES = 4096


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector has no length or the lengths differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1 - _dot(a, b) / norm)


def distance_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def search_vectors(vectors: DataFrame, query: Sequence[float], k: int = 20) -> DataFrame:
    """chunk_id, distance of the k nearest vectors, ties by chunk_id; vectors of length zero take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.select("chunk_id", cosine_distance(F.col("embedding"), q).alias("distance"))
    return d.where("distance IS NOT NULL").orderBy("distance", "chunk_id").limit(k)


def search_batch(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """query_id, chunk_id, distance, place (from 1) of each query's k nearest; tasks send k rows a query on.

    The vectors are read once for each BATCH_QUERIES queries.
    """
    near = _near(vectors, queries[:BATCH_QUERIES], k)
    for at in range(BATCH_QUERIES, len(queries), BATCH_QUERIES):
        near = near.unionByName(_near(vectors, queries[at : at + BATCH_QUERIES], k))
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search_table(vectors: DataFrame, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """As ``search_batch`` for a table of queries (query_id, embedding) of any number, each id once.

    The driver holds one block of about BATCH_QUERIES queries at a time; the results of a block are written below
    ``folder``, which all executors share, before the next is read.
    """
    spark = queries.sparkSession
    asked = queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding")
    blocks = -(-asked.count() // BATCH_QUERIES)
    schema = "query_id long, chunk_id long, distance double, place int"
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        by_length: dict[int, list] = {}
        for r in block:
            by_length.setdefault(len(r["embedding"]), []).append((r["query_id"], r["embedding"]))
        for length, own in by_length.items():
            search_batch(vectors, own, k).write.parquet(f"{folder}/{n}/{length}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder) if blocks else spark.createDataFrame([], schema)


def _near(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """query_id, chunk_id, distance of each query's k nearest in each task."""
    ids = [int(i) for i, _ in queries]
    q = np.array([v for _, v in queries], float).reshape(len(ids), -1)
    q = q / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 2)) for _ in ids]
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v and len(v) == q.shape[1]]
            if not rows:
                continue
            keys, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
            size = np.sqrt((x * x).sum(axis=1))
            keys, x = keys[size > 0], x[size > 0] / size[size > 0, None]
            d = 1 - q @ x.T
            for n, row in enumerate(d):
                near = np.lexsort((keys, row))[:k]
                both = np.concatenate([best[n], np.column_stack([row[near], keys[near]])])
                best[n] = both[np.lexsort((both[:, 1], both[:, 0]))[:k]]
        got = [(i, int(c), float(d)) for i, rows in zip(ids, best, strict=True) for d, c in rows]
        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "chunk_id", "distance"])

    return vectors.select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(task, "query_id long, chunk_id long, distance double")


def hits_of(near: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The k nearest with chunk and file; active files only, which is asked after k were taken, so fewer may be left."""
    from .fulltext import HIT, with_chunks

    return with_chunks(near, chunks, files).select(*HIT, "distance", distance_score(F.col("distance")).alias("score"))
