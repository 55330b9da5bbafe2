"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, FIRST_WEIGHT = 60, 2.0
SOURCES = ("bm25", "vector")


def ranked_list(hits: DataFrame, source: str, index: int, *order) -> DataFrame:
    """source, list_idx, rank0, chunk_id, score of a result of bounded length."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return hits.select(F.lit(source).alias("source"), F.lit(index).alias("list_idx"), place.alias("rank0"), "chunk_id", "score")


def union_lists(lists: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), lists)


def fuse(lists: DataFrame, limit: int | None = None, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, rrf, bm25, vector of a union of ranked lists, best first; ties as they were first seen.

    A place in a list adds weight / (k + rank), the weight being 2 in the first list of each source. ``by`` names
    columns that hold separate fusions in one table; with them no limit or order is applied.
    """
    source = F.when(F.col("source") == SOURCES[0], 0).otherwise(1)
    weight = F.when(F.col("list_idx") == 0, FIRST_WEIGHT).otherwise(1.0)
    seen = F.struct(source.alias("source"), F.col("list_idx").alias("list_idx"), F.col("rank0").alias("rank0"))
    rows = lists.select(*by, "chunk_id", "source", "score", seen.alias("seen"), (weight / (k + F.col("rank0") + 1)).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seen", "part"))), lambda x: x["part"])
    fused = rows.groupBy(*by, "chunk_id").agg(
        F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("rrf"),  # in one order, for equal sums
        *[F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in SOURCES],
        F.min("seen").alias("first_seen"),
    )
    if by:
        return fused
    out = fused.orderBy(F.desc("rrf"), "first_seen")
    return out.limit(limit) if limit is not None else out
