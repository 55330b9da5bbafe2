"""Relations of the index: repositories, files, chunks, vectors, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

REPOSITORIES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("last_commit", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("config", T.StringType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("repo_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("active", T.IntegerType()),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
        T.StructField("embedded_at", T.TimestampType()),
    ]
)
#: One row a term and chunk: f in both columns, where it stands in each.
POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("col", T.StringType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)
LENGTHS = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("len", T.LongType())])
TABLES = {"repositories": REPOSITORIES, "files": FILES, "chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}
