"""An index over tables that are there already: the same face as a store, without snapshots.

``documents`` are the files and, whole, the chunks; ``embeddings`` are their vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import content_hash, language
from ..operators import fulltext, vector
from ..operators.textquery import compile_query, phrases

EXTENSIONS = {"en": "ts", "fr": "py", "de": "go"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least, for files that can't be split so far; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def path_of():
    ext = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "go").otherwise("md")
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)


def files_of(documents: DataFrame) -> DataFrame:
    """Files of documents; every tenth is inactive."""
    rows = documents.select(F.col("doc_id").alias("id"), F.lit("main").alias("repo_id"), path_of().alias("path"), content_hash(F.col("text")).alias("hash"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("active"))
    return rows.select("id", "repo_id", "path", "hash", language(F.col("path")).alias("language"), "active", F.lit(None).cast("timestamp").alias("indexed_at"))


def chunks_of(documents: DataFrame) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1))
    return documents.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), content_hash(F.col("text")).alias("hash"), F.lit(0).alias("seq"), F.lit(1).alias("start_line"), lines.alias("end_line"),
        F.lit("block").alias("chunk_type"), F.col("source").alias("name"), F.col("text").alias("content"), F.lit(None).cast("string").alias("metadata"),
    )


class TableStore:
    """What a searcher needs of a store."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        documents = read(spark, sf_dir, "documents")
        vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("table").alias("model"), F.lit(None).cast("timestamp").alias("embedded_at"))
        chunks = chunks_of(spread(documents))
        self.tables = {"repositories": spark.createDataFrame([("main", sf_dir, None, None, None)], schemas.REPOSITORIES), "files": files_of(documents), "chunks": chunks, "vectors": vectors, "postings": fulltext.postings(chunks), "lengths": fulltext.lengths(chunks)}

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def index_for(self, text: str) -> DataFrame:
        """The postings of a query's words and prefixes."""
        found = phrases(compile_query(text))
        return fulltext.postings(self.table("chunks"), sorted({t for p in found for t in p.tokens}), sorted({p.tokens[-1] for p in found if p.prefix}))

    def search_bm25(self, text: str, limit: int | None = 20) -> DataFrame:
        return fulltext.search_bm25(self.index_for(text), self.table("lengths"), self.table("chunks"), self.table("files"), text, limit)

    def search_vector(self, query: Sequence[float], k: int = 20) -> DataFrame:
        return vector.hits_of(vector.search_vectors(self.table("vectors"), query, k), self.table("chunks"), self.table("files"))


class TableEmbedder:
    """Queries ``#<id>`` have the vector of that id: an embedder for tables whose vectors are given."""

    model = "table"

    def __init__(self, store: TableStore, dimensions: int = 64):
        self.store, self.dimensions = store, dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            digits = "".join(c for c in t if c.isdigit()) or "0"
            row = self.store.table("vectors").where(F.col("chunk_id") == int(digits)).select("embedding").limit(1).collect()
            out.append(list(row[0][0]) if row else [0.0] * self.dimensions)
        return out
