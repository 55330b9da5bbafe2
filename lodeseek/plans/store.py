"""The store of an index: versioned Parquet snapshots of its tables and numbered pointers, of which the newest counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import fulltext, incremental, vector

POINTER = "current-"
#: Buckets of a new store. Chunks, their vectors and postings are dealt to buckets by file, and a change writes those of its files alone.
BUCKETS = 64
BUCKETED = ("chunks", "vectors", "lengths", "postings")


@dataclass
class UpdateReport:
    new: int = 0
    changed: int = 0
    unchanged: int = 0
    deactivated: int = 0
    deleted_chunks: int = 0
    deleted_vectors: int = 0


class Store:
    """Tables at ``root``. A change writes new snapshots and then adds a pointer, so readers see all of it or none."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._read_pointer()
        self.buckets = self.state.setdefault("buckets", buckets)

    def _pointers(self) -> list[tuple[int, object]]:
        """Numbers and paths of the pointers that are there, the newest last."""
        found = self._fs.globStatus(self._path(f"{self.root}/{POINTER}*"))
        paths = [x.getPath() for x in found or []]
        return sorted(((int(p.getName().removeprefix(POINTER)), p) for p in paths), key=lambda x: x[0])

    def _read_pointer(self) -> dict:
        there = self._pointers()
        if not there:
            self.number = 0
            return {"tables": {}, "file_id": 0, "chunk_id": 0}
        self.number, p = there[-1]
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_pointer(self) -> None:
        """Adds a pointer of the next number; those before it stay until ``vacuum``, so there is one at any time."""
        new, final = self._path(f"{self.root}/.{POINTER}{uuid.uuid4().hex}"), self._path(f"{self.root}/{POINTER}{self.number + 1:012d}")
        out = self._fs.create(new, True)
        out.write(json.dumps(self.state).encode())
        out.close()
        if [n for n, _ in self._pointers()][-1:] not in ([], [self.number]) or not self._fs.rename(new, final):
            raise RuntimeError(f"another writer has changed the store at {self.root}")
        self.number += 1

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or its rows in some buckets."""
        there = self.state["tables"].get(name)
        if name in BUCKETED:
            there = [p for b, p in sorted((there or {}).items()) if buckets is None or int(b) in buckets]
        else:
            there = [there] if there else []
        reader = self.spark.read.schema(schemas.TABLES[name])
        return reader.parquet(*[f"{self.root}/{p}" for p in there]) if there else self.spark.createDataFrame([], schemas.TABLES[name])

    def bucket(self, file_id: Column) -> Column:
        return F.pmod(F.xxhash64(file_id.cast("long")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, file_ids: DataFrame) -> list[int]:
        """Buckets that files (file_id) are in: at most as many as the store has."""
        return sorted(r[0] for r in file_ids.select(self.bucket(F.col("file_id"))).distinct().collect())

    def _in_buckets(self, df: DataFrame, chunks: DataFrame) -> DataFrame:
        """Rows of chunks with their bucket; those of chunks that aren't there are in bucket 0."""
        if "file_id" in df.columns:
            return df.withColumn("bucket", self.bucket(F.col("file_id")))
        of = chunks.select(F.col("id").alias("chunk_id"), self.bucket(F.col("file_id")).alias("bucket"))
        return df.join(of, "chunk_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit(0)))

    def save(self, buckets: list[int] | None = None, **tables: DataFrame | str) -> None:
        """Writes the tables, or of those in buckets (with a column ``bucket``, or the path where they are written) these buckets' rows, then points to them all."""
        old, now = [], dict(self.state["tables"])
        for name, df in tables.items():
            path = df if isinstance(df, str) else f"{name}/{uuid.uuid4().hex}"
            if name not in BUCKETED:
                df.write.parquet(f"{self.root}/{path}")
                old += [now[name]] if name in now else []
                now[name] = path
                continue
            if name == "postings":
                df = df.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(4))).sortWithinPartitions("bucket", "term")
            elif df is not path:
                df = df.repartition("bucket")
            if df is not path:
                df.write.partitionBy("bucket").parquet(f"{self.root}/{path}")
            before = now.get(name, {})
            kept = {b: p for b, p in before.items() if buckets is not None and int(b) not in buckets}
            old += [p for b, p in before.items() if b not in kept]
            there = [x.getPath().getName().split("=")[1] for x in self._fs.globStatus(self._path(f"{self.root}/{path}/bucket=*")) or []]
            now[name] = kept | {b: f"{path}/bucket={b}" for b in there}
        self.state["tables"] = now
        self.state.setdefault("old", []).extend(old)
        self._write_pointer()

    def vacuum(self) -> None:
        """Deletes snapshots that this store has replaced."""
        old = self.state.pop("old", [])
        self._write_pointer()
        for path in old:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        for number, path in self._pointers():
            if number < self.number:
                self._fs.delete(path, False)

    # repositories and files

    def upsert_repository(self, repo_id: str, path: str, last_commit: str | None = None, config: str | None = None) -> None:
        row = self.spark.createDataFrame([(repo_id, path, last_commit, None, config)], schemas.REPOSITORIES).withColumn("indexed_at", F.current_timestamp())
        self.save(repositories=incremental.upsert_newest(self.table("repositories"), row, ["id"]))

    def repository(self, repo_id: str) -> DataFrame:
        return self.table("repositories").where(F.col("id") == repo_id)

    def repository_by_path(self, path: str) -> DataFrame:
        return self.table("repositories").where(F.col("path") == path).orderBy("id").limit(1)

    def upsert_files(self, scanned: DataFrame) -> DataFrame:
        """Upserts scanned files (repo_id, path, hash, language); returns the written changes."""
        files, changes = incremental.upsert_files(self.table("files"), scanned, self.state["file_id"])
        path = f"changes/{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.root}/{path}")
        self.save(files=files)
        self.state["file_id"] = max(self.state["file_id"], self.table("files").agg(F.max("id")).first()[0] or 0)
        self._write_pointer()
        return self.spark.read.parquet(f"{self.root}/{path}")

    def file(self, repo_id: str, path: str) -> DataFrame:
        return self.table("files").where((F.col("repo_id") == repo_id) & (F.col("path") == path))

    def active_files(self, repo_id: str) -> DataFrame:
        return self.table("files").where((F.col("repo_id") == repo_id) & (F.col("active") == 1))

    def deactivate_files(self, ids: DataFrame) -> int:
        n = self.table("files").where("active = 1").join(ids.select("id").distinct(), "id", "left_semi").count()
        if n:
            self.save(files=incremental.deactivate(self.table("files"), ids))
        return n

    # chunks

    def replace_chunks(self, touched: DataFrame, new: DataFrame, refresh: bool = False) -> int:
        """Replaces the chunks of files ``touched`` (file_id) by ``new`` (file_id, seq, content, …), reusing equal ones; deleted chunks' vectors go too.

        Chunks of files that the store doesn't have are an error, and nothing is changed.
        """
        new = new if "hash" in new.columns else incremental.with_hash(new)
        files = self.table("files")
        if new.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").limit(1).count():
            raise ValueError("chunks of a file that isn't in the store")
        buckets = self.buckets_of(touched)
        chunks, deleted = incremental.replace_chunks(self.table("chunks", buckets), touched, new, self.state["chunk_id"], refresh)
        path = f"deleted/{uuid.uuid4().hex}"
        deleted.write.parquet(f"{self.root}/{path}")
        gone = self.spark.read.schema(deleted.schema).parquet(f"{self.root}/{path}")
        self._save_chunks(buckets, chunks, gone)
        self.state["chunk_id"] = max(self.state["chunk_id"], self.table("chunks", buckets).agg(F.max("id")).first()[0] or 0)
        self._write_pointer()
        return gone.count()

    def _save_chunks(self, buckets: list[int], chunks: DataFrame, gone: DataFrame) -> None:
        """Replaces the chunks of buckets, takes the vectors of ``gone`` (id) out of them and indexes them again."""
        vectors = self.table("vectors", buckets).join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(*schemas.VECTORS.fieldNames())
        path = f"chunks/{uuid.uuid4().hex}"  # ids are given while this is written, so that the index is made of the same
        self._in_buckets(chunks, chunks).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        written = self.spark.read.schema(schemas.CHUNKS).parquet(f"{self.root}/{path}").select(*schemas.CHUNKS.fieldNames())
        self.save(buckets, chunks=path, vectors=self._in_buckets(vectors, written), **self._index(written))

    def _index(self, chunks: DataFrame) -> dict[str, DataFrame]:
        return {"postings": self._in_buckets(fulltext.postings(chunks), chunks), "lengths": self._in_buckets(fulltext.lengths(chunks), chunks)}

    def reindex(self) -> None:
        """Builds the index of all chunks anew."""
        self.save(**self._index(self.table("chunks")))

    def file_chunks(self, file_id: int) -> DataFrame:
        return self.table("chunks").where(F.col("file_id") == file_id).orderBy("seq")

    def chunk(self, chunk_id: int) -> DataFrame:
        """A chunk with its file, active or not."""
        f = self.table("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "repo_id", "language")
        return self.table("chunks").where(F.col("id") == chunk_id).join(f, "file_id")

    def cleanup(self) -> tuple[int, int]:
        """Deletes chunks and vectors of inactive files; returns both counts."""
        chunks, files, vectors = self.table("chunks"), self.table("files"), self.table("vectors")
        orphans = incremental.orphan_chunks(chunks, files).select("id")
        n = orphans.count()
        m = vectors.join(orphans.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").count()
        if n:
            buckets = self.buckets_of(files.where("active = 0").select(F.col("id").alias("file_id")))
            mine = self.table("chunks", buckets)
            self._save_chunks(buckets, mine.join(orphans, "id", "left_anti").select(*schemas.CHUNKS.fieldNames()), orphans)
        return n, m

    # vectors

    def unembedded(self, limit: int | None = None) -> DataFrame:
        return incremental.unembedded(self.table("chunks"), self.table("files"), self.table("vectors"), limit)

    def insert_embeddings(self, rows: DataFrame) -> None:
        """Adds or replaces vectors (chunk_id, embedding, model, embedded_at)."""
        files = self.table("chunks").select(F.col("id").alias("chunk_id"), "file_id").join(rows.select("chunk_id"), "chunk_id", "left_semi")
        known = rows.select("chunk_id").join(files, "chunk_id", "left_anti").limit(1).count() == 0
        buckets = sorted({*self.buckets_of(files), *([] if known else [0])})
        merged = incremental.upsert_newest(self.table("vectors", buckets), rows, ["chunk_id"])
        self.save(buckets, vectors=self._in_buckets(merged, self.table("chunks", buckets)))

    def clear_all(self) -> None:
        """Empties all tables but the repositories; ids go on from where they were."""
        self._drop("files", *BUCKETED)

    def _drop(self, *names: str) -> None:
        for n in names:
            there = self.state["tables"].pop(n, None) or []
            self.state.setdefault("old", []).extend([there] if isinstance(there, str) else there.values() if there else [])
        self._write_pointer()

    def clear_vectors(self) -> None:
        self._drop("vectors")

    def stats(self) -> DataFrame:
        return incremental.statistics(*(self.table(t) for t in ("repositories", "files", "chunks", "vectors")))

    # search

    def index_for(self, text: str) -> DataFrame:
        """The postings; sorted by term in each bucket, so that a query's words select row groups."""
        return self.table("postings")

    def search_bm25(self, text: str, limit: int | None = 20) -> DataFrame:
        return fulltext.search_bm25(self.index_for(text), self.table("lengths"), self.table("chunks"), self.table("files"), text, limit)

    def search_vector(self, query: Sequence[float], k: int = 20) -> DataFrame:
        return vector.hits_of(vector.search_vectors(self.table("vectors"), query, k), self.table("chunks"), self.table("files"))
