"""Maintenance of files and chunks as set-based diffs of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import content_hash

#: Keys of the sample that gives the bounds of ranges, for each range.
KEYS_A_RANGE = 20


def upsert_newest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` in place of old ones with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def file_changes(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """repo_id, path, status (unchanged, changed, new, missing) of stored and scanned files (repo_id, path, hash, …).

    A file is unchanged if its hash is equal and it is active.
    """
    a = files.select("repo_id", "path", F.col("id").alias("file_id"), F.col("hash").alias("old_hash"), "active")
    b = scanned.select("repo_id", "path", F.col("hash").alias("new_hash"))
    both = a.join(b, ["repo_id", "path"], "full_outer")
    status = F.when(F.col("new_hash").isNull(), "missing").when(F.col("file_id").isNull(), "new").when((F.col("old_hash") == F.col("new_hash")) & (F.col("active") == 1), "unchanged").otherwise("changed")
    return both.select("repo_id", "path", "file_id", status.alias("status"))


def _range_of(rows: DataFrame, order: list[str]) -> Column:
    """The range that a row's key lies in, a function of the key alone; the bounds are keys of a sample, and all that depends on it is the ranges' sizes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(*order).orderBy(F.xxhash64(*order)).limit(KEYS_A_RANGE * parts)
    keys = sample.agg(F.sort_array(F.collect_list(F.struct(*order)))).first()[0]
    cuts = keys[KEYS_A_RANGE::KEYS_A_RANGE]
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(cut[c]).cast(rows.schema[c].dataType).alias(c) for c in order]) for cut in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.struct(*order)), at + step).otherwise(at))


def numbered(rows: DataFrame, above: int, order: list[str], name: str = "id") -> DataFrame:
    """Rows with ids above ``above`` in ``order``; numbers are dealt out range by range, not in one task.

    Rows are read once for their numbers and once for the ranges' sizes, so a row's range must not depend on how Spark lays out either.
    """
    ranked = rows.withColumn("_part", _range_of(rows, order))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_size"))
    first = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row a range
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(first), F.col("_part") == F.col("_p")).withColumn(name, (F.lit(above) + F.col("_first") + F.col("_n")).cast("long")).drop("_part", "_p", "_n", "_first")


def upsert_files(files: DataFrame, scanned: DataFrame, high_water: int) -> tuple[DataFrame, DataFrame]:
    """The new files table, and the changes as ``file_changes`` has them. New files get ids above the high-water mark."""
    changes = file_changes(files, scanned)
    seen = scanned.dropDuplicates(["repo_id", "path"])
    fresh = numbered(seen.join(changes.where("status = 'new'").select("repo_id", "path"), ["repo_id", "path"]), high_water, ["repo_id", "path"])
    kept = files.join(seen.select("repo_id", "path", F.col("hash").alias("_hash"), F.col("language").alias("_language")), ["repo_id", "path"], "left")
    same = F.col("_hash").isNull() | ((F.col("_hash") == F.col("hash")) & (F.col("active") == 1))
    updated = kept.select(
        "id", "repo_id", "path", F.coalesce("_hash", "hash").alias("hash"), F.when(F.col("_hash").isNull(), F.col("language")).otherwise(F.col("_language")).alias("language"),
        F.when(F.col("_hash").isNotNull(), F.lit(1)).otherwise(F.col("active")).alias("active"), F.when(same, F.col("indexed_at")).otherwise(F.current_timestamp()).alias("indexed_at"),
    )
    new = fresh.select("id", "repo_id", "path", "hash", "language", F.lit(1).alias("active"), F.current_timestamp().alias("indexed_at"))
    return updated.unionByName(new), changes


def chunk_diff(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reused (id, new_seq), deleted (id) and inserted rows, for files of which ``new`` (file_id, seq, hash, …) has the chunks.

    Of each content in a file the first stored chunk is reused, by its first new occurrence; all others are replaced.
    """
    by_hash = Window.partitionBy("file_id", "hash").orderBy("seq", "id")
    old = existing.select("id", "file_id", "hash", "seq").withColumn("occ", F.row_number().over(by_hash)).where("occ = 1")
    occurring = new.withColumn("occ", F.row_number().over(Window.partitionBy("file_id", "hash").orderBy("seq")))
    reused = occurring.where("occ = 1").select("file_id", "hash", F.col("seq").alias("new_seq")).join(old.select("id", "file_id", "hash"), ["file_id", "hash"]).select("id", "file_id", "hash", "new_seq")
    deleted = existing.select("id").join(reused.select("id"), "id", "left_anti")
    inserted = occurring.join(reused.select("file_id", F.col("new_seq").alias("seq")), ["file_id", "seq"], "left_anti").drop("occ")
    return reused, deleted, inserted


def replace_chunks(chunks: DataFrame, touched: DataFrame, new: DataFrame, high_water: int, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """The new chunks table and the deleted ids, where ``touched`` (file_id) are the files that ``new`` has the chunks of.

    Reused rows keep lines, type and name unless ``refresh``; only their seq changes.
    """
    mine = chunks.join(touched.select("file_id").distinct(), "file_id", "left_semi")
    others = chunks.join(touched.select("file_id").distinct(), "file_id", "left_anti")
    reused, deleted, inserted = chunk_diff(mine, new)
    kept = mine.join(reused.select("id", "new_seq"), "id")
    if refresh:
        lines = new.select("file_id", F.col("seq").alias("new_seq"), *[F.col(c).alias(f"_{c}") for c in ("start_line", "end_line", "chunk_type", "name")])
        kept = kept.join(lines, ["file_id", "new_seq"]).withColumns({c: F.col(f"_{c}") for c in ("start_line", "end_line", "chunk_type", "name")})
    kept = kept.withColumn("seq", F.col("new_seq").cast("int"))
    columns = schemas.CHUNKS.fieldNames()
    fresh = numbered(inserted, high_water, ["file_id", "seq"])
    for c in columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(schemas.CHUNKS[c].dataType))
    return others.select(*columns).unionByName(kept.select(*columns)).unionByName(fresh.select(*columns)), deleted


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash", content_hash(F.col("content")))


def deactivate(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files with active = 0 where ``ids`` (id) has them."""
    gone = ids.select(F.col("id"), F.lit(True).alias("_gone")).distinct()
    return files.join(gone, "id", "left").withColumn("active", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("active"))).select(*files.columns)


def orphan_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of inactive files."""
    return chunks.join(files.where("active = 0").select(F.col("id").alias("file_id")), "file_id", "left_semi")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def missing_files(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active files that the scan hasn't found."""
    return files.where("active = 1").join(scanned.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def unembedded(chunks: DataFrame, files: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks without a vector, with their file's path and language, by id."""
    left = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    out = left.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "language"), "file_id")
    out = out.select("id", "file_id", "file_path", "language", "chunk_type", "name", "content")
    return out.orderBy("id").limit(limit) if limit is not None else out


def statistics(repositories: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: repositories, files, active_files, chunks, embedded, pending (those of inactive files count)."""
    one = repositories.agg(F.count("*").alias("repositories"))
    one = one.crossJoin(files.agg(F.count("*").alias("files"), F.count_if(F.col("active") == 1).alias("active_files")))
    one = one.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(vectors.agg(F.count("*").alias("embedded")))
    return one.withColumn("pending", F.col("chunks") - F.col("embedded"))


def routed(changes: DataFrame) -> DataFrame:
    """Changes (status, path, old_path) with what an update does: process or deactivate; a rename does both to its two paths."""
    base = changes.select("path", F.when(F.col("status") == "deleted", "deactivate").otherwise("process").alias("action"))
    moved = changes.where("status = 'renamed' AND old_path IS NOT NULL").select(F.col("old_path").alias("path"), F.lit("deactivate").alias("action"))
    return base.unionByName(moved)
