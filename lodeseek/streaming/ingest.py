"""Continuous ingest: a stream of changed files is applied to a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, language
from ..operators import chunking, incremental
from ..plans.store import Store


def apply_batch(store: Store, batch: DataFrame, most: int = chunking.MAX_TOKENS) -> None:
    """Applies changes (repo_id, path, status, content, at): the last one of each path counts. A repeated batch changes nothing."""
    last = batch.groupBy("repo_id", "path").agg(F.max_by(F.struct("status", "content"), "at").alias("x")).select("repo_id", "path", "x.*").persist()
    try:
        live = last.where("status <> 'deleted'").select("repo_id", "path", content_hash(F.col("content")).alias("hash"), language(F.col("path")).alias("language"), "content")
        changes = store.upsert_files(live)
        todo = changes.where(F.col("status").isin("new", "changed")).select("repo_id", "path")
        files = store.table("files").join(todo, ["repo_id", "path"]).select(F.col("id").alias("file_id"), "repo_id", "path")
        if files.limit(1).count():
            new = chunking.chunk_files(live.join(files, ["repo_id", "path"]).select("file_id", "path", "content"), most)
            store.replace_chunks(files.select("file_id"), incremental.with_hash(new))
        gone = store.table("files").join(last.where("status = 'deleted'").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        if store.deactivate_files(gone.select("id")):
            store.cleanup()
    finally:
        last.unpersist()


def start(changes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts applying a streaming DataFrame of changes; pass ``availableNow=True`` to drain it and stop."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(store, df))
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
