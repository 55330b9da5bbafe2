"""Indexing a folder, updating it, embedding what is new."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, incremental
from ..operators.embedding import Embedder, HashEmbedder, HttpEmbedder, HttpLanguageModel, LanguageModel, embed_chunks
from ..sources import git, scan
from ..sources.config import Config
from .store import Store, UpdateReport

HOOK_TIMEOUT = 60


def repository_id(path: str) -> str:
    return os.path.basename(os.path.abspath(path))


def scanned(store: Store, source: str, config: Config) -> DataFrame:
    return scan.scan(store.spark, source, repository_id(source), config.scanner.exclude, config.scanner.max_file_size)


def _apply(store: Store, found: DataFrame, config: Config, report: UpdateReport) -> None:
    """Upserts scanned files and rechunks the new and the changed ones."""
    changes = store.upsert_files(found)
    by = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    report.new, report.changed, report.unchanged = (by.get(k, 0) for k in ("new", "changed", "unchanged"))
    todo = changes.where(F.col("status").isin("new", "changed")).select("repo_id", "path")
    files = store.table("files").join(todo, ["repo_id", "path"]).select(F.col("id").alias("file_id"), "repo_id", "path")
    touched = files.select("file_id")
    content = found.select("repo_id", "path", "content").join(files, ["repo_id", "path"]).select("file_id", "path", "content")
    new = chunking.chunk_files(content, config.chunker.max_tokens, config.chunker.overlap)
    if report.new + report.changed:
        report.deleted_chunks += store.replace_chunks(touched, new)


def index(store: Store, source: str, config: Config, rebuild: bool = False) -> UpdateReport:
    """Full scan. Files that are gone stay as they are."""
    report = UpdateReport()
    if rebuild:
        store.clear_all()
    _apply(store, scanned(store, source, config), config, report)
    store.upsert_repository(repository_id(source), os.path.abspath(source))
    return report


def run_hook(command: str | None, folder: str) -> bool:
    """Runs a collection's command before an update; its failure doesn't stop the update."""
    if not command:
        return True
    try:
        return subprocess.run(command, shell=True, cwd=folder, timeout=HOOK_TIMEOUT, check=False).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


def update(store: Store, source: str, config: Config, command: str | None = None) -> UpdateReport:
    """Brings the store up to date: by git's changes where the last commit is known, else by hashes of a full scan.

    Files that are gone, and old names of renamed ones, become inactive; their chunks and vectors are deleted.
    """
    run_hook(command, source)
    repo, report = repository_id(source), UpdateReport()
    known = store.repository(repo).select("last_commit").collect()  # one row
    diff = git.detect_changes(store.spark, source, known[0][0] if known else None) if git.is_repository(source) else None
    found = scanned(store, source, config)
    if diff is None or diff.full_scan:
        _apply(store, found, config, report)
        gone = incremental.missing_files(store.table("files").where(F.col("repo_id") == repo), found).select("id")
    else:
        routed = incremental.routed(diff.changes)
        _apply(store, found.join(routed.where("action = 'process'").select("path").distinct(), "path", "left_semi"), config, report)
        paths = routed.where("action = 'deactivate'").select("path").distinct()
        gone = store.table("files").where((F.col("repo_id") == repo) & (F.col("active") == 1)).join(paths, "path", "left_semi").join(found.select("path"), "path", "left_anti").select("id")
    report.deactivated = store.deactivate_files(gone)
    chunks, vectors = store.cleanup()
    report.deleted_chunks, report.deleted_vectors = report.deleted_chunks + chunks, vectors
    store.upsert_repository(repo, os.path.abspath(source), diff.current_commit if diff else None)
    return report


def embed(store: Store, make: Callable[[], Embedder], rebuild: bool = False) -> int:
    """Embeds all chunks without a vector; a run that was broken off goes on with what is left."""
    if rebuild:
        store.clear_vectors()
    before = store.table("vectors").count()
    store.insert_embeddings(embed_chunks(store.unembedded(), make))
    return store.table("vectors").count() - before


def embedder_factory(config: Config, url: str = "https://api.openai.com/v1/embeddings") -> Callable[[], Embedder]:
    c = config.embedder
    if c.provider == "local":
        return lambda: HashEmbedder(c.dimensions)
    if not os.environ.get(c.api_key_env):
        raise ValueError(f"{c.api_key_env} isn't set")
    return lambda: HttpEmbedder(c.model, c.dimensions, c.api_key_env, url)


def language_model(config: Config, url: str = "https://api.openai.com/v1/chat/completions") -> LanguageModel:
    c = config.llm
    if c.provider == "local":
        raise ValueError("no local language model is installed")
    if not os.environ.get(c.api_key_env):
        raise ValueError(f"{c.api_key_env} isn't set")
    return HttpLanguageModel(c.model, c.api_key_env, url)
