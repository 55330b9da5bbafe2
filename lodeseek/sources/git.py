"""Changes of a git repository since a commit."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = 30
SCHEMA = "status string, path string, old_path string"


@dataclass
class Changes:
    current_commit: str | None
    full_scan: bool
    changes: DataFrame


def _git(path: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=TIMEOUT, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def is_repository(path: str) -> bool:
    return (_git(path, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def current_commit(path: str) -> str | None:
    return (_git(path, "rev-parse", "HEAD") or "").strip() or None


def is_commit_hash(value: str | None) -> bool:
    return bool(value) and re.fullmatch(r"[0-9a-fA-F]{4,40}", value) is not None


def parsed_status(line: Column) -> Column:
    """(status, path, old_path) of a line of name-status output; copies are additions, unknown letters modifications."""
    part = F.split(line, "\t", -1)
    letter = F.left(part[0], F.lit(1))
    two = letter.isin("R", "C") & (F.size(part) > 2)
    status = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").when(letter == "C", "added").otherwise("modified")
    return F.struct(status.alias("status"), F.when(two, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(two & (letter == "R"), F.get(part, F.lit(1))).alias("old_path"))


def detect_changes(spark: SparkSession, path: str, last_commit: str | None) -> Changes:
    """Committed changes since ``last_commit``; a full scan if there is none, or it isn't known here."""
    now = current_commit(path)
    none = spark.createDataFrame([], SCHEMA)
    if now is None or not is_commit_hash(last_commit) or _git(path, "cat-file", "-e", f"{last_commit}^{{commit}}") is None:
        return Changes(now, True, none)
    if now == last_commit:
        return Changes(now, False, none)
    diff = _git(path, "-c", "core.quotePath=false", "diff", "--name-status", f"{last_commit}..HEAD")
    if diff is None:
        return Changes(now, True, none)
    lines = [(x,) for x in diff.splitlines() if x.strip()]
    rows = spark.createDataFrame(lines, "line string").select(parsed_status(F.col("line")).alias("c")).select("c.*")
    return Changes(now, False, rows)
