"""Directory scans as DataFrames: names are filtered before any content is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_nul, is_binary_name, is_source_name, language

MAX_FILE_SIZE = 1_048_576
# Globs that a scan leaves out, matched against the path below the root.
EXCLUDE = [
    "node_modules/**", ".git/**", "dist/**", "build/**", "out/**", "vendor/**", ".next/**", ".nuxt/**", ".svelte-kit/**", ".turbo/**", "coverage/**",
    "__pycache__/**", ".venv/**", "venv/**", ".cache/**", ".idea/**", ".vscode/**", "*.min.js", "*.min.css", "*.map", "*.lock",
]


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths: ``**`` crosses folders, ``*`` and ``?`` don't, ``{a,b}`` are choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            continue
        if c == "{":
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out, i = out + c, i + 1
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def scan(spark: SparkSession, root: str, repo_id: str, exclude: list[str] | None = None, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """repo_id, path (below the root), hash, size, language, content of the source files under ``root``.

    Left out are dot files and folders, excluded globs, other file names, empty and too large files, and files with a
    zero byte near their start. Sizes are filtered in the listing. Invalid UTF-8 is replaced; the hash is of the bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = str(whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(whole).toUri().getPath()).rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    rows = raw.where(F.col("length").between(1, max_file_size)).select(F.substring(full, F.lit(len(base) + 1), F.length(full)).alias("path"), F.col("length").alias("size"), "content")
    p = F.col("path")
    named = rows.where(~hidden(p) & ~excluded(p, EXCLUDE if exclude is None else exclude) & ~is_binary_name(p) & is_source_name(p))
    fine = named.where(~has_nul(F.col("content")))
    return fine.select(F.lit(repo_id).alias("repo_id"), "path", F.sha2("content", 256).alias("hash"), "size", language(p).alias("language"), F.decode(F.col("content"), "UTF-8").alias("content"))


def total_size(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
