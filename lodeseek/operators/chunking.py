"""Splitting of files into chunks: token windows, long lines, a bound for all; syntax where a parser knows the language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP = 900, 0.15
OUTPUT = "file_id long, seq int, start_line int, end_line int, chunk_type string, name string, content string"


@dataclass(frozen=True)
class Chunk:
    content: str
    start_line: int
    end_line: int
    kind: str
    name: str | None = None


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def best_split(lines: list[str], target: int, window: int) -> int:
    """The line that follows a window which ends near ``target``: the one after a blank line before, or else after, or else the least indented line around."""
    low, high = max(0, target - window), min(len(lines) - 1, target + window)
    for i in [*range(target, low - 1, -1), *range(target + 1, high + 1)]:
        if not lines[i].strip():
            return i + 1
    return min((len(lines[i]) - len(lines[i].lstrip()), i) for i in range(low, high + 1))[1]


def split_long_line(line: str, most: int, at: int, kind: str = "block", name: str | None = None) -> list[Chunk]:
    size = most * 4
    parts = [line[i : i + size] for i in range(0, len(line), size)]
    return [Chunk(p, at, at, kind, name) for p in parts if p.strip()]


def token_windows(content: str, most: int = MAX_TOKENS, overlap: float = OVERLAP) -> list[Chunk]:
    """Overlapping windows of whole lines, ended at a good place; each window starts after the one before it."""
    lines = content.split("\n")
    if estimate(content) <= most:
        return [Chunk(content, 1, len(lines), "module")] if content.strip() else []
    spare, out, start = int(most * overlap), [], 0
    cost = [-(-(len(x) + 1) // 4) for x in lines]
    while start < len(lines):
        if cost[start] > most:
            out += split_long_line(lines[start], most, start + 1)
            start += 1
            continue
        end, used = start, 0
        while end < len(lines) and used + cost[end] <= most:
            used += cost[end]
            end += 1
        if end < len(lines):
            end = max(best_split(lines, end - 1, min(10, (end - start) // 5)), start + 1)
        text = "\n".join(lines[start:end])
        if text.strip():
            out.append(Chunk(text, start + 1, end, "block"))
        if end >= len(lines):
            break
        back, used = 0, 0
        while end - back - 1 > start and used + cost[end - back - 1] <= spare:
            used += cost[end - back - 1]
            back += 1
        start = max(end - back, start + 1)
    return out


def bounded(chunks: list[Chunk], most: int = MAX_TOKENS) -> list[Chunk]:
    """Chunks over the bound cut by lines, and lines over it by characters."""
    out: list[Chunk] = []
    for c in chunks:
        if estimate(c.content) <= most:
            out.append(c)
            continue
        held: list[str] = []
        at = line_no = c.start_line

        def emit(upto: int) -> None:
            if text := "\n".join(held):
                if text.strip():
                    out.append(replace(c, content=text, start_line=at, end_line=upto))
            held.clear()

        for line in c.content.split("\n"):
            if estimate(line) > most:
                emit(line_no - 1)
                out += split_long_line(line, most, line_no, c.kind, c.name)
                at = line_no + 1
            else:
                if held and estimate("\n".join([*held, line])) > most:
                    emit(line_no - 1)
                    at = line_no
                held.append(line)
            line_no += 1
        emit(line_no - 1)
    return out


def chunk_text(content: str, path: str, most: int = MAX_TOKENS, overlap: float = OVERLAP, parsers: dict[str, Callable] | None = None) -> list[Chunk]:
    """By syntax if a parser knows the extension and can read the file, else by token windows; no chunk over the bound."""
    from .syntax import PARSERS

    known = PARSERS if parsers is None else parsers
    dot = path.rpartition("/")[2].rpartition(".")
    parser = known.get(f".{dot[2].lower()}") if dot[0] else None
    found: list[Chunk] = []
    if parser and content.strip():
        try:
            found = parser(content, most)
        except (SyntaxError, ValueError, RecursionError):
            found = []
    return bounded(found or token_windows(content, most, overlap), most)


def chunk_files(files: DataFrame, most: int = MAX_TOKENS, overlap: float = OVERLAP, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Chunks of files (file_id, path, content), numbered by seq from 0; each file by itself, whatever task it is in."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = chunk_text(content or "", path or "", most, overlap, parsers)
                if found:
                    cols = [(file_id, i, c.start_line, c.end_line, c.kind, c.name, c.content) for i, c in enumerate(found)]
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cols, strict=True), types, strict=True)], ["file_id", "seq", "start_line", "end_line", "chunk_type", "name", "content"])

    return files.select(F.col("file_id").cast("long"), "path", "content").mapInArrow(task, OUTPUT)


def fixed_slices(rows: DataFrame, key: str, text: str, characters: int) -> DataFrame:
    """key, part, content: slices of ``characters`` of a text that aren't blank, with DataFrame functions alone."""
    n = F.ceil(F.length(text) / characters).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * characters + 1, F.lit(characters)))
    out = rows.where(F.length(text) > 0).select(key, F.posexplode(parts).alias("part", "content"))
    return out.where(F.trim("content") != "")
