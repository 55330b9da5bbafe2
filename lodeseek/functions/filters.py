"""Inline filters of query strings (path:, ext:, file:, and the same with a minus) and their predicates."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, basename

KINDS = ("path", "ext", "file")


@dataclass(frozen=True)
class QueryFilters:
    path: list[str] = field(default_factory=list)
    not_path: list[str] = field(default_factory=list)
    ext: list[str] = field(default_factory=list)
    not_ext: list[str] = field(default_factory=list)
    file: list[str] = field(default_factory=list)
    not_file: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))


def parse_query(raw: str) -> tuple[str, QueryFilters]:
    """The text without filters, and the filters. A prefix without a value stays text; extensions get a leading dot."""
    text: list[str] = []
    found = QueryFilters()
    for word in raw.split():
        prefix, colon, value = word.partition(":")
        kind = prefix.removeprefix("-")
        if not colon or not value or kind not in KINDS or prefix not in (kind, f"-{kind}"):
            text.append(word)
            continue
        if kind == "ext" and not value.startswith("."):
            value = f".{value}"
        getattr(found, kind if prefix == kind else f"not_{kind}").append(value)
    return " ".join(text), found


def _matches(path: Column, kind: str, value: str) -> Column:
    if kind == "path":
        return (path == value) | path.startswith(value if value.endswith("/") else f"{value}/")
    if kind == "ext":
        return path.endswith(value)
    return (basename(path) == value) | (path == value) | path.endswith(f"/{value}")


def predicate(path: Column, filters: QueryFilters) -> Column:
    """No exclusion matches, and for each kind with inclusions one of them does."""
    out = F.lit(True)
    for kind in KINDS:
        for value in getattr(filters, f"not_{kind}"):
            out = out & ~_matches(path, kind, value)
        if values := getattr(filters, kind):
            out = out & any_of([_matches(path, kind, v) for v in values])
    return out


def apply_filters(results: DataFrame, filters: QueryFilters) -> DataFrame:
    """Rows of a result whose file_path (or filePath) passes; to be put above any ranking."""
    column = "file_path" if "file_path" in results.columns else "filePath"
    return results.where(predicate(F.col(column), filters)) if filters else results
