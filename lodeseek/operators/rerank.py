"""Scores of a language model: parsing, normalising, blending with the fused score."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("lex", "vec", "hyde")


def parsed_scores(reply: Column, n: Column) -> Column:
    """n numbers between 0 and 1 from a comma-separated reply: leading numbers of its parts, 0 for others and for missing ones."""
    number = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)"
    each = F.transform(F.split(F.coalesce(reply, F.lit("")), ","), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(F.trim(F.regexp_extract(x, number, 0)), F.lit("")).try_cast("double"), F.lit(0.0)))))
    return F.slice(F.concat(each, F.array_repeat(F.lit(0.0), n)), F.lit(1), n)


def parsed_expansion(reply: Column, query: Column) -> Column:
    """Variants (type, text) of a reply that holds a JSON array; unknown types, empty texts and the query itself are left out."""
    items = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), "array<struct<type:string,text:string>>")
    trimmed = F.transform(items, lambda x: F.struct(x["type"].alias("type"), F.trim(x["text"]).alias("text")))
    kept = F.filter(trimmed, lambda x: x["type"].isin(*KINDS) & (x["text"] != "") & (x["text"] != F.trim(query)))
    return F.coalesce(kept, F.array().cast("array<struct<type:string,text:string>>"))


def parse_expansion(reply: str, query: str) -> list[tuple[str, str]]:
    """As ``parsed_expansion``, for one reply on the driver."""
    m = re.search(r"\[.*\]", reply, re.S)
    try:
        items = json.loads(m[0]) if m else []
    except ValueError:
        return []
    out = [(x["type"], x["text"].strip()) for x in items if isinstance(x, dict) and x.get("type") in KINDS and isinstance(x.get("text"), str)]
    return [(k, t) for k, t in out if t and t != query.strip()]


def normalised(score: Column, by: list[str]) -> Column:
    """Scores over their largest, or as they are where none exceeds 1; never below 0."""
    most = F.greatest(F.max(score).over(Window.partitionBy(*by)), F.lit(1.0))
    return F.greatest(F.lit(0.0), score / most)


def blended(results: DataFrame, top_n: int, by: list[str]) -> DataFrame:
    """Rows (place from 0, score, rerank) with ``score`` blended in the first ``top_n`` and ``position``, the new place from 0.

    The fused score's weight falls from 1 to 0.5 along the list, the model's rises from 0.5 to 1; later rows keep their score
    and come after. ``by`` names the columns of one result (none: pass a constant column).
    """
    n = F.least(F.count("*").over(Window.partitionBy(*by)), F.lit(top_n))
    position = F.col("place") / F.greatest(n - 1, F.lit(1))
    fused, model = 1 - position * 0.5, 0.5 + position * 0.5
    score = F.when(F.col("place") < n, (fused * F.col("score") + model * F.col("rerank")) / (fused + model)).otherwise(F.col("score"))
    out = results.withColumns({"_late": F.col("place") >= n, "_new": score})
    w = Window.partitionBy(*by).orderBy("_late", F.when(F.col("_late"), F.col("place")).otherwise(0), F.desc("_new"), "place")
    return out.withColumns({"position": F.row_number().over(w) - 1, "score": F.col("_new"), "rerank": F.when(~F.col("_late"), F.col("rerank"))}).drop("_late", "_new")
