"""The search pipeline: filters, expansion, BM25 and vector lists, fusion, filter, rerank, limit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import apply_filters, parse_query
from ..functions.text import rerank_document
from ..operators import fusion, rerank
from ..operators.embedding import Embedder, LanguageModel
from ..operators.fulltext import HIT, with_chunks
from .store import Store

LIMIT, FILTERED, UNFILTERED = 20, 10, 3
MODES = ("hybrid", "bm25", "vector")


@dataclass
class Response:
    """Results best first: the columns of a hit, score, and scores (bm25, vector, rrf, rerank)."""

    results: DataFrame
    timing: dict[str, float] | None = None
    counts: dict[str, int] | None = None
    variants: list[tuple[str, str]] = field(default_factory=list)


def expansion_prompt(query: str) -> str:
    return (
        "Rewrite a query for searching source code in three ways: lex, its technical terms and names for keyword search; vec, its intent in other words; "
        'hyde, a few lines of code that would answer it. Reply with a JSON array like [{"type":"lex","text":"…"},{"type":"vec","text":"…"},{"type":"hyde","text":"…"}] and nothing else.\n\n'
        f"Query: {query}"
    )


def expand(query: str, model: LanguageModel | None) -> list[tuple[str, str]]:
    """Variants of a query; none without a model or if it fails."""
    if model is None:
        return []
    try:
        return rerank.parse_expansion(model.generate(expansion_prompt(query), temperature=0.3, max_tokens=512), query)
    except Exception:
        return []


class Searcher:
    """Searches a store. Without an embedder there are no vector lists, without a model no expansion and no reranking."""

    def __init__(self, store: Store, embedder: Embedder | None = None, model: LanguageModel | None = None, clock: Callable[[], float] = time.perf_counter):
        self.store, self.embedder, self.model, self.clock = store, embedder, model, clock

    def search(self, raw: str, mode: str = "hybrid", limit: int = LIMIT, expand_query: bool = False, rerank_results: bool = False, rrf_k: int = fusion.RRF_K, benchmark: bool = False) -> Response:
        """``raw`` may hold inline filters; they apply to the fused list, whose ranks they don't change.

        More rows than ``limit`` are fetched, ten times as many under filters. Model failures leave the order as it is; an
        embedding failure is raised.
        """
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
        began = self.clock()
        text, filters = parse_query(raw)
        fetch = limit * (FILTERED if filters else UNFILTERED)
        timing, counts = {}, {}
        variants = self._timed(timing, "expand", lambda: expand(text, self.model)) if expand_query and self.model else []
        lists: list[DataFrame] = []
        if mode != "vector":
            texts = [text, *(t for k, t in variants if k == "lex")]
            found = self._timed(timing, "bm25", lambda: [self._kept(fusion.ranked_list(self.store.search_bm25(t, fetch), "bm25", i, "rank", "chunk_id"), benchmark) for i, t in enumerate(texts)])
            counts["bm25"] = sum(x.count() for x in found) if benchmark else 0
            lists += found
        if mode != "bm25" and self.embedder:
            texts = [text, *(t for k, t in variants if k != "lex")]
            vectors = self.embedder.embed(texts)
            found = self._timed(timing, "vector", lambda: [self._kept(fusion.ranked_list(self.store.search_vector(v, fetch), "vector", i, "distance", "chunk_id"), benchmark) for i, v in enumerate(vectors)])
            counts["vector"] = sum(x.count() for x in found) if benchmark else 0
            lists += found
        most = fetch if filters or rerank_results else limit
        results = self._timed(timing, "fusion", lambda: self._kept(self._fused(lists, most, rrf_k, filters), benchmark))
        if rerank_results and self.model:
            results = self._timed(timing, "rerank", lambda: self._reranked(text, results, limit))
        results = results.orderBy("place").limit(limit).select(*HIT, "score", F.struct("bm25", "vector", "rrf", F.col("rerank")).alias("scores"))
        timing["total"] = (self.clock() - began) * 1000
        return Response(results, timing if benchmark else None, counts if benchmark else None, variants)

    def _timed(self, timing: dict[str, float], stage: str, work: Callable):
        began = self.clock()
        out = work()
        timing[stage] = (self.clock() - began) * 1000
        return out

    def _kept(self, df: DataFrame, benchmark: bool) -> DataFrame:
        """Runs the stage when stages are timed; rows are few by then."""
        return self.store.spark.createDataFrame(df.collect(), df.schema) if benchmark else df

    def _fused(self, lists: list[DataFrame], most: int, k: int, filters) -> DataFrame:
        from pyspark.sql import Window

        if not lists:
            empty = self.store.table("chunks").limit(0).select(F.col("id").alias("chunk_id"))
            fused = empty.select("chunk_id", F.lit(0.0).alias("rrf"), F.lit(None).cast("double").alias("bm25"), F.lit(None).cast("double").alias("vector"), F.struct(F.lit(0).alias("source")).alias("first_seen"))
        else:
            fused = fusion.fuse(fusion.union_lists(lists), most, k)
        hits = with_chunks(F.broadcast(fused), self.store.table("chunks"), self.store.table("files"), active=False)  # at most ``most`` rows
        hits = apply_filters(hits, filters)
        place = F.row_number().over(Window.orderBy(F.desc("rrf"), "first_seen")) - 1
        return hits.select(*HIT, F.col("rrf").alias("score"), "bm25", "vector", "rrf", F.lit(None).cast("double").alias("rerank"), place.alias("place"))

    def _reranked(self, text: str, results: DataFrame, limit: int) -> DataFrame:
        spark, top = self.store.spark, 2 * limit
        document = rerank_document(F.col("chunk_type"), F.col("name"), F.col("file_path"), F.col("content"))
        rows = results.withColumn("document", document).orderBy("place").collect()  # as many as were fetched
        if not rows:
            return results
        try:
            scores = self.model.rerank(text, [r["document"] for r in rows[:top]])
        except Exception:
            return results
        scored = spark.createDataFrame([(r["chunk_id"], float(s)) for r, s in zip(rows, scores, strict=False)], "chunk_id long, _raw double")
        given = spark.createDataFrame(rows, results.withColumn("document", document).schema).drop("document", "rerank").join(scored, "chunk_id", "left").withColumn("_all", F.lit(1))
        in_top = F.when(F.col("place") < top, F.coalesce("_raw", F.lit(0.0)))
        given = given.withColumn("rerank", rerank.normalised(in_top, ["_all"]))
        return rerank.blended(given, top, ["_all"]).withColumn("place", F.col("position")).drop("_raw", "_all", "position")
