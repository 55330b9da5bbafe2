"""Inverted index and BM25 search over it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from .textquery import COLUMNS, Near, Phrase, compile_query, phrases

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words of all queries of a batch that are broadcast.
ASKED_ROWS = 200_000
#: Parts of a batch's ranks: below 1e13, rounded to less than what a double of a usual rank resolves.
PART = "decimal(28,15)"


def _grouped(words: Column) -> Column:
    """Of an array of words: an array of (term, positions), sorted; within the row."""

    def runs(placed: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: (i == 0) | (F.get(placed, i)["term"] != F.get(placed, i - 1)["term"]))

        def run(starts: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                own = F.slice(placed, a + 1, F.coalesce(F.get(starts, k + 1), F.size(placed)) - a)
                return F.struct(F.get(placed, a)["term"].alias("term"), F.transform(own, lambda p: p["pos"]).alias("positions"))

            return F.transform(starts, one)

        return F.when(F.size(placed) > 0, let(begins, run))

    return let(words, runs)


def _placed(words: Column, terms: list[str] | None, prefixes: list[str]) -> Column:
    placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    if terms is not None:
        placed = F.filter(placed, lambda p: reduce(lambda a, b: a | b, [p["term"].startswith(t) for t in prefixes], p["term"].isin(terms)))
    return F.sort_array(placed)


def postings(chunks: DataFrame, terms: list[str] | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    """term, chunk_id, col, positions of chunks (id, content, name), of some terms and prefixes only if given; without a shuffle."""
    each = [chunks.select(F.col("id").alias("chunk_id"), F.lit(c).alias("col"), F.explode(_grouped(_placed(tokens(F.col(c)), terms, list(prefixes)))).alias("p")) for c in COLUMNS]
    return each[0].unionByName(each[1]).select("p.term", "chunk_id", "col", "p.positions")


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, len: tokens of both columns; chunks without tokens count too."""
    return chunks.select(F.col("id").alias("chunk_id"), (F.size(tokens(F.col("content"))) + F.size(tokens(F.col("name")))).cast("long").alias("len"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """term, df, tf: in how many chunks (id, content, name) a term is, and how often; a chunk's terms are counted within its row."""
    words = F.concat(tokens(F.col("content")), tokens(F.col("name")))
    rows = chunks.select(F.explode(_grouped(_placed(words, None, []))).alias("p")).select("p.term", F.size("p.positions").cast("long").alias("f"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("tf"))


def _places(token: str, col: str) -> Column:
    return F.coalesce(F.try_element_at("at", F.lit(f"{col} {token}")), F.array().cast("array<int>"))


def _followed(places: Column, by: int):
    return lambda x: F.array_contains(places, x + by)


def _starts(p: Phrase, col: str) -> Column:
    """Where a phrase starts in a column of the chunk."""
    words = list(p.tokens)
    if p.prefix:
        words[-1] += "*"
    out = _places(words[0], col)
    for i, w in enumerate(words[1:], 1):
        out = F.filter(out, _followed(_places(w, col), i))
    return F.filter(out, lambda x: x == 0) if p.initial else out


def _near_starts(n: Near, col: str) -> list[Column]:
    """Starts of each phrase in a column that lie in a stretch of words with all of them."""
    starts = [_starts(p, col) if col in p.columns else F.array().cast("array<int>") for p in n.phrases]

    def close(a: Column, size: int) -> Column:
        return reduce(lambda x, y: x & y, [F.exists(s, lambda y: (y >= a) & (y <= a + size + n.distance)) for s in starts])

    anchors = [(F.filter(s, _close_to(close, len(p.tokens))), len(p.tokens)) for s, p in zip(starts, n.phrases, strict=True)]

    def held(y: Column) -> Column:
        return reduce(lambda u, v: u | v, [F.exists(a, _covers(y, k + n.distance)) for a, k in anchors])

    return [F.filter(s, held) for s in starts]


def _close_to(close, size: int):
    return lambda a: close(a, size)


def _covers(y: Column, reach: int):
    return lambda x: (y >= x) & (y <= x + reach)


def _counts(node) -> list[Column]:
    """Occurrences of each phrase of the tree, in their order."""
    if isinstance(node, Phrase):
        return [reduce(lambda a, b: a + b, [F.size(_starts(node, c)) for c in node.columns], F.lit(0))]
    if isinstance(node, Near):
        by_col = [[F.size(s) for s in _near_starts(node, c)] for c in COLUMNS]
        return [a + b for a, b in zip(*by_col, strict=True)]
    return [c for part in node.parts for c in _counts(part)]


def _holds(node, counts: list[Column]) -> Column:
    """The truth of the tree; takes its phrases' counts off the list."""
    if isinstance(node, Phrase):
        return counts.pop(0) > 0
    if isinstance(node, Near):
        return reduce(lambda a, b: a & b, [counts.pop(0) > 0 for _ in node.phrases])
    parts = [_holds(p, counts) for p in node.parts]
    if node.op == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)


def matches(index: DataFrame, node) -> DataFrame:
    """chunk_id and ``f``, counts of the query's phrases, of chunks with any; only the query's terms are read."""
    found = phrases(node)
    exact = sorted({t for p in found for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    index = index.where("chunk_id IS NOT NULL")  # in all uses of the plan, so that Spark runs it once
    rows = index.where(F.col("term").isin(exact)).select("term", "chunk_id", "col", "positions")
    for t in sorted({p.tokens[-1] for p in found if p.prefix}):
        begun = index.where(F.col("term").startswith(t)).groupBy("chunk_id", "col").agg(F.flatten(F.collect_list("positions")).alias("positions"))
        rows = rows.unionByName(begun.select(F.lit(f"{t}*").alias("term"), "chunk_id", "col", "positions"))
    chunk = rows.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "col", "term"), "positions"))).alias("at"))
    return chunk.select("chunk_id", F.array(*_counts(node)).alias("f"))


def _idf(n: Column, total: Column) -> Column:
    raw = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bm25(index: DataFrame, sizes: DataFrame, text: str) -> DataFrame | None:
    """chunk_id, rank (negative, smaller is better) of all chunks that a query matches, active or not; None if it asks nothing.

    Statistics are those of all chunks.
    """
    node = compile_query(text)
    if node is None:
        return None
    n = len(phrases(node))
    found = matches(index, node)
    stats = found.agg(F.array(*[F.count_if(F.get("f", F.lit(i)) > 0) for i in range(n)]).alias("df"))
    corpus = sizes.agg(F.count("*").alias("total"), F.sum("len").alias("words"))
    hits = found.where(_holds(node, [F.get("f", F.lit(i)) for i in range(n)])).join(sizes, "chunk_id")
    scored = hits.crossJoin(F.broadcast(stats.crossJoin(corpus)))  # one row
    norm = K1 * (1 - B + B * F.col("len") * F.col("total") / F.col("words"))
    terms = [_idf(F.get("df", F.lit(i)), F.col("total")) * F.get("f", F.lit(i)) * (K1 + 1) / (F.get("f", F.lit(i)) + norm) for i in range(n)]
    return scored.select("chunk_id", (-reduce(lambda a, b: a + b, terms)).alias("rank"))


HIT = ["chunk_id", "file_id", "file_path", "content", "start_line", "end_line", "chunk_type", "name"]


def with_chunks(hits: DataFrame, chunks: DataFrame, files: DataFrame, active: bool = True) -> DataFrame:
    """Hits with their chunk and file; those of inactive files go if ``active``."""
    f = files.where("active = 1") if active else files
    c = chunks.select(F.col("id").alias("chunk_id"), "file_id", "content", "start_line", "end_line", "chunk_type", "name")
    return hits.join(c, "chunk_id").join(f.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def search_bm25(index: DataFrame, sizes: DataFrame, chunks: DataFrame, files: DataFrame, text: str, limit: int | None = 20) -> DataFrame:
    """The best ``limit`` chunks of active files by rank, ties by chunk_id, or all with None, with score |r| / (1 + |r|)."""
    ranked = bm25(index, sizes, text)
    if ranked is None:
        ranked = sizes.limit(0).select("chunk_id", F.lit(0.0).alias("rank"))
    live = ranked.join(chunks.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").join(files.where("active = 1").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    top = live.select("chunk_id", "rank")
    if limit is not None:
        top = top.orderBy("rank", "chunk_id").limit(limit)
    return with_chunks(top, chunks, files).select(*HIT, "rank", bm25_score(F.col("rank")).alias("score"))


def bm25_score(rank: Column) -> Column:
    return F.abs(rank) / (1 + F.abs(rank))


def bm25_batch(index: DataFrame, sizes: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, rank of the best chunks that hold all tokens of each query (query_id, text); a join on terms.

    Parts of a rank are added as decimals, so that their order doesn't matter and copies have the same rank, ties of which go by chunk_id.
    """
    from pyspark.sql import Window

    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    few = asked.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS
    words = asked.select("term").distinct()
    # only the asked terms' postings are shuffled
    index = index.join(F.broadcast(words) if few else words, "term", "left_semi")
    tf = index.groupBy("term", "chunk_id").agg(F.sum(F.size("positions")).alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    corpus = sizes.agg(F.count("*").alias("total"), F.sum("len").alias("words"))
    terms = asked.join(df, "term").crossJoin(F.broadcast(corpus))
    rows = (F.broadcast(terms) if few else terms).join(tf, "term").join(sizes, "chunk_id")
    norm = K1 * (1 - B + B * F.col("len") * F.col("total") / F.col("words"))
    part = F.col("times") * _idf(F.col("df"), F.col("total")) * F.col("f") * (K1 + 1) / (F.col("f") + norm)
    summed = rows.groupBy("query_id", "chunk_id").agg(F.count("*").alias("got"), (-F.sum(part.cast(PART))).cast("double").alias("rank"))
    full = summed.join(need, "query_id").where("got = need")
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return full.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query_id", "chunk_id", "rank")
