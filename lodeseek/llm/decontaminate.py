"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions alone.

A window has as many words as an item and is compared by five-word shingles, each as often as it occurs. Windows of every
item's size are laid at every place of every document where they hold at least one shingle of an item of that size; no
other window can be similar. Windows and items get 64-bit SimHashes, in which the second and later times of a shingle
count as shingles of their own, so that bits differ as the weighted similarity does. Fingerprints are cut into BLOCKS
blocks, and items are indexed under every block value within RADIUS // BLOCKS bits, so no pair within RADIUS bits is
missed; windows of similarity 0.75 differ in about 11 bits, and beyond RADIUS with a chance of about 1e-4 each. Pairs
within RADIUS are verified by exact weighted similarity, sum of minima over sum of maxima of the shingles' counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WIDTH, PERCENT, RADIUS, BLOCKS = 5, 75, 23, 8
_BITS = 64 // BLOCKS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; empty if there are fewer words."""

    def of(coded: Column) -> Column:
        n = F.size(coded)
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(coded, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return runtime.let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _hashed(rows: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """Adds ``sh``, hashes of all shingles of ``text`` in order."""
    return rows.select(*keep, _shingles(_words("text"), width).alias("sh"))


def _plane(j: int, mask: int):
    return lambda h: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask))


def _simhash(shingles: Column, count: Column, lane: int) -> Column:
    """Majority of each of the hashes' 64 bits. Bits are counted in lanes of ``lane`` bits, several in a long."""
    mask = sum(1 << (lane * k) for k in range(64 // lane))
    out = F.lit(0).cast("long")
    for j in range(lane):
        counted = F.aggregate(F.transform(shingles, _plane(j, mask)), F.lit(0).cast("long"), lambda acc, bits: acc + bits)
        # every other lane at a time, so that no sum reaches the sign
        ones = sum(1 << (2 * lane * k) for k in range(32 // lane))
        add = F.lit(ones) * (F.lit((1 << (lane - 1)) - 1) - F.floor(count / 2)).cast("long")
        for side in (0, lane):
            half = F.shiftrightunsigned(counted, side).bitwiseAND(F.lit(ones * ((1 << lane) - 1)))
            major = F.shiftrightunsigned(half + add, lane - 1).bitwiseAND(F.lit(ones))
            out = out.bitwiseOR(F.shiftleft(major, side + j))
    return out


def _block(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, i * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _flips() -> list[int]:
    return [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(_BITS), r)]


def _both(a: str, b: str) -> Column:
    """Sum over shingles of the smaller of its counts in two arrays."""
    def count(where: str, x: Column) -> Column:
        return F.size(F.filter(where, lambda y: y == x))

    return F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def _numbered(sh: str) -> Column:
    """The shingles of an array with the second and later times of one as hashes of their own."""

    def of(h: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(sh, F.lit(1), i), lambda y: y == h))
        return F.when(before == 0, h).otherwise(F.xxhash64(h, before))

    return F.when(F.size(F.array_distinct(sh)) == F.size(sh), F.col(sh)).otherwise(F.transform(sh, of))


def windows_of(documents: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Hashed texts (doc_id, t, sh) that hold a shingle of an item, and in them doc_id, t, n, start of the windows of n shingles that do.

    A text of fewer shingles than n is one window.
    """
    index = runtime.written(items.select(F.col("n"), F.explode("sh").alias("h")).distinct(), "index")
    keys = documents.select("doc_id", F.xxhash64("text").alias("t"), "text")
    seeds = _hashed(keys, width, ["doc_id", "t"]).select("doc_id", "t", F.posexplode("sh").alias("p", "h")).join(runtime.joined_side(index), "h")
    seeds = runtime.written(seeds.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "n").agg(F.collect_set("p").alias("at")), "seeds")
    some = runtime.written(seeds.select("_d", "_t").distinct(), "some")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    held = keys.join(runtime.joined_side(some), same, "left_semi").dropDuplicates(["doc_id", "t"])
    held = runtime.written(_hashed(held, width, ["doc_id", "t"]), "held")
    last = F.greatest(F.size("sh") - F.col("n"), F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.least(F.greatest(p - F.col("n") + 1, F.lit(0)), last), F.least(p, last)))))
    return held, seeds.join(held, same).select("doc_id", "t", "n", "sh", F.explode(starts).alias("start"))


def candidates(windows: DataFrame, items: DataFrame, longest: int) -> DataFrame:
    """doc_id, t, n, start, item_id, u of all windows and items of n shingles whose SimHashes differ in RADIUS bits at most."""
    lane = next(b for b in (8, 16, 32) if longest < 1 << (b - 1))
    cut = windows.select("doc_id", "t", "n", "start", F.slice("sh", F.col("start") + 1, F.col("n")).alias("sh")).withColumn("sh", _numbered("sh"))
    prints = runtime.written(cut.select("doc_id", "t", "n", "start", _simhash(F.col("sh"), F.size("sh"), lane).alias("print")), "windows")
    own = items.select("item_id", "u", "n", _numbered("sh").alias("sh")).select("item_id", "u", "n", _simhash(F.col("sh"), F.col("n"), lane).alias("own"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), _block(F.col("own"), i).bitwiseXOR(F.lit(x)).alias("v")) for i in range(BLOCKS) for x in _flips()])
    index = runtime.written(own.select("item_id", "u", "n", "own", F.explode(near).alias("b")).select("item_id", "u", "n", "own", "b.*"), "blocks")
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), _block(F.col("print"), i).alias("v")) for i in range(BLOCKS)])
    rows = prints.select("doc_id", "t", "n", "start", "print", F.explode(blocks).alias("b")).select("doc_id", "t", "n", "start", "print", "b.*")
    found = rows.join(runtime.joined_side(index), ["n", "i", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= RADIUS)
    return found.select("doc_id", "t", "n", "start", "item_id", "u").distinct()


def _leaks(documents: DataFrame, items: DataFrame, width: int, longest: int) -> DataFrame:
    """items: item_id, u (of its text), sh (all of this shingle width). The best window of each document and item, if similar enough."""
    items = items.select("item_id", "u", "sh", F.size("sh").alias("n"))
    held, windows = windows_of(documents, items, width)
    found = candidates(windows, items, longest).groupBy("doc_id", "t").agg(F.collect_list(F.struct("n", "start", "item_id", "u")).alias("found"))
    texts = held.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "sh")
    pairs = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "sh", F.explode("found").alias("f"))
    pairs = pairs.select("doc_id", "f.*", F.slice("sh", F.col("f.start") + 1, F.col("f.n")).alias("a"))
    pairs = pairs.join(items.select(F.col("item_id").alias("_item"), F.col("u").alias("_u"), F.col("sh").alias("b")), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("u") == F.col("_u"))).withColumn("both", _both("a", "b"))
    all_ = F.size("a") + F.size("b") - F.col("both")
    pairs = pairs.withColumn("all", all_).where(100 * F.col("both") >= PERCENT * F.col("all"))
    return _best(pairs.select("doc_id", "item_id", F.col("start").cast("int").alias("start"), (F.size("a") + width - 1).cast("int").alias("n_words"), (F.col("both") / F.col("all")).alias("similarity")))


def _best(found: DataFrame) -> DataFrame:
    """The most similar window of each document and item, the first of equals."""
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words")).alias("x"))
    return best.select("doc_id", "item_id", "x.start", "x.n_words", (-F.col("x.s")).alias("similarity"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start and n_words (of the most similar window, the first of equals), similarity; one row a pair.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are lower-cased in A-Z. An item
    of fewer than five words has one shingle, all its words; a document shorter than an item is one window. Null and
    empty texts match nothing. Repeated rows count once; rows of one doc_id or item_id (null is one, too) with other
    texts are searched alike.
    """
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") > 0).withColumn("u", F.xxhash64("w")).dropDuplicates(["item_id", "u"])
    items = runtime.written(items.withColumn("width", F.least(F.size("w"), F.lit(WIDTH))), "benchmark")
    out = None
    for r in items.groupBy("width").agg(F.max(F.size("w")).alias("most")).orderBy("width").collect():  # five rows at most
        coded = items.where(F.col("width") == r["width"]).select("item_id", "u", _shingles(F.col("w"), r["width"]).alias("sh"))
        found = _leaks(texts, coded, r["width"], r["most"])
        out = found if out is None else _best(out.unionByName(found))
    return out if out is not None else texts.limit(0).crossJoin(benchmark.limit(0).select("item_id")).select("doc_id", "item_id", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
), sized AS (SELECT kind, id, w, len(w) AS n, unnest(CASE WHEN kind = 'd' THEN [1, 2, 3, 4, 5] ELSE [least(len(w), 5)] END) AS k FROM w),
sh AS (
  SELECT kind, id, k, n - k + 1 AS m, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM sized WHERE n >= k AND k > 0 AND k IN (SELECT k FROM sized WHERE kind = 'i'))
), item AS (SELECT id AS item_id, k, any_value(m) AS m, s, count(*) AS c FROM sh WHERE kind = 'i' GROUP BY id, k, s),
seed AS (SELECT d.id AS doc_id, item_id, d.p, d.s, i.c, i.k, i.m, d.m AS dm FROM sh d JOIN item i ON d.kind = 'd' AND d.s = i.s AND d.k = i.k),
win AS (SELECT DISTINCT doc_id, item_id, m, dm, k, unnest(range(least(greatest(p - m + 1, 0), greatest(dm - m, 0)), least(p, greatest(dm - m, 0)) + 1)) AS start FROM seed),
hit AS (
  SELECT doc_id, item_id, start, any_value(least(win.m, win.dm)) AS a, any_value(win.m) AS b, any_value(win.k) AS k, seed.s, least(count(*), any_value(seed.c)) AS common
  FROM win JOIN seed USING (doc_id, item_id) WHERE seed.p BETWEEN start AND start + least(win.m, win.dm) - 1 GROUP BY doc_id, item_id, start, seed.s
), scored AS (SELECT doc_id, item_id, start, any_value(a) AS a, any_value(b) AS b, any_value(k) AS k, sum(common) AS i FROM hit GROUP BY doc_id, item_id, start),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i DESC, start) AS r FROM scored WHERE 100 * i >= {PERCENT} * (a + b - i))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(a + k - 1 AS INTEGER) AS n_words, CAST(i AS DOUBLE) / CAST(a + b - i AS DOUBLE) AS similarity FROM ranked WHERE r = 1
"""
