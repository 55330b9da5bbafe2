"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i every shingle falls into a coordinate by a hash of (shingle, i); a coordinate keeps
the smallest hash of the first round that reaches it. Rounds T to 2T - 1 throw all shingles at coordinate i - T, so every
coordinate is filled for sure, and estimates are concentrated as for independent MinHashes, at about one hash a shingle
for large sets. Bands of ROWS coordinates are keys of candidate groups: two sets of similarity 0.75 share none of the
BANDS with probability (1 - 0.75 ** 4) ** 32 = 5e-6. Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, runtime, shingles, words

T, ROWS, BANDS = 128, 4, 32
#: Characters of text that a task hashes at a time.
BATCH_CHARACTERS = 500_000
PERCENT = 75
#: Equal coordinates that a pair must have before its sets are compared: five deviations under the mean at 0.75.
LIKELY = 72
#: Sets, and shingles in them, of a home or a block of a group (on average, being dealt by hash); larger groups are compared cell by cell.
PART_ROWS, PART_SHINGLES = 1000, 1_000_000
_FULL = np.uint64((1 << 64) - 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates for each set that isn't empty; of an empty set, all ones."""
    out = np.full((len(sets), T), _FULL, np.uint64)
    left = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    x = np.concatenate([sets[i] for i in left]) if len(left) else np.zeros(0, np.uint64)
    sizes = np.array([len(sets[i]) for i in left], np.int64)
    for i in range(2 * T):
        if not len(left):
            break
        v = shingles.mixed(x + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        owner = np.repeat(np.arange(len(left)), sizes)
        place = owner * T + ((v % np.uint64(T)).astype(np.int64) if i < T else i - T)
        thrown = np.full(len(left) * T, _FULL, np.uint64)
        np.minimum.at(thrown, place, v // np.uint64(T))
        now = out[left]
        out[left] = now = np.where(now == _FULL, thrown.reshape(-1, T), now)
        more = (now == _FULL).any(axis=1)
        if not more.all():
            x, left, sizes = x[more[owner]], left[more], sizes[more]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    place = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    rows = shingles.mixed(sketch.reshape(len(sketch), BANDS, ROWS) + place)
    return shingles.mixed(rows.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (a 128-bit name of the set), bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in words.batches_of(batches, BATCH_CHARACTERS):
            sets = shingles.shingle_sets(texts)
            n = np.array([len(s) for s in sets], np.int64)
            names = [np.array([shingles.mixed(s ^ np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in (0x5851F42D, 0x14057B7E)]
            keys = band_keys(sketches(sets)).reshape(-1)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *map(pa.array, names), bands], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return _texts(documents).mapInArrow(task, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def full_sets(documents: DataFrame) -> DataFrame:
    """doc_id and its whole set of shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in words.batches_of(batches, BATCH_CHARACTERS):
            sets = shingles.shingle_sets(texts)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["doc_id", "shingles"])

    return _texts(documents).mapInArrow(task, "doc_id long, shingles array<long>")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _linked(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = runtime.written(ids, "ids")
    chosen = _texts(documents).join(runtime.joined_side(ids), "doc_id", "left_semi")
    sets = runtime.written(full_sets(chosen).dropDuplicates(["doc_id"]), "sets")
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    checked = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return checked.where(100 * F.col("both") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _unlinked(group: pa.Table) -> pa.Table:
    """Links found in one cell of a group: every class that asks with every class at home there, of different components.

    A pair is looked at in the first band that it shares only, and compared by sketch before it is by full sets.
    """
    of = {c: group.column(c).to_pylist() for c in ("band", "class", "component")}
    home, asks, other = (np.array(group.column(c).to_pylist(), bool) for c in ("home", "asks", "other"))
    band, name, component = of["band"][0], np.array(of["class"]), np.array(of["component"])
    sets = [x.values.to_numpy().view(np.uint64) for x in group.column("shingles")]
    size = np.array([len(x) for x in sets])
    sketch = sketches(sets)
    up = {c: c for c in of["component"]}

    def top(c: int) -> int:
        while up[c] != c:
            c = up[c]
        return c

    links = []
    for i in np.flatnonzero(asks).tolist():
        # two classes that both ask meet once, in the cell where the smaller asks
        met = home & (component != component[i]) & (~other | (name > name[i]))
        met &= PERCENT * np.maximum(size, size[i]) <= 100 * np.minimum(size, size[i])
        js = np.flatnonzero(met)
        same = sketch[js] == sketch[i]
        total = same.sum(axis=1)
        likely = total >= LIKELY
        js, total, same = js[likely], total[likely], same[likely]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        for j in js[first][np.argsort(-total[first], kind="stable")].tolist():
            a, b = top(of["component"][i]), top(of["component"][j])
            if a != b:
                where = np.searchsorted(sets[i], sets[j])
                where[where == len(sets[i])] = 0
                both = int((sets[i][where] == sets[j]).sum())
                if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                    up[a] = b
                    links.append((of["class"][i], of["class"][j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _rest(inside: DataFrame, classes: DataFrame, parts: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between classes that share a band but aren't in one component yet.

    Classes of a group's largest component never ask, so they are sent once for each block of the others: where nearly
    all of a large group is linked already, nothing is copied but the few that aren't. Homes and blocks are bounded, and
    a task holds one of each.
    """
    of = inside.join(parts, F.col("class") == F.col("node"), "left").select("band", "key", "class", F.coalesce("component", "class").alias("component"))
    of = runtime.written(of.join(classes.select("class", "n_shingles"), "class"), "placed")
    kinds = of.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "component", "m")).alias("top")).where("kinds > 1")
    bounded = lambda n, m: F.ceil(F.greatest(n / PART_ROWS, m / PART_SHINGLES)).cast("int")
    rest = bounded(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m"))
    groups = runtime.written(groups.select("key", "n", F.col("top.component").alias("top"), bounded(F.col("n"), F.col("m")).alias("homes"), rest.alias("blocks")), "open_groups")
    open_ = runtime.joined_unevenly(of, groups, ["key"], "n")
    home, block = (F.pmod(F.xxhash64("class", F.lit(k)), F.col(k)).cast("int").alias(k[:-1]) for k in ("homes", "blocks"))
    open_ = runtime.written(open_.select("band", "key", "class", "component", (F.col("component") != F.col("top")).alias("other"), "homes", "blocks", home, block), "open")
    ids = runtime.written(open_.select(F.col("class").alias("doc_id")).distinct(), "ids")
    sets = full_sets(_texts(documents).join(runtime.joined_side(ids), "doc_id", "left_semi")).dropDuplicates(["doc_id"])
    at_home = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.col("home").alias("p"), q.alias("q"), F.lit(True).alias("home"), (F.col("other") & (q == F.col("block"))).alias("asks")))
    away = F.filter(F.sequence(F.lit(0), F.col("homes") - 1), lambda p: F.col("other") & (p != F.col("home")))
    asking = F.transform(away, lambda p: F.struct(p.alias("p"), F.col("block").alias("q"), F.lit(False).alias("home"), F.lit(True).alias("asks")))
    rows = open_.join(sets, F.col("class") == F.col("doc_id"))
    rows = rows.select("band", "key", "class", "component", "other", "shingles", F.explode(F.concat(at_home, asking)).alias("cell"))
    rows = rows.select("band", "key", "class", "component", "other", "shingles", "cell.*")
    return rows.groupBy("key", "p", "q").applyInArrow(_unlinked, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text; other columns are ignored).

    Equal sets are one class, so copies never meet in pairs. In each group of a band, every class is checked against the
    group's smallest and largest class; then classes that share a band but are still in different components are
    compared in their group, in cells of bounded size where it is large, and only links leave them. Null and empty texts and those without words have no shingles and no links. Rows of one doc_id count
    as one document; a null doc_id is kept only if no document with an id has its set. An empty table gives an empty table.
    """
    signed = runtime.written(signatures(documents), "signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("x"))
    classes = runtime.written(classes.select("s1", "s2", "n_shingles", F.col("x.doc_id").alias("class"), F.col("x.bands").alias("bands")), "classes")
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "class")
    groups = banded.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).where("least <> most")
    inside = runtime.written(runtime.joined_unevenly(banded, runtime.written(groups, "bands"), ["key"], "n").drop("n"), "groups")
    stars = inside.select(F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("class").alias("b")), F.struct(F.col("class").alias("a"), F.col("most").alias("b")))).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    stars = runtime.written(stars, "stars")
    links = runtime.written(_linked(stars, documents), "links")
    rest = _rest(inside.select("band", "key", "class"), classes, graph.components(links), documents)
    links = links.unionByName(runtime.written(rest, "rest"))
    same = named.groupBy("doc_id").agg(F.min("s1").alias("l"), F.max("s1").alias("m")).where("l <> m").select("doc_id")
    versions = named.join(runtime.joined_side(runtime.written(same, "versions")), "doc_id").join(classes, ["s1", "s2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    parts = graph.components(links.unionByName(versions))
    named_classes = classes.select("s1", "s2", "n_shingles", "class").join(parts, F.col("class") == F.col("node"), "left").select("s1", "s2", "n_shingles", F.coalesce("component", "class").alias("component"))
    out = signed.join(named_classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(runtime.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
