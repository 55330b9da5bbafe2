"""Exact top-k inner products by dual-tree search over cover trees.

A cover tree over a bounded sample of the rows (SAMPLE_ROWS, those of smallest hash) deals all rows to its leaves; the
rows of a leaf, in blocks of bounded size, are indexed by cover trees of their own, and so are the queries. A node at
level l covers its points within 2^l of its centre, and its children are points more than 2^(l-1) apart that cover them
within 2^(l-1); where such a net has more than half of the node's points, dividing would save nothing and the node
stays a leaf. Radii are exact.

Blocks are paired by their balls alone: no inner product between two is above <q,d> + r_q |d| + r_d |q| + r_q r_d. Each
block of queries first meets the NEAREST blocks by inner product of centres, which gives a worst kth score; then only
blocks whose bound reaches it are joined with it at all. In a task both trees are walked together under the same bound, against the
worst kth score of the query node, and kth scores carry on from one block of data to the next.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

K, SCALE, QUERY_STEP = 5, 256, 50
BLOCK_ROWS, LEAF, SAMPLE_ROWS = 2048, 48, 4096
#: Blocks of data that a task holds at a time; a block of queries is sent to them once.
GROUP_BLOCKS = 8
#: Blocks that a block of queries meets before all others, for its first kth scores.
NEAREST = 4
_EXACT = float(1 << 52)


def _net(x: np.ndarray, centre: int, reach: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """Points more than ``reach`` apart, ``centre`` first, that cover all of ``x`` within it, and each point's nearest; None if there are more than ``most``."""
    chosen, nearest, square = [centre], np.zeros(len(x), np.int64), (x**2).sum(axis=1)
    to = np.maximum(square + square[centre] - 2 * (x @ x[centre]), 0)
    while len(chosen) <= most:
        far = int(to.argmax())
        if ((x[far] - x[chosen[nearest[far]]]) ** 2).sum() <= reach * reach:
            return chosen, nearest
        d = np.maximum(square + square[far] - 2 * (x @ x[far]), 0)
        closer = d < to
        closer[far] = True
        nearest[closer], to = len(chosen), np.where(closer, d, to)
        to[far] = 0
        chosen.append(far)
    return None


class Tree:
    """Points in the order of the tree; node i covers points first[i] .. last[i] within radius[i] <= 2**level[i] of its centre."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.first, self.last, self.radius, self.level, self.centre, self.children = [], [], [], [], [], []
        x = points.astype(float)
        order = np.arange(len(x))
        todo = [(0, len(x), 0, -1)] if len(x) else []
        while todo:
            # nodes are made before their children; ranges of ``order`` are sorted into children in place
            a, b, centre, parent = todo.pop()
            own = order[a:b].copy()
            d = np.sqrt(((x[own] - x[centre]) ** 2).sum(axis=1))
            node, radius = len(self.first), float(d.max())
            self.first.append(a)
            self.last.append(b)
            self.radius.append(radius)
            self.level.append(int(np.ceil(np.log2(radius))) if radius else -1075)
            self.centre.append(centre)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF or not radius:
                continue
            found = _net(x[own], int(np.flatnonzero(own == centre)[0]), 2.0 ** (self.level[node] - 1), (b - a) // 2)
            if not found:
                continue
            chosen, nearest = found
            by = np.argsort(nearest, kind="stable")
            order[a:b] = own[by]
            edges = np.searchsorted(nearest[by], np.arange(len(chosen) + 1)) + a
            todo += [(int(s), int(t), int(own[c]), node) for c, s, t in zip(chosen, edges[:-1], edges[1:], strict=True)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.points = ids[order], points[order]
        self.centre = place[np.array(self.centre, np.int64)] if len(x) else np.zeros(0, np.int64)

    def prepared(self) -> Tree:
        """With float copies for the walk."""
        if not hasattr(self, "x"):
            self.x = self.points.astype(float)
            self.r = np.array(self.radius)
            self.norm = np.sqrt((self.x[self.centre] ** 2).sum(axis=1)) if len(self.ids) else np.zeros(0)
        return self

    def dumped(self) -> bytes:
        out = io.BytesIO()
        kids = np.array([len(c) for c in self.children], np.int64)
        flat = np.array([k for c in self.children for k in c], np.int64)
        np.savez(out, ids=self.ids, points=self.points, first=np.array(self.first, np.int64), last=np.array(self.last, np.int64), radius=np.array(self.radius), centre=self.centre, kids=kids, flat=flat)
        return out.getvalue()

    @classmethod
    def loaded(cls, raw: bytes) -> Tree:
        got, t = np.load(io.BytesIO(raw)), cls.__new__(cls)
        t.ids, t.points, t.centre = got["ids"], got["points"], got["centre"]
        t.first, t.last, t.radius = got["first"].tolist(), got["last"].tolist(), got["radius"].tolist()
        ends = np.cumsum(got["kids"])
        t.children = [got["flat"][e - n : e].tolist() for e, n in zip(ends.tolist(), got["kids"].tolist(), strict=True)]
        return t


class Best:
    """The k best (score, smaller id) of each query of a tree so far, of scores of ``floor`` or more."""

    def __init__(self, tree: Tree, k: int, floor: float = -np.inf):
        self.tree, self.k = tree.prepared(), k
        self.kth = np.full(len(tree.ids), floor)
        self.lists: list[list[tuple[int, int]]] = [[] for _ in tree.ids]

    def offer(self, i: int, score: int, vec_id: int) -> None:
        own, new = self.lists[i], (-score, vec_id)
        if new in own:
            return
        if len(own) == self.k and new > own[-1]:
            return
        own.append(new)
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.kth[i] = max(self.kth[i], -own[-1][0])


def search(best: Best, data: Tree) -> int:
    """Walks both trees, fills ``best``; returns the number of pairs of points compared."""
    q, d = best.tree, data.prepared()
    if not len(q.ids) or not len(d.ids):
        return 0
    largest = (np.abs(q.x).max(initial=0) + 1) * (np.abs(d.x).max(initial=0) + 1) * max(1, q.x.shape[1])
    exact = largest < _EXACT
    slack, compared = largest * 1e-12, 0

    def bounds(i: list[int], j: list[int]) -> np.ndarray:
        r, s = q.r[i][:, None], d.r[j]
        return q.x[q.centre[i]] @ d.x[d.centre[j]].T + r * d.norm[j] + s * q.norm[i][:, None] + r * s + slack

    todo = [(float(bounds([0], [0])[0, 0]), 0, 0)]
    while todo:
        most, i, j = todo.pop()
        a, b = q.first[i], q.last[i]
        worst = best.kth[a:b].min()
        if most < worst:
            continue
        split_q, split_d = q.children[i], d.children[j]
        if not split_q and not split_d:
            s, t = d.first[j], d.last[j]
            compared += (b - a) * (t - s)
            scores = q.x[a:b] @ d.x[s:t].T if exact else _whole(q.points[a:b], d.points[s:t])
            good = (scores >= best.kth[a:b, None]) & (q.ids[a:b, None] != d.ids[None, s:t])
            rows, cols = np.nonzero(good)
            for x in np.argsort(-scores[rows, cols].astype(float), kind="stable").tolist():
                r, c = int(rows[x]), int(cols[x])
                if scores[r, c] >= best.kth[a + r]:
                    best.offer(a + r, int(scores[r, c]), int(d.ids[s + c]))
            continue
        if split_q and (not split_d or q.radius[i] > d.radius[j]):
            pairs = zip(bounds(split_q, [j])[:, 0].tolist(), split_q, [j] * len(split_q), strict=True)
        else:
            pairs = zip(bounds([i], split_d)[0].tolist(), [i] * len(split_d), split_d, strict=True)
        todo += sorted(p for p in pairs if p[0] >= worst)
    return compared


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in unbounded integers, held to the range of a long."""
    out = a.astype(object) @ b.astype(object).T
    return np.clip(out, -(1 << 63), (1 << 63) - 1)


def _leaves(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """By length of vector, the centres of the leaves of a cover tree over the sample."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(rows).collect()  # a bounded number of rows
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for width, points in by.items():
        t = Tree(np.arange(len(points)), np.array(points, float).reshape(len(points), width))
        out[width] = t.points[t.centre[[i for i, c in enumerate(t.children) if not c]]].astype(float)
    return out


def _blocks(vectors: DataFrame, leaves: dict[int, np.ndarray], rows: int) -> DataFrame:
    """width, leaf, part, n, centre, radius, tree of the rows of each leaf, in parts of about ``rows``; written."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_pylist()
            leaf = np.zeros(len(own), np.int32)
            for width in {len(v) for v in own} & set(leaves):
                at = [i for i, v in enumerate(own) if len(v) == width]
                x = np.array([own[i] for i in at], float).reshape(len(at), width)
                c = leaves[width]
                leaf[at] = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "v", "leaf"])

    dealt = runtime.written(vectors.select("vec_id", "v").mapInArrow(deal, "vec_id long, v array<long>, leaf int").withColumn("width", F.size("v")), "dealt")
    sizes = dealt.groupBy("width", "leaf").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    parted = dealt.join(runtime.joined_side(runtime.written(sizes, "sizes")), ["width", "leaf"])
    parted = parted.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))

    def plant(group: pa.Table) -> pa.Table:
        width, leaf, part = (group.column(c)[0].as_py() for c in ("width", "leaf", "part"))
        ids, points = group.column("vec_id").to_pylist(), group.column("v").to_pylist()
        x = np.array(points, np.int64).reshape(len(points), width)
        keep = np.unique(np.column_stack([np.array(ids, np.int64)[:, None], x]), axis=0)
        ids_, x = keep[:, 0].copy(), keep[:, 1:]
        kind = np.int16 if np.abs(x.astype(float)).max(initial=0) < 1 << 15 else np.int64
        t = Tree(ids_, x.astype(kind))
        centre = t.points[t.centre[0]].astype(float).tolist()
        row = {"width": width, "leaf": leaf, "part": part, "n": len(np.unique(ids_)), "centre": centre, "radius": t.radius[0], "tree": t.dumped()}
        return pa.Table.from_pylist([row], pa.schema([("width", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())]))

    planted = parted.groupBy("width", "leaf", "part").applyInArrow(plant, "width int, leaf int, part int, n int, centre array<double>, radius double, tree binary")
    return runtime.written(planted, "blocks")


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of every vector that is whole and finite; components beyond +-2**62 count as +-2**62."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(1 << 62)
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(limit)), F.lit(-limit))), F.lit(1 << 62)), F.lit(-(1 << 62))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", v.alias("v"))


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def pairs_of_blocks(asked: DataFrame, data: DataFrame) -> DataFrame:
    """q_leaf, q_part, width, leaf, part, inner (of the centres), bound of every block of queries with every block of data of its width.

    Blocks alone, without their rows: one pair for some BLOCK_ROWS queries and as many rows.
    """
    q = asked.select(F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), "width", F.col("centre").alias("q"), F.col("radius").alias("q_r"), _norm("centre").alias("q_norm"))
    d = data.select("width", "leaf", "part", F.col("centre").alias("d"), F.col("radius").alias("d_r"), _norm("centre").alias("d_norm"))
    inner = F.aggregate(F.zip_with("q", "d", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    size = (F.col("q_norm") + F.col("q_r")) * (F.col("d_norm") + F.col("d_r"))
    bound = F.col("inner") + F.col("q_r") * F.col("d_norm") + F.col("d_r") * F.col("q_norm") + F.col("q_r") * F.col("d_r") + size * 1e-9 + 1
    return q.join(d, "width").withColumn("inner", inner).withColumn("bound", bound).select("q_leaf", "q_part", "width", "leaf", "part", "inner", "bound")


def _hits(pairs: DataFrame, asked: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """width, q_leaf, q_part, query_id, vec_id, score: the k best of each query in each group of blocks it is paired with (floor: the least score of use)."""
    group = F.floor(F.col("part") / GROUP_BLOCKS).cast("int").alias("g")
    meets = pairs.select("width", "leaf", group, "q_leaf", "q_part", "floor").distinct()
    q = asked.select("width", F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), "tree")
    q = meets.join(q, ["width", "q_leaf", "q_part"]).select("width", "leaf", "g", "q_leaf", "q_part", "floor", "tree")
    d = data.select("width", "leaf", group, F.lit(None).cast("int").alias("q_leaf"), F.col("part").alias("q_part"), F.lit(None).cast("double").alias("floor"), "tree")
    d = d.join(meets.select("width", "leaf", "g").distinct(), ["width", "leaf", "g"], "left_semi")
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.unionByName(q).repartition(parts, "width", "leaf", "g").sortWithinPartitions("width", "leaf", "g", F.asc_nulls_first("q_leaf"), "q_part")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                width, leaf, g, q_leaf, q_part, floor, tree = (c[i].as_py() for c in b.columns)
                if at != (width, leaf, g):
                    at, held = (width, leaf, g), []
                if q_leaf is None:
                    held.append(Tree.loaded(tree))
                    continue
                best = Best(Tree.loaded(tree), k, floor)
                for t in held:
                    search(best, t)
                out = [(width, q_leaf, q_part, int(n), i, -s) for n, own in zip(best.tree.ids, best.lists, strict=True) for s, i in own]
                cols = list(zip(*out, strict=True)) or [()] * 6
                types = [pa.int32()] * 3 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["width", "q_leaf", "q_part", "query_id", "vec_id", "score"])

    return rows.mapInArrow(task, "width int, q_leaf int, q_part int, query_id long, vec_id long, score long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with rows of ``vectors`` of other ids.

    Both are (vec_id, v: array<long>). Ties go to the smaller vec_id. Equal rows count once; rows of one vec_id with
    other vectors are candidates, and queries, each by itself, under the one id, and never meet queries of their id.
    Vectors of different lengths don't meet. Queries with nothing to meet have no rows. Scores beyond a long count as the
    largest or smallest long.
    """
    leaves = _leaves(vectors, SAMPLE_ROWS)
    data, asked = _blocks(vectors, leaves, rows), _blocks(queries, leaves, rows)
    by = ["width", "q_leaf", "q_part"]
    pairs = runtime.written(pairs_of_blocks(asked, data), "pairs")
    order = Window.partitionBy(*by).orderBy(F.desc("inner"), "leaf", "part")
    nearest = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEAREST).select(*by, "leaf", "part", F.lit(float("-inf")).alias("floor"))
    first = runtime.written(_hits(nearest, asked, data, k), "first")
    scores = F.sort_array(F.collect_list("score"), asc=False)  # NEAREST * k at most
    kth = first.groupBy(*by, "query_id").agg(F.get(scores, F.lit(k - 1)).alias("kth")).where("kth IS NOT NULL")
    kth = kth.groupBy(*by).agg(F.count("*").alias("full"), F.min("kth").alias("kth"))
    of = asked.select("width", F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), "n").join(kth, by, "left")
    of = runtime.written(of.select(*by, F.when(F.col("full") == F.col("n"), F.col("kth").cast("double")).otherwise(float("-inf")).alias("floor")), "floors")
    met = nearest.select(*by, "leaf", F.floor(F.col("part") / GROUP_BLOCKS).cast("int").alias("g"))
    open_ = pairs.join(of, by).where(F.col("bound") >= F.col("floor")).withColumn("g", F.floor(F.col("part") / GROUP_BLOCKS).cast("int"))
    rest = _hits(open_.join(met, [*by, "leaf", "g"], "left_anti").drop("g"), asked, data, k)
    hits = first.unionByName(rest).select("query_id", "vec_id", "score").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(runtime.table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % QUERY_STEP == 0), vectors)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
