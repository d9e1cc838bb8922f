"""Operator 10: nearest neighbours by inner product with one vantage-point tree per shard.

Largest inner product becomes nearest point: a vector x with squared norm n is lifted to
(x, sqrt(M - n)), where M is the largest squared norm, and a query q to (q, 0), so that
|q' - x'|**2 = |q|**2 + M - 2 q.x.

Shards are dealt by space: rows are sorted by their nearest pivot and the distance to it (pivots: far apart
among at most ``SAMPLE`` lifted rows) and cut into shards of bounded size, so that a hot region is many shards.  A shard
keeps the range of its rows' distances to every pivot, which bounds a query's distance to it.  Its tree splits at
the median distance from a vantage point; a subtree, or a whole shard, is left out when its triangle-inequality
bound, times ``relax``, exceeds the query's k-th best distance.  ``relax`` = 1 is exact; above 1 the search is faster and
may miss neighbours.

A query searches its own shard first; the k-th best found there decides which other shards it visits.  In both steps a row is
shuffled once, a tree is built once per shard, and the queries stream past.  Scores are double-precision sums of products
in index order, so equal vectors have equal scores, and ties go to the smaller id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors as vec

PIVOTS, SAMPLE, LEAF = 16, 2048, 128
#: A shard holds at most about so many bytes of rows; small tables are cut finer, into up to ``SPREAD`` shards of ``LEAST`` rows.
SHARD_BYTES, SPREAD, LEAST = 64 << 20, 64, 4096
#: Queries that search a tree together.
QUERY_BLOCK = 2048


class Tree:
    """A vantage-point tree over lifted vectors; ``slack`` covers rounding in distances."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, largest: float, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids, self.largest = x[order], ids[order], largest
        self.rows = self.ids if rows is None else rows[order]
        self.lift = np.sqrt(np.maximum(0.0, largest - np.einsum("nd,nd->n", self.x, self.x)))
        self.slack = 1e-7 * (1.0 + np.sqrt(largest))
        self.root = self.build(np.arange(len(ids)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        v = rows[0]
        d = np.sqrt(np.maximum(0.0, np.square(self.x[rows] - self.x[v]).sum(axis=1) + np.square(self.lift[rows] - self.lift[v])))
        inner = d <= np.median(d)
        if inner.all():  # more than half lie equally far away; split them off by the nearest
            inner = d < d.max()
            if not inner.any():
                return rows  # all at one point
        sides = []
        for part in (inner, ~inner):
            sides.append((d[part].min(), d[part].max(), self.build(rows[part])))
        return v, sides

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (best first; missing: -inf) of the k best rows per query, leaving out its ``own`` row.
        Rows that score below ``reach`` need not be found."""
        best = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        reach = np.full(len(q), -np.inf) if reach is None else reach
        norm = np.square(q).sum(axis=1)

        def leaf(rows, at):
            s = np.einsum("qd,nd->qn", q[at], self.x[rows])
            s[own[at][:, None] == self.rows[rows][None, :]] = -np.inf
            some = np.flatnonzero(s.max(axis=1) >= np.maximum(best[0][at, -1], reach[at]))
            if not len(some):
                return
            at, s = at[some], s[some]
            score = np.concatenate([best[0][at], s], axis=1)
            ids = np.concatenate([best[1][at], np.broadcast_to(self.ids[rows], s.shape)], axis=1)
            ids[np.isneginf(score)] = np.iinfo(np.int64).max
            order = np.lexsort((ids, -score), axis=1)[:, :k]
            best[0][at], best[1][at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

        def visit(node, at):
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                return leaf(node, at)
            v, sides = node
            d = np.sqrt(np.maximum(0.0, norm[at] + self.largest - 2 * np.einsum("qd,d->q", q[at], self.x[v])))
            bounds = [np.maximum(0.0, np.maximum(lo - d, d - hi)) for lo, hi, _ in sides]
            near = bounds[0] <= bounds[1]
            for first in (True, False):  # each query enters its nearer side first
                for side, mine in ((0, near == first), (1, near != first)):
                    some = np.flatnonzero(mine)
                    kth = np.sqrt(np.maximum(0.0, norm[at[some]] + self.largest - 2 * np.maximum(best[0][at[some], -1], reach[at[some]])))
                    visit(sides[side][2], at[some[bounds[side][some] * relax <= kth + self.slack]])

        visit(self.root, np.arange(len(q)))
        return best[1], best[0]


def _search(largest: float, k: int, relax: float):
    """Queries (row, id, v, reach) -> the k best rows of the shard, without the query's own."""
    def search(points: pa.Table):
        tree = Tree(vec.matrix(points["v"]), points["id"].to_numpy(), largest, points["row"].to_numpy())

        def find(queries: pa.Table) -> pa.RecordBatch:
            q, own = vec.matrix(queries["v"]), queries["row"].to_numpy()
            reach = np.array([-np.inf if r is None else r for r in queries["reach"].to_pylist()])
            parts = [tree.search(q[s : s + QUERY_BLOCK], own[s : s + QUERY_BLOCK], k, relax, reach[s : s + QUERY_BLOCK]) for s in range(0, len(q), QUERY_BLOCK)]
            ids, scores = (np.concatenate(p) for p in zip(*parts))
            good = np.isfinite(scores) & (scores >= reach[:, None])
            ends = pa.array(np.r_[0, np.cumsum(good.sum(axis=1))], pa.int32())
            return pa.RecordBatch.from_arrays([queries["row"].combine_chunks(), queries["id"].combine_chunks(), pa.ListArray.from_arrays(ends, pa.array(ids[good])),
                                               pa.ListArray.from_arrays(ends, pa.array(scores[good]))], names=["row", "query_id", "ids", "scores"])
        return find
    return search


def _distances(x: np.ndarray, largest: float, pivots: np.ndarray, lifts: np.ndarray, lifted: bool) -> np.ndarray:
    """Distances of rows (lifted) or of queries to the lifted pivots."""
    square = np.square(x).sum(axis=1)
    up = np.sqrt(np.maximum(0.0, largest - square)) if lifted else np.zeros(len(x))
    full = square + np.square(up)
    return np.sqrt(np.maximum(0.0, full[:, None] + (np.square(pivots).sum(axis=1) + np.square(lifts))[None, :] - 2 * (x @ pivots.T + up[:, None] * lifts[None, :])))


def _placed(largest: float, pivots: np.ndarray, lifts: np.ndarray):
    """Rows (row, id, v) with their distances to the pivots and their place in the sort order."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                d = _distances(vec.matrix(batch.column("v")), largest, pivots, lifts, True)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "id", "v")), pa.array(list(d), pa.list_(pa.float64())), pa.array(cell, pa.int32()),
                     pa.array(d[np.arange(len(d)), cell])], names=["row", "id", "v", "far", "cell", "near"])
    return run


def _route(boxes: tuple, largest: float, pivots: np.ndarray, lifts: np.ndarray, relax: float):
    """Queries (row, id, v, home, reach) -> a row for each other shard whose bound does not exceed the k-th best distance."""
    shards, low, high = boxes
    slack = 1e-7 * (1.0 + np.sqrt(largest))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                q = vec.matrix(batch.column("v"))
                reach = np.array([-np.inf if r is None else r for r in batch.column("reach").to_pylist()])
                kth = np.sqrt(np.maximum(0.0, np.square(q).sum(axis=1) + largest - 2 * reach))
                d, bound = _distances(q, largest, pivots, lifts, False), np.zeros((len(q), len(shards)))
                for p in range(len(pivots)):
                    np.maximum(bound, np.maximum(low[None, :, p] - d[:, p, None], d[:, p, None] - high[None, :, p]), out=bound)
                at, to = np.nonzero((bound * relax <= kth[:, None] + slack) & (batch.column("home").to_numpy()[:, None] != shards[None, :]))
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(shards[to], pa.int32()), *(out.column(c) for c in ("row", "id", "v", "reach"))],
                                                 names=["shard", "row", "id", "v", "reach"])
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, relax: float = 1.0, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products of each query over all rows but its own.

    Queries are the usable rows that satisfy ``is_query`` (a condition on ``id``).  Rows that repeat an id are rows
    of their own: each is a candidate of the others, and each query row gives its own ranks.  Null, empty and zero vectors, those
    with null or non-finite parts, rows with a null id and vectors that have not the commonest length take no part.
    With fewer than k candidates all are returned; without any the query has no row."""
    named = vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.exists(F.col(f"`{vector_col}`"), lambda e: e != 0))
    x, n, dim = vec.usable(named, "vp-vectors", id=id_col, v=vector_col)
    if n == 0:
        return x.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    largest = x.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()[0] or 0.0
    sample = np.array([r["v"] for r in common.hash_sample(x, "row", SAMPLE, n).orderBy("row").select("v").collect()], dtype=np.float64).reshape(-1, dim)
    sample = sample if len(sample) else np.zeros((1, dim))
    lifts, picked = np.sqrt(np.maximum(0.0, largest - np.square(sample).sum(axis=1))), [0]
    near = _distances(sample, largest, sample[:1], lifts[:1], True)[:, 0]
    while len(picked) < min(PIVOTS, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, largest, sample[picked[-1:]], lifts[picked[-1:]], True)[:, 0])
    pivots, lifts = sample[picked], lifts[picked]
    shards = max(1, min(SPREAD, -(-n // LEAST)), -(-n * 8 * (dim + 2) // shard_bytes))
    rows = x.mapInArrow(_placed(largest, pivots, lifts), "row long, id long, v array<double>, far array<double>, cell int, near double")
    rows = common.materialize(rows.repartitionByRange(shards, "cell", "near", "row").withColumn("shard", F.spark_partition_id()).drop("cell", "near"), "vp-shards")
    far = lambda p: F.get("far", F.lit(p))
    got = rows.groupBy("shard").agg(*[F.min(far(p)).alias(f"l{p}") for p in range(len(pivots))], *[F.max(far(p)).alias(f"h{p}") for p in range(len(pivots))]).collect()
    boxes = (np.array([g["shard"] for g in got], dtype=np.int64), *(np.array([[g[f"{c}{p}"] for p in range(len(pivots))] for g in got]).reshape(len(got), -1) for c in "lh"))

    points, schema = rows.select("shard", "row", "id", "v"), "row long, query_id long, ids array<long>, scores array<double>"
    queries = rows.filter(is_query).select(F.col("shard").alias("home"), "row", "id", "v")
    first = queries.select(F.col("home").alias("shard"), "row", "id", "v", F.lit(None).cast("double").alias("reach"))
    own = common.materialize(vec.visit(points, first, _search(largest, k, relax), schema), "vp-own")
    asked = queries.join(own.select("row", F.when(F.size("scores") == k, F.element_at("scores", -1)).alias("reach")), "row", "left")
    routed = asked.mapInArrow(_route(boxes, largest, pivots, lifts, relax), "shard int, row long, id long, v array<double>, reach double")
    found = own.unionByName(vec.visit(points, routed, _search(largest, k, relax), schema))
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("far"), p["ids"].alias("id")))
    best = found.groupBy("row", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.far")).alias("score"))
