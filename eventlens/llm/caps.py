"""Operator 13: near-duplicate vectors by spherical-cap filters from a structured random product code.

Filters.  A vector is turned by a random rotation (random signs and Walsh-Hadamard transforms, twice) and cut in two
halves.  Each half has its own random unit directions; every pair of them is a filter direction, so W + W directions make W * W
filters.  A vector belongs to every filter whose direction exceeds its cap, and its cap is the highest that k
directions exceed.  (One cap for all gives a vector between none and some hundreds of filters; to lose as few pairs,
four times as many are then needed on average.)  List-decoding finds them without trying all: the k best pairs of the two
halves' sorted products lie where (rank + 1) * (rank + 1) <= k.

k follows from the recall: since the rotation is random, two vectors at the threshold are as good as a random pair at this
angle, and k is what all but ``MISS`` of ``TRIALS`` random pairs at the threshold need to share a filter.
Pairs that are closer are missed less often.  W grows with the root of the number of vectors, so that a filter has about
``BUCKET`` members at every size.

Verification.  Members of a filter are compared by cosine inside a task.  A pair counts in the smallest filter that both belong
to.  Only sums per member and, of the links, a forest leave the task: fewer rows than members.

Groups of copies.  Equal vectors are one vector with a weight.  Near copies form balls: of the leaders that its filters' first
halves propose (the members with the smallest hashes), a vector joins the first one within half the threshold's angle.
By the triangle inequality all members of a ball are linked, so they are counted by the ball's weight and never
compared.  A filter with many members is cut into blocks which meet pairwise; blocks of one large ball do not meet.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors as vec

COSINE = 0.9
MISS, TRIALS = 0.002, 6000
#: Filters that a calibration tries at most; members of an average filter; directions of a half at least and at most (the code has to fit a task).
DEPTH, BUCKET, WORDS_LEAST, WORDS_MOST = 256, 128, 8, 8192
#: Members of one block of a filter on average, and a filter half's leaders.
BLOCK, LEADERS = 1024, 4
SEED = 20_131


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(axis=1, keepdims=True))


class Code:
    """The product code for vectors of ``dim`` components with ``words`` directions a half, made from a fixed seed."""

    def __init__(self, dim: int, words: int, cosine: float = COSINE):
        rng = np.random.default_rng(SEED)
        self.width = 16  # halves of a few components at least
        while self.width < dim:
            self.width *= 2
        self.words = words
        self.signs = rng.choice([-1.0, 1.0], size=(2, self.width))
        half = rng.standard_normal((2, words, self.width // 2))
        self.half = half / np.linalg.norm(half, axis=2, keepdims=True) / np.sqrt(2.0)
        self.k = min(DEPTH, words * words)
        self.k = self.calibrated(rng, dim, cosine)

    def products(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of unit vectors, turned, with the directions of either half."""
        x = np.zeros((len(u), self.width))
        x[:, : u.shape[1]] = u
        for signs in self.signs:
            x = x * signs
            step = 1
            while step < self.width:
                y = x.reshape(len(x), -1, 2, step)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), -1)
                step *= 2
            x = x / np.sqrt(self.width)
        return x[:, : self.width // 2] @ self.half[0].T, x[:, self.width // 2:] @ self.half[1].T

    def calibrated(self, rng, dim: int, cosine: float) -> int:
        """The least number of filters with which all but ``MISS`` of random pairs at the threshold share one."""
        x = unit(rng.standard_normal((TRIALS, dim)))
        y = x
        if dim > 1:
            y = rng.standard_normal((TRIALS, dim))
            y = cosine * x + np.sqrt(1.0 - cosine ** 2) * unit(y - np.einsum("nd,nd->n", x, y)[:, None] * x)
        need = []
        for p, q in zip(self.decode(x).tolist(), self.decode(y).tolist()):
            rank = {f: r for r, f in enumerate(p)}
            need.append(min((max(rank[f], r) + 1 for r, f in enumerate(q) if f in rank), default=self.k))
        return sorted(need)[-1 - int(MISS * TRIALS)]

    def decode(self, u: np.ndarray) -> np.ndarray:
        """Of every unit vector its k filters (first * words + second), the best first."""
        few = min(self.k, self.words)
        places, sorted_ = [], []
        for x in self.products(u):
            best = np.argpartition(-x, few - 1, axis=1)[:, :few]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(x, best, 1), axis=1, kind="stable"), 1)
            places.append(best), sorted_.append(np.take_along_axis(x, best, 1))
        p, q = np.nonzero(np.outer(np.arange(1, few + 1), np.arange(1, few + 1)) <= self.k)
        total = sorted_[0][:, p] + sorted_[1][:, q]
        top = np.argsort(-total, axis=1, kind="stable")[:, : self.k]
        return places[0][np.arange(len(u))[:, None], p[top]] * self.words + places[1][np.arange(len(u))[:, None], q[top]]


def directions_for(n: int) -> int:
    """Directions of a half for n vectors, of which each has some 16 filters."""
    return int(min(WORDS_MOST, max(WORDS_LEAST, np.ceil(np.sqrt(16.0 * n / BUCKET)))))


def _keyed(kind: str):
    """Rows (row, id, v) -> the same with the vector packed (0.0 and -0.0 alike) and a key of it."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = [x.tobytes() for x in (vec.matrix(batch.column("v")) + 0.0).astype(kind)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in packed], pa.binary()),
                                              pa.array(packed, pa.binary())], names=["row", "id", "key", "v"])
    return run


def unpack(column, kind: str) -> np.ndarray:
    """Packed vectors as unit vectors in double precision."""
    rows = column.to_pylist()
    return unit(np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64))


def _decoded(code: Code, kind: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            filters = np.sort(code.decode(unpack(batch.column("v"), kind)), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "weight", "v")), pa.array(list(filters), pa.list_(pa.int32())),
                 pa.array([np.unique(f) for f in filters // code.words], pa.list_(pa.int32()))], names=["rep", "weight", "v", "filters", "firsts"])
    return run


def _balled(leaders: dict[int, list[int]], reps: np.ndarray, u: np.ndarray, cosine: float, kind: str):
    """Adds the ball: the first of the proposed leaders within half the angle, or the vector itself.

    ``leaders``: a filter half's leaders as places in ``reps`` and ``u``, which are sorted by their hash."""
    near = np.cos(np.arccos(cosine) / 2 - 1e-6)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            own, mine = unpack(batch.column("v"), kind), batch.column("rep").to_numpy()
            ball = mine.copy()
            for k, firsts in enumerate(batch.column("firsts").to_pylist()):
                tried = sorted({at for i in firsts for at in leaders.get(i, ())})
                if tried:
                    close = np.flatnonzero(u[tried] @ own[k] >= near)
                    if len(close):
                        ball[k] = reps[tried[close[0]]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "v", "filters")), pa.array(ball)],
                                             names=["rep", "weight", "v", "filters", "ball"])
    return run


def _compared(cosine: float, kind: str):
    """Groups (filter, p, q) of rows (block, rep, weight, ball, v, smaller: its filters below this one) -> of members of block p and of block q in different
    balls, the links that belong to this filter: (rep, null, weight of its partners) and a forest (ball, ball, null)."""
    def group(rows: pa.Table) -> pa.RecordBatch:
        block, rep, weight, ball = (rows[c].to_numpy() for c in ("block", "rep", "weight", "ball"))
        p, q = (rows[c][0].as_py() for c in ("p", "q"))
        u = unpack(rows["v"], kind)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        linked = (u[left] @ u[right].T >= cosine) & (ball[left][:, None] != ball[right][None, :])
        a, b = np.nonzero(np.triu(linked, 1) if p == q else linked)
        a, b = left[a], right[b]
        some = np.union1d(a, b)
        smaller = dict(zip(some.tolist(), map(frozenset, rows["smaller"].take(pa.array(some)).to_pylist())))
        first = np.fromiter((smaller[x].isdisjoint(smaller[y]) for x, y in zip(a.tolist(), b.tolist())), dtype=bool, count=len(a))
        links = np.zeros(len(rep), dtype=np.int64)
        np.add.at(links, a[first], weight[b[first]])
        np.add.at(links, b[first], weight[a[first]])
        some = np.flatnonzero(links)
        nodes, at = np.unique(ball, return_inverse=True)
        least = np.arange(len(nodes))
        while True:  # every node takes its neighbours' least until nothing changes
            low = np.minimum(least[at[a]], least[at[b]])
            now = least.copy()
            np.minimum.at(now, at[a], low)
            np.minimum.at(now, at[b], low)
            now = now[now]
            if (now == least).all():
                break
            least = now
        hung = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[rep[some], nodes[hung]], pa.int64()), pa.array([None] * len(some) + nodes[least[hung]].tolist(), pa.int64()),
             pa.array(links[some].tolist() + [None] * len(hung), pa.int64())], names=["a", "b", "links"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("filter", "p", "q")], axis=1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if last is not None and last != tuple(keys[s]):
                    yield group(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield group(pa.Table.from_batches(held))
    return run


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Memberships (filter, p, q, block, ...): each member once for each pair of blocks of its filter that has to meet.

    A filter's blocks are those of its ordinary members, then those of each large ball in it.  All blocks meet each other
    but those of one large ball; an ordinary block also meets itself."""
    large = members.groupBy("ball").agg(F.count("*").alias("n")).filter(F.col("n") > block // 2).select("ball", F.lit(True).alias("large"))
    marked = members.join(large, "ball", "left").withColumn("of", F.when(F.col("large"), F.col("ball"))).withColumn("filter", F.explode("filters"))
    sizes = marked.groupBy("filter", "of").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    plan = sizes.groupBy("filter").agg(
        F.coalesce(F.sum(F.when(F.col("of").isNull(), F.col("n"))), F.lit(0)).cast("int").alias("light"),
        F.sum("n").cast("int").alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("of", "n")))).alias("balls"))
    # only filters of more than one block need a plan: at most one in ``block`` memberships
    x = marked.join(plan.filter("all > 1"), "filter", "left")
    one = F.col("all").isNull() | F.col("of").isNull()
    x = x.withColumn("begin", F.when(one, 0).otherwise(F.col("light") + F.aggregate(
        F.filter("balls", lambda b: b["of"] < F.col("of")), F.lit(0), lambda s, b: s + b["n"])))
    x = x.withColumn("own", F.when(one, F.coalesce("light", F.lit(1))).otherwise(F.element_at(F.filter("balls", lambda b: b["of"] == F.col("of")), 1)["n"]))
    x = x.withColumn("block", (F.col("begin") + F.pmod(F.xxhash64("rep"), F.col("own"))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("all", F.lit(1)) - 1)
    others = F.filter(every, lambda b: one | (b < F.col("begin")) | (b >= F.col("begin") + F.col("own")))
    return (x.withColumn("other", F.explode(others))
            .select("filter", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "weight", "ball", "v",
                    F.filter("filters", lambda f: f < F.col("filter")).alias("smaller")))


def components(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows linked directly (cosine >= ``cosine`` in double precision; between vectors of different
    value those found by the filters), ``component_id`` is the smallest id reachable over links, its own included, and
    ``kept`` says id = component_id.  Vectors that are null, empty, zero, or hold null or non-finite components, and those that
    have not the commonest length, are linked with nothing.  Rows that repeat an id are rows of their own: each has its own
    links and component.  A row with a null id takes part in links; its component is the smallest id reachable, or null,
    and it is kept if that is null.  An empty table gives an empty result."""
    fit = vec.finite(F.col("v")) & F.exists("v", lambda e: e != 0)
    raw = common.columns(vectors, id=id_col, v=vector_col)
    kind = "f4" if raw.schema["v"].dataType.simpleString() == "array<float>" else "f8"  # packed as they came
    raw = raw.withColumn("v", F.col("v").cast("array<double>"))
    x, n, dim = vec.usable(raw.filter(fit), "caps-vectors", id="id", v="v")
    rest = raw.filter(~F.coalesce(fit, F.lit(False)) | (F.size("v") != dim)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = rest if n == 0 else _linked(x, n, dim, cosine, block, kind).unionByName(rest)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"))


def _linked(x: DataFrame, n: int, dim: int, cosine: float, block: int, kind: str) -> DataFrame:
    code = Code(dim, directions_for(n), cosine)
    rows = common.materialize(x.mapInArrow(_keyed(kind), "row long, id long, key binary, v binary"), "caps-rows")
    reps = rows.groupBy("key").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"), F.count("*").alias("weight"), F.min("v").alias("v"))
    reps = common.materialize(reps, "caps-reps")
    decoded = common.materialize(reps.select("rep", "weight", "v").mapInArrow(
        _decoded(code, kind), "rep long, weight long, v binary, filters array<int>, firsts array<int>"), "caps-decoded")

    drawn = F.xxhash64("rep", F.lit(SEED))
    proposed = (decoded.select(F.explode("firsts").alias("first"), F.struct(drawn.alias("drawn"), "rep").alias("by"))
                .groupBy("first").agg(F.min("by").alias("by0")))
    for k in range(1, LEADERS):  # the next smallest hash of each half, a partial aggregation each
        more = (decoded.select(F.explode("firsts").alias("first"), F.struct(drawn.alias("drawn"), "rep").alias("by")).join(proposed, "first")
                .filter(F.col("by") > F.col(f"by{k - 1}")).groupBy("first").agg(F.min("by").alias(f"by{k}")))
        proposed = proposed.join(more, "first", "left")
    leaders = (proposed.select("first", F.explode(F.array(*[f"by{k}" for k in range(LEADERS)])).alias("by")).filter("by is not null")
               .join(decoded.select(F.col("rep").alias("leader"), "v"), F.col("by.rep") == F.col("leader")).select("first", "by.drawn", "leader", "v").collect())
    order = sorted({(r["drawn"], r["leader"]): r["v"] for r in leaders}.items())  # at most LEADERS * WORDS_MOST vectors
    place = {leader: k for k, ((_, leader), _) in enumerate(order)}
    by_first: dict[int, list[int]] = {}
    for r in leaders:
        by_first.setdefault(r["first"], []).append(place[r["leader"]])
    directions = unpack(pa.array([bytes(v) for _, v in order], pa.binary()), kind)
    members = common.materialize(decoded.mapInArrow(_balled(by_first, np.array([k[1] for k, _ in order], dtype=np.int64), directions, cosine, kind),
                                                    "rep long, weight long, v binary, filters array<int>, ball long"), "caps-members")

    found = common.materialize(_blocks(members, block).repartition("filter", "p", "q").sortWithinPartitions("filter", "p", "q")
                               .mapInArrow(_compared(cosine, kind), "a long, b long, links long"), "caps-links")
    joined = common.connected_components(found.filter("b is not null").select("a", "b"))
    sums = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    balls = members.groupBy("ball").agg(F.sum("weight").alias("in_ball"))
    balls = balls.join(joined.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    placed = members.select("rep", "ball").join(balls, "ball").join(sums, "rep", "left")
    placed = common.materialize(reps.select("rep", "key", "least_id").join(placed, "rep").select(
        "key", "least_id", "component", (F.coalesce("links", F.lit(0)) + F.col("in_ball") - 1).alias("n_links")), "caps-placed")
    smallest = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return rows.select("id", "key").join(placed.join(smallest, "component").select("key", "n_links", "component_id"), "key").drop("key")


def sql(cosine: float = COSINE) -> str:
    """The same rows in DuckDB SQL by comparing all pairs, for a table ``embeddings`` of one length and no repeated ids."""
    return f"""with recursive fit as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from fit a join fit b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {cosine}),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where links.a = least.vec_id) as n_links, component_id, vec_id = component_id as kept from least"""
