"""Operator 12: hard negatives by angular triangle filtering.

A vector becomes integers, z = floor(scale * x); scores are inner products of these.  Every row stores its
angles to a few reference directions, taken from a sample of at most ``SAMPLE`` rows by farthest-first
choice.  Rows are sorted by (nearest reference, angle to it) and cut into shards of bounded size, a shard
into windows of ``WINDOW`` rows; each keeps the ranges of its rows' angles and norms.

By the triangle inequality the angle between an anchor and a row of a window is at least the gap between the
anchor's angle and the window's range, and at most the largest sum of the two (folded at pi), for every
reference.  That gives an interval for the cosine; times the norms, and widened by more than all rounding
errors together, it bounds the score.  Only windows whose bounds overlap what an anchor looks for get integer
scoring, and only shards that do are visited:

1. An anchor searches its own shard for positives; its k-th best score is what other shards must reach.
2. It searches those other shards; the lists are merged, so its positives are exact.
3. It searches the shards and windows that overlap any of its positives' score ranges for negatives.

In each of the three steps a row is shuffled once, whatever the number of anchors, and anchors stream past
the shards they need.  Scores are exact: float64 where no product sum passes 2**53, else 64-bit integers.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors as vec

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 80, 100
REFERENCES, SAMPLE, WINDOW = 16, 2048, 256
#: A shard holds at most about so many bytes of rows; small tables are cut finer, into up to ``SPREAD`` shards of ``LEAST`` rows.
SHARD_BYTES, SPREAD, LEAST = 96 << 20, 64, 4096
#: Scores a task holds at once.
SCORES = 1 << 23
#: Radians; angles are stored in 32 bits and arccos loses up to half the digits.
SLACK = 2e-6
WHOLE = 2.0 ** 62
#: Below every score.
NONE = -(1 << 63)


def directions(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.square(z).sum(axis=1))
    return norm, z / np.maximum(norm, 1.0)[:, None]


def references(z: np.ndarray, wanted: int) -> np.ndarray:
    """Unit vectors among the sample's directions, each the farthest from those before it."""
    norm, u = directions(z)
    u = u[norm > 0]
    if not len(u):
        return np.zeros((1, z.shape[1]))
    picked, close = [0], u @ u[0]
    while len(picked) < min(wanted, len(u)):
        picked.append(int(np.argmin(close)))
        close = np.maximum(close, u @ u[picked[-1]])
    return u[picked]


def _angles(u: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ refs.T, -1.0, 1.0)).astype(np.float32)


def _profiles(refs: np.ndarray, scale: int):
    """Rows (row, id, label, v) -> integers, angles to the references and the place in the sort order."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            z = np.floor(scale * vec.matrix(batch.column("v")))
            square = np.square(z).sum(axis=1)
            keep = np.flatnonzero(square <= WHOLE)
            _, u = directions(z[keep])
            angles = _angles(u, refs)
            cell = angles.argmin(axis=1) if len(keep) else np.empty(0, np.int64)
            part = batch.select(["row", "id", "label"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x.tobytes() for x in z[keep].astype(np.int64)], pa.binary()), pa.array([x.tobytes() for x in angles], pa.binary()),
                 pa.array(np.sqrt(square[keep])), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(keep)), cell], pa.float32())],
                names=["row", "id", "label", "z", "angles", "norm", "cell", "angle"])
    return run


def unpack(column: pa.Array, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)


def bounds(angles: np.ndarray, norm: np.ndarray, box: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper score of every anchor (angles, norm) with any row of every box (ranges of angles and norms)."""
    near = np.zeros((len(angles), len(box["low"])))
    far = np.full(near.shape, np.pi)
    for r in range(angles.shape[1]):
        a, lo, hi = angles[:, r, None].astype(np.float64), box["low"][None, :, r], box["high"][None, :, r]
        np.maximum(near, np.maximum(lo - a, a - hi), out=near)
        np.minimum(far, np.maximum(np.minimum(a + hi, 2 * np.pi - a - lo), 0.0), out=far)
    up, down = np.cos(np.clip(near - SLACK, 0.0, np.pi)), np.cos(np.clip(far + SLACK, 0.0, np.pi))
    least, most = norm[:, None] * box["least"][None, :], norm[:, None] * box["most"][None, :]
    slack = 1.0 + 1e-9 * most
    return np.where(down > 0, down * least, down * most) - slack, np.where(up > 0, up * most, up * least) + slack


class Shard:
    """The rows of one shard and the ranges of its windows."""

    def __init__(self, table: pa.Table):
        self.z, angles = unpack(table["z"], np.int64), unpack(table["angles"], np.float32).astype(np.float64)
        cell = angles.argmin(axis=1)
        order = np.lexsort((angles[np.arange(len(cell)), cell], cell))
        self.z, angles = self.z[order], angles[order]
        self.row, self.id = (table[c].to_numpy()[order] for c in ("row", "id"))
        self.label = table["label"].to_numpy()[order]
        norm = np.sqrt(np.square(self.z.astype(np.float64)).sum(axis=1))
        self.largest = norm.max()
        starts = np.arange(0, len(norm), WINDOW)
        self.windows = [(s, min(s + WINDOW, len(norm))) for s in starts.tolist()]
        self.box = {"low": np.minimum.reduceat(angles, starts), "high": np.maximum.reduceat(angles, starts),
                    "least": np.minimum.reduceat(norm, starts), "most": np.maximum.reduceat(norm, starts)}
        self.floats = self.z.astype(np.float64)

    def scores(self, z: np.ndarray, norm: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Integer scores of anchors with the rows of the windows they need; elsewhere the smallest number there is."""
        exact = float(norm.max()) * self.largest < 2.0 ** 52
        a, x = (z.astype(np.float64), self.floats) if exact else (z, self.z)
        out = np.full((len(z), len(self.z)), NONE, dtype=a.dtype)
        for w, (s, e) in enumerate(self.windows):
            some = np.flatnonzero(need[:, w])
            if len(some):
                out[some, s:e] = a[some] @ x[s:e].T
        return out

    def slices(self, table: pa.Table) -> Iterator[tuple[slice, dict]]:
        """The anchors of a batch, so many at a time that their scores fit."""
        z, angles = unpack(table["z"], np.int64), unpack(table["angles"], np.float32)
        norm = np.sqrt(np.square(z.astype(np.float64)).sum(axis=1))
        step = max(1, SCORES // len(self.z))
        for s in range(0, len(z), step):
            part = slice(s, s + step)
            yield part, {"z": z[part], "angles": angles[part], "norm": norm[part], "row": table["row"].to_numpy()[part],
                         "label": table["label"].to_numpy()[part]}


def _first(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of candidates (anchor, score, id) the places of each anchor's k first: higher scores, then smaller ids; sorted so."""
    order = np.lexsort((ids, -score, at))
    start = np.r_[True, np.diff(at[order]) != 0] if len(order) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else np.empty(0, np.int64)
    return order[np.arange(len(order)) - begin < k]


def _lists(at: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """Sorted anchor numbers and a value each -> a list per anchor."""
    ends = np.searchsorted(at, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64)))


def _positives(k: int):
    """Anchors (z, angles, reach: the least score of use, or null) -> the k first rows of their label in the shard."""
    def search(points: pa.Table):
        shard = Shard(points)

        def find(anchors: pa.Table) -> pa.RecordBatch:
            reach = anchors["reach"].to_pylist()
            rows, ids, scores = [], [], []
            for part, a in shard.slices(anchors):
                least = np.array([NONE if x is None else x for x in reach[part]], dtype=np.int64)
                need = bounds(a["angles"], a["norm"], shard.box)[1] >= least[:, None]
                s = shard.scores(a["z"], a["norm"], need)
                good = s >= least[:, None].astype(s.dtype)
                new = np.flatnonzero(least == NONE)
                if len(new):  # nothing known yet: what the k-th best of this shard reaches
                    same = np.where((a["label"][new][:, None] == shard.label) & (a["row"][new][:, None] != shard.row), s[new], s.dtype.type(NONE))
                    kth = min(k, same.shape[1])
                    good[new] = (same >= np.partition(same, -kth, axis=1)[:, -kth][:, None]) & (same > s.dtype.type(NONE))
                at, x = np.nonzero(good & np.repeat(need, [e - b for b, e in shard.windows], axis=1))
                ok = (a["label"][at] == shard.label[x]) & (a["row"][at] != shard.row[x])
                at, x = at[ok], x[ok]
                first = _first(at, s[at, x], shard.id[x], k)
                n = len(a["row"])
                rows.append(pa.array(a["row"])), ids.append(_lists(at[first], n, shard.id[x[first]])), scores.append(_lists(at[first], n, s[at, x][first]))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in (rows, ids, scores)], names=["row", "ids", "scores"])
        return find
    return search


def _negatives(k: int, low: int, high: int):
    """Anchors (z, angles, goals: their positives' scores) -> per goal the k first rows of other labels in its range."""
    def search(points: pa.Table):
        shard = Shard(points)

        def find(anchors: pa.Table) -> pa.RecordBatch:
            goals = anchors["goals"].to_pylist()
            rows, nth, ids, scores = [], [], [], []
            for part, a in shard.slices(anchors):
                ranges = [[goal_range(g, low, high) for g in gs] for gs in goals[part]]
                least = np.array([min(r[0] for r in rs) for rs in ranges], dtype=np.int64)
                most = np.array([max(r[1] for r in rs) for rs in ranges], dtype=np.int64)
                down, up = bounds(a["angles"], a["norm"], shard.box)
                need = (up >= least[:, None]) & (down <= most[:, None])
                s = shard.scores(a["z"], a["norm"], need)
                at, x = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & np.repeat(need, [e - b for b, e in shard.windows], axis=1))
                ok = a["label"][at] != shard.label[x]
                at, x = at[ok], x[ok]
                score = s[at, x].astype(np.int64)
                for j in range(max(map(len, ranges), default=0)):
                    lo = np.array([rs[j][0] if j < len(rs) else 1 for rs in ranges], dtype=np.int64)
                    hi = np.array([rs[j][1] if j < len(rs) else 0 for rs in ranges], dtype=np.int64)
                    mine = np.flatnonzero((score >= lo[at]) & (score <= hi[at]))
                    first = mine[_first(at[mine], score[mine], shard.id[x[mine]], k)]
                    found = np.unique(at[first])
                    where = np.searchsorted(found, at[first])
                    rows.append(pa.array(a["row"][found])), nth.append(pa.array(np.full(len(found), j, np.int32)))
                    ids.append(_lists(where, len(found), shard.id[x[first]])), scores.append(_lists(where, len(found), score[first]))
            if not rows:
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))],
                                                  names=["row", "nth", "ids", "scores"])
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in (rows, nth, ids, scores)], names=["row", "nth", "ids", "scores"])
        return find
    return search


def goal_range(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _route(boxes: dict, low: int, high: int, goals: bool):
    """Anchors -> a row for each shard whose bounds overlap what they look for (their own, for positives, is done)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            angles, norm = unpack(batch.column("angles"), np.float32), batch.column("norm").to_numpy()
            down, up = bounds(angles, norm, boxes)
            if goals:
                ranges = [[goal_range(g, low, high) for g in gs] for gs in batch.column("goals").to_pylist()]
                need = ((up >= np.array([min(r[0] for r in rs) for rs in ranges], np.float64)[:, None])
                        & (down <= np.array([max(r[1] for r in rs) for rs in ranges], np.float64)[:, None]))
            else:
                least = np.array([NONE if x is None else x for x in batch.column("reach").to_pylist()], dtype=np.int64)
                need = (up >= least[:, None]) & (batch.column("home").to_numpy()[:, None] != boxes["shard"][None, :])
            at, to = np.nonzero(need)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(boxes["shard"][to], pa.int32()), *out.columns], names=["shard", *out.schema.names])
    return run


def _merge(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first of each key's lists, as ``best``: structs (far = -score, id)."""
    hits = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("far"), p["ids"].alias("id")))
    return found.filter(F.size("ids") > 0).groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k).alias("best"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         shard_bytes: int = SHARD_BYTES, wanted_references: int = REFERENCES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that satisfy ``is_anchor`` (a condition on ``id``).  An anchor's positives are the first
    ``positives`` other rows of its label; a positive's negatives the first ``negatives`` rows of other labels whose score
    lies within ``low`` and ``high`` hundredths of the positive's.  First means a higher score, then a smaller id.

    Rows with a null id, label or vector, an empty vector or one with null or non-finite components take no part,
    nor do rows whose vector has not the commonest length or whose integers' squares add up to more than 2**62 (their
    scores need not fit a long).  Rows that repeat an id are rows of their own, so one may be the other's positive, and
    each repeat of an anchor is an anchor.  A vector of zeros scores 0 with all.  Without positives, or without
    negatives in range, there is no row; an empty table gives an empty result."""
    named = vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    x, n, dim = vec.usable(named, "angular-vectors", id=id_col, v=vector_col, label=label_col)
    sample = common.hash_sample(x, "row", SAMPLE, n).select("v").collect()
    z = np.floor(scale * np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), dim))
    refs = references(z[np.square(z).sum(axis=1) <= WHOLE], wanted_references)
    kind = x.schema["label"].dataType.simpleString()
    placed = x.mapInArrow(_profiles(refs, scale), f"row long, id long, label {kind}, z binary, angles binary, norm double, cell int, angle float")
    shards = max(1, min(SPREAD, -(-n // LEAST)), -(-n * 8 * (dim + len(refs)) // shard_bytes))
    rows = common.materialize(placed.repartitionByRange(shards, "cell", "angle", "row").withColumn("shard", F.spark_partition_id())
                              .drop("cell", "angle"), "angular-shards")
    boxes = _boxes(rows, len(refs))
    points = rows.select("shard", "row", "id", "label", "z", "angles")
    anchors = rows.filter(is_anchor).withColumnRenamed("shard", "home")
    look = "row long, ids array<long>, scores array<long>"

    own = common.materialize(vec.visit(points, anchors.select(F.col("home").alias("shard"), "row", "label", "z", "angles",
                                                              F.lit(None).cast("long").alias("reach")), _positives(positives), look), "angular-own")
    known = own.select("row", F.when(F.size("scores") == positives, F.element_at("scores", -1)).alias("reach"))
    asked = anchors.join(known, "row", "left")
    fields = f"row long, label {kind}, z binary, angles binary"
    routed = (asked.select("row", "label", "z", "angles", "norm", "home", "reach")
              .mapInArrow(_route(boxes, low, high, False), f"shard int, {fields}, norm double, home int, reach long").drop("norm", "home"))
    other = vec.visit(points, routed, _positives(positives), look)
    chosen = common.materialize(_merge(own.unionByName(other), ["row"], positives), "angular-positives")

    goals = F.transform("best", lambda p: -p["far"])
    routed = (anchors.join(chosen, "row").select("row", "label", "z", "angles", "norm", goals.alias("goals"))
              .mapInArrow(_route(boxes, low, high, True), f"shard int, {fields}, norm double, goals array<long>").drop("norm"))
    found = vec.visit(points, routed, _negatives(negatives, low, high), "row long, nth int, ids array<long>, scores array<long>")
    hard = _merge(found, ["row", "nth"], negatives).withColumnRenamed("best", "hits")
    pairs = (hard.join(chosen, "row").join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
             .select("anchor_id", F.get("best", F.col("nth")).alias("p"), F.posexplode("hits").alias("at", "hit")))
    return pairs.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"),
                        (-F.col("p.far")).alias("positive_score"), (-F.col("hit.far")).alias("negative_score"))


def _box(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and shard the ranges of angles and norms."""
    for batch in it:
        shard = batch.column("shard").to_numpy()
        angles, norm = unpack(batch.column("angles"), np.float32), batch.column("norm").to_numpy()
        out = [(int(s), angles[m].min(axis=0).tolist(), angles[m].max(axis=0).tolist(), norm[m].min(), norm[m].max())
               for s in np.unique(shard) for m in [shard == s]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out) if out else [[]] * 5, (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()))],
            names=["shard", "low", "high", "least", "most"])


def _boxes(rows: DataFrame, refs: int) -> dict:
    """Ranges of every shard, at the driver: some 300 bytes for ``SHARD_BYTES`` of rows."""
    parts = rows.select("shard", "angles", "norm").mapInArrow(_box, "shard int, low array<double>, high array<double>, least double, most double")
    got = parts.groupBy("shard").agg(
        *[F.min(F.get("low", F.lit(r))).alias(f"l{r}") for r in range(refs)], *[F.max(F.get("high", F.lit(r))).alias(f"h{r}") for r in range(refs)],
        F.min("least").alias("least"), F.max("most").alias("most")).orderBy("shard").collect()
    pick = lambda names: np.array([[g[c] for c in names] for g in got], dtype=np.float64).reshape(len(got), len(names))
    return {"shard": np.array([g["shard"] for g in got], dtype=np.int64), "low": pick([f"l{r}" for r in range(refs)]), "high": pick([f"h{r}" for r in range(refs)]),
            "least": pick(["least"])[:, 0], "most": pick(["most"])[:, 0]}


def sql(positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, every: int = 100) -> str:
    """The same rows in DuckDB SQL by scoring all rows with each anchor, for a table ``embeddings`` of one length and no repeated ids."""
    return f"""with kept as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as z
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.vec_id as anchor_id, x.vec_id as id, a.label = x.label as same, cast(list_dot_product(a.z, x.z) as bigint) as s
  from kept a join kept x on a.vec_id % {every} = 0 and a.vec_id <> x.vec_id),
positive as (
  select anchor_id, id as positive_id, s as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by s desc, id) <= {positives})
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by s desc, id) as integer) as rank,
  id as negative_id, positive_score, s as negative_score
from positive join scored using (anchor_id)
where not same and {low} * positive_score <= 100 * s and 100 * s <= {high} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by s desc, id) <= {negatives}"""
