"""Vector similarity (C-1 … C-3, C-6, C-8, C-9) and the pruned search of the best cluster.

Scalar vector maths is written with Spark's higher-order functions
(``zip_with`` / ``aggregate``), so it stays in the JVM.  Many vectors meet many centroids in
blocks of bounded size, a ``cogroup().applyInPandas`` task with a NumPy matrix product each;
the triangle inequality on a few pivots decides which blocks meet, and only the best centroid
of a vector leaves a task.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import arabic_normalize_v2
from ..session import materialize



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 of an NTZ wall-clock value."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def clustering_text(headline, description) -> Column:
    """C-1: ``f"{norm2(headline)}. {norm2(description)}"``."""
    return F.concat(arabic_normalize_v2(headline), F.lit(". "), arabic_normalize_v2(description))


def has_content(headline, description) -> Column:
    """B-12: the clustering text ``norm2(h) + '. ' + norm2(d)`` is not empty or '.' once
    stripped, i.e. headline or description keeps a character that is neither white space
    nor one of the marks the normaliser drops.  A regex *find* stops at the first such
    character instead of rewriting the whole (possibly very long) text."""
    from ..functions.text import MARKS_V2_RE, WS
    visible = rf"[^{WS}{MARKS_V2_RE[1:-1]}]"
    return (F.coalesce(_c(headline), F.lit("")).rlike(visible)
            | F.coalesce(_c(description), F.lit("")).rlike(visible))


def to_double(vec) -> Column:
    return F.transform(_c(vec), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """C-3: cosine similarity; null when either vector has zero length."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)


def vec_sum(vectors) -> Column:
    """Element-wise sum of an array of equal-length vectors."""
    v = _c(vectors)
    zero = F.array_repeat(F.lit(0.0), F.size(F.element_at(v, 1)))
    return F.aggregate(v, zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))


def centroids(members: DataFrame, key: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """C-6: mean vector per key.  ``posexplode`` + partial ``avg`` per (key, position):
    map-side combine bounds the shuffle to keys × dims per task."""
    e = members.select(key, F.posexplode(to_double(vec)).alias("pos", "x"))
    m = e.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    g = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_p"))
    return g.select(key, F.transform("_p", lambda s: s["x"]).alias("centroid"),
                    F.size("_p").alias("dim"))


def update_centroid(centroid, n, vec) -> Column:
    """C-9: running mean after adding one vector: (n·c + v)/(n + 1)."""
    return F.zip_with(_c(centroid), to_double(vec), lambda c, v: (c * _c(n) + v) / (_c(n) + 1))


# ---------------------------------------------------------------------------
# Best cluster among many
# ---------------------------------------------------------------------------
def unit_matrix_fn():
    """Row-normalising helper for task-side code, built as a closure so that it is shipped
    by value with the task (workers need not import this package)."""
    import numpy as np_

    def unit(vectors) -> "np_.ndarray":
        m = np_.stack([np_.asarray(v, dtype=np_.float64) for v in vectors])
        n = np_.linalg.norm(m, axis=1, keepdims=True)
        with np_.errstate(invalid="ignore", divide="ignore"):
            return m / n

    return unit


#: Centroids of the sample that pivots come from, pivots, rows of a block.
PIVOT_SAMPLE, PIVOTS = 2048, 48


def choose_pivots(cents: DataFrame, wanted: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Unit vectors among at most about ``sample`` centroids (cluster_id, centroid), each the farthest from those before it."""
    n = cents.count()
    kept = cents if n <= sample else cents.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    rows = [r["centroid"] for r in kept.select(F.col("cluster_id"), to_double("centroid").alias("centroid")).orderBy("cluster_id").collect()]
    m = np.array([v for v in rows if v and all(x is not None for x in v) and any(v)], dtype=np.float64)
    if not len(m):
        return np.zeros((0, 0))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    picked, near = [0], m @ m[0]
    while len(picked) < min(wanted, len(m)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, m @ m[picked[-1]])
    return m[picked]


def centroid_cells(cents: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Centroids (cluster_id, centroid) with their cell, the nearest pivot, and their angle to it."""
    unit = unit_matrix_fn()

    def place(it):
        for pdf in it:
            if len(pdf):
                angle = np.arccos(np.clip(np.nan_to_num(unit(pdf["centroid"])) @ pivots.T, -1.0, 1.0))
                cell = angle.argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32), angle=angle[np.arange(len(cell)), cell])

    src = cents.select(F.col("cluster_id").cast("long").alias("cluster_id"), to_double("centroid").alias("centroid"))
    return src.mapInPandas(place, "cluster_id long, centroid array<double>, cell int, angle double")


def reachable_cells(vectors: DataFrame, pivots: np.ndarray, ranges: dict[int, tuple[float, float]], threshold: float) -> DataFrame:
    """(id, v, cell): a row for each cell that can hold a centroid with cosine >= ``threshold``.

    A centroid lies at ``low`` to ``high`` from its pivot, a vector at ``a``: by the triangle inequality the angle between
    them is at least a - high and low - a."""
    unit = unit_matrix_fn()
    cells = np.array(sorted(ranges), dtype=np.int32)
    low, high = (np.array([ranges[c][k] for c in sorted(ranges)]) for k in (0, 1))
    most = np.arccos(np.clip(threshold, -1.0, 1.0)) + 1e-6  # more than all rounding of the angles

    def reach(it):
        for pdf in it:
            if len(pdf):
                a = np.arccos(np.clip(unit(pdf["v"]) @ pivots[cells].T, -1.0, 1.0))
                with np.errstate(invalid="ignore"):
                    at, c = np.nonzero(np.maximum(a - high, low - a) <= most)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "cell": cells[c]})

    return vectors.mapInPandas(reach, "id long, v array<double>, cell int")


def best_cluster_for_vectors(vectors: DataFrame, cents: DataFrame, as_of: Column | None = None,
                             threshold: float = fx.SIMILARITY_THRESHOLD,
                             hours: float = fx.BEST_CLUSTER_WINDOW_HOURS,
                             block_rows: int = 2048) -> DataFrame:
    """C-8 for a batch: for every vector (id, embedding) the active cluster (cluster_id,
    centroid, created_at) with the highest cosine ≥ ``threshold`` (lowest id wins ties).
    Vectors without such a cluster are left out.

    Exact, without comparing all with all: centroids lie in the cells of a few pivots, and a vector meets only the
    cells that the triangle inequality leaves.  Cells and the vectors that reach them are cut into blocks."""
    c = cents
    if as_of is not None:
        c = c.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    c = materialize(c.select("cluster_id", "centroid"), "c8-centroids")
    v = materialize(vectors.select(F.col("id").cast("long").alias("id"), to_double("embedding").alias("v")).filter("v is not null"), "c8-vectors")
    pivots = choose_pivots(c)
    none = v.sparkSession.createDataFrame([], "id long, cluster_id long, similarity double")
    if not len(pivots):
        return none
    cells = materialize(centroid_cells(c, pivots), "c8-cells")
    held = {r["cell"]: r for r in cells.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()}
    pairs = materialize(reachable_cells(v, pivots, {k: (r["low"], r["high"]) for k, r in held.items()}, threshold), "c8-reach")
    asked = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    if not asked:
        return none
    plan = F.create_map(*[F.lit(x) for k, n in asked.items() for x in (k, F.struct(
        F.lit(-(-n // block_rows)).alias("left"), F.lit(-(-held[k]["n"] // block_rows)).alias("right")))])[F.col("cell")]
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"plan.{side}") - 1))
    own = lambda key, side: F.pmod(F.xxhash64(key), F.col(f"plan.{side}")).cast("int")
    left = pairs.withColumn("plan", plan).withColumn("i", own("id", "left")).withColumn("j", every("right")).drop("plan")
    right = cells.filter(F.col("cell").isin(sorted(asked))).withColumn("plan", plan).withColumn("j", own("cluster_id", "right")) \
        .withColumn("i", every("left")).select("cell", "i", "j", "cluster_id", "centroid")

    unit = unit_matrix_fn()

    def best(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if not len(lpdf) or not len(rpdf):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "cluster_id": pd.Series([], dtype="int64"), "similarity": pd.Series([], dtype="float64")})
        s = unit(lpdf["v"]) @ unit(rpdf["centroid"]).T
        s = np.where(np.isnan(s), -np.inf, s)
        rid = rpdf["cluster_id"].to_numpy()
        order = np.argsort(rid, kind="stable")
        s, rid = s[:, order], rid[order]
        j = np.argmax(s, axis=1)  # first (lowest id) among equal maxima
        sim = s[np.arange(len(j)), j]
        ok = sim >= threshold
        return pd.DataFrame({"id": lpdf["id"].to_numpy()[ok], "cluster_id": rid[j][ok], "similarity": sim[ok]})

    key = ("cell", "i", "j")
    cand = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "id long, cluster_id long, similarity double")
    return cand.groupBy("id").agg(
        F.max_by(F.struct("cluster_id", "similarity"),
                 F.struct(F.col("similarity"), -F.col("cluster_id"))).alias("b")
    ).select("id", "b.cluster_id", "b.similarity")
