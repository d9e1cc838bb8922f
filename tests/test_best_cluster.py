"""The pruned search of the best cluster: equal to comparing all with all, with part of the work."""
import numpy as np
from pyspark.sql import functions as F

from eventlens.operators import similarity as S
from eventlens.streaming import jobs


def _data(spark, seed=3):
    rng = np.random.default_rng(seed)
    groups = rng.normal(size=(12, 16))
    cents = [(k * 2, (groups[k % 12] + 0.1 * rng.normal(size=16)).tolist()) for k in range(240)] + [(1, [0.0] * 16), (3, groups[0].tolist()), (5, groups[0].tolist())]
    vecs = [(k, (groups[rng.integers(0, 12)] + 0.3 * rng.normal(size=16)).tolist()) for k in range(150)]
    vecs += [(1000, groups[0].tolist()), (1001, [0.0] * 16), (1002, rng.normal(size=16).tolist())]
    return (vecs, cents, spark.createDataFrame(vecs, "id long, embedding array<double>"),
            spark.createDataFrame(cents, "cluster_id long, centroid array<double>"))


def test_equals_all_pairs(spark):
    vecs, cents, v, c = _data(spark)
    want = {}
    for i, x in vecs:
        for k, y in cents:
            d = np.linalg.norm(x) * np.linalg.norm(y)
            s = float(np.dot(x, y) / d) if d else -1.0
            if s >= 0.6 and (i not in want or (s - want[i][1] > 1e-12 or (abs(s - want[i][1]) <= 1e-12 and k < want[i][0]))):
                want[i] = (k, s)
    for block in (2048, 7):
        got = {r.id: (r.cluster_id, r.similarity) for r in S.best_cluster_for_vectors(v, c, threshold=0.6, block_rows=block).collect()}
        assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in got)


def test_cells_leave_pairs_out(spark):
    _, cents, v, c = _data(spark)
    pivots = S.choose_pivots(c, wanted=12)
    cells = S.centroid_cells(c, pivots)
    held = {r["cell"]: r for r in cells.groupBy("cell").agg(F.min("angle").alias("l"), F.max("angle").alias("h"), F.count("*").alias("n")).collect()}
    reach = S.reachable_cells(v.select("id", F.col("embedding").alias("v")), pivots, {k: (r["l"], r["h"]) for k, r in held.items()}, 0.6)
    pairs = sum(held[r["cell"]]["n"] for r in reach.collect())
    assert pairs < 0.5 * v.count() * len(cents)


def test_no_clusters_no_match(spark):
    _, _, v, c = _data(spark)
    assert S.best_cluster_for_vectors(v, c.filter("false")).count() == 0
    assert S.best_cluster_for_vectors(v.filter("false"), c).count() == 0


def test_a_cluster_takes_one_article_of_a_source(spark):
    import datetime as dt
    at = dt.datetime(2025, 1, 3, 12, 0)
    cents = spark.createDataFrame([(10, [1.0, 0.0], at, 1, ["7"])], "cluster_id long, centroid array<double>, created_at timestamp_ntz, n long, sources array<string>")
    batch = spark.createDataFrame(
        [(1, 1, "h", "d", "2025-01-03 10:30:00", [0.9, 0.1]), (2, 1, "h", "d", "2025-01-03 10:00:00", [0.9, 0.11]),  # same source: 2 is earlier
         (3, 7, "h", "d", "2025-01-03 10:10:00", [1.0, 0.0])],                                                       # the cluster has source 7
        "id long, source_id long, headline string, description string, published_at string, embedding array<float>")
    matched, fresh = jobs.assign_batch(batch, cents, F.lit(at).cast("timestamp_ntz"))
    assert [(r.cluster_id, r.article_id) for r in matched.collect()] == [(10, 2)]
    assert {r.article_id: r.cluster_id for r in fresh.collect()} == {3: 3, 1: 3}
