"""Distributed event clustering ≡ the plain sequential pass (property tests)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import clustering as C

H = C.HOUR_US


def sequential_reference(rows: list[tuple], threshold: float, window_hours: float) -> dict[int, tuple[int, float]]:
    """Plain sequential pass (test oracle, small inputs only): rows = (id, src, t_us, vec)."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    clusters: list[dict] = []
    out = {}
    for aid, src, t, v in rows:
        v = np.asarray(v, dtype=np.float64)
        best, best_sim = None, -1.0
        for c in clusters:
            if t - c["last"] > window_hours * H or src in c["srcs"]:
                continue
            cen = c["sum"] / c["n"]
            d = np.linalg.norm(v) * np.linalg.norm(cen)
            sim = float(v @ cen / d) if d > 0 else float("nan")
            if sim > best_sim:
                best, best_sim = c, sim
        if best is not None and best_sim > threshold:
            best["sum"] = best["sum"] + v
            best["n"] += 1
            best["srcs"].add(src)
            best["last"] = t
            out[aid] = (best["root"], best_sim)
        else:
            clusters.append({"root": aid, "sum": v.copy(), "n": 1, "srcs": {src}, "last": t})
            out[aid] = (aid, 1.0)
    return out


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, src string, t_us long, vec array<double>")


def _check(spark, rows, theta, window):
    got = {r.id: (r.label, r.score) for r in C.cluster_labels(_points(spark, rows), theta, window).collect()}
    exp = sequential_reference(rows, theta, window)
    for k, (lab, sc) in exp.items():
        assert got[k][0] == lab, (k, got[k], (lab, sc))
        assert abs(got[k][1] - sc) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_random_equivalence(spark, seed):
    rng = np.random.default_rng(seed)
    n, d = 40, int(rng.integers(4, 12))
    theta = [0.3, 0.5, 0.7][seed % 3]
    window = [20, 100, 300][seed % 3]
    centers = rng.normal(size=(5, d))
    rows = []
    for i in range(n):
        v = centers[rng.integers(0, 5)] + 0.6 * rng.normal(size=d)
        v *= rng.uniform(0.5, 3.0)  # unequal norms
        rows.append((i, f"s{rng.integers(0, 4)}", int(rng.integers(0, 200)) * H, v.tolist()))
    _check(spark, rows, theta, window)


def test_window_equality_and_source_rule(spark):
    v = [1.0, 0.0]
    rows = [(1, "a", 0, v), (2, "b", 10 * H, v),      # gap = W exactly: joins
            (3, "b", 11 * H, v),                        # same source as 2: cannot join cluster 1
            (4, "c", 40 * H, v)]                        # gap > W from last update: new cluster
    got = {r.id: r.label for r in C.cluster_labels(_points(spark, rows), 0.5, 10).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_threshold_is_strict_and_ties_go_to_older(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "b", 1 * H, [0.0, 1.0]),
            (3, "c", 2 * H, [1.0, 1.0])]                # cos 0.7071 to both: older cluster 1 wins
    got = {r.id: r.label for r in C.cluster_labels(_points(spark, rows), 0.5, 100).collect()}
    assert got[3] == 1
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "b", 1 * H, [0.6, 0.8])]  # cos = 0.6 exactly
    got = {r.id: r.label for r in C.cluster_labels(_points(spark, rows), 0.6, 100).collect()}
    assert got[2] == 2


def test_zero_vector_stays_alone(spark):
    rows = [(1, "a", 0, [0.0, 0.0]), (2, "b", H, [1.0, 0.0]), (3, "c", 2 * H, [1.0, 0.1])]
    got = {r.id: r.label for r in C.cluster_labels(_points(spark, rows), 0.5, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_rejects_unparseable_dates(spark):
    df = spark.createDataFrame(
        [(1, 1, "h", "d", "2025-01-01 10:00:00", [1.0]), (2, 2, "h", "d", "12:18 | 25-11-2025", [1.0]),
         (3, 3, "", "", "2025-01-01 10:00:00", [1.0])],
        "id long, source_id long, headline string, description string, published_at string, embedding array<float>")
    good, rej = C.prepare(df)
    assert [r.id for r in good.collect()] == [1]
    assert {(r.id, r.reason) for r in rej.collect()} == {(2, "unparseable date"), (3, "empty content")}


def test_states_grow_with_the_archive_and_not_with_the_sources(spark):
    """Over 24 windows a band's articles meet the states of two bands, however many sources there are."""
    rng = np.random.default_rng(11)
    for sources in (2, 40):
        rows = [(i, f"s{i % sources}", (i // 6) * 10 * H, rng.normal(size=4).tolist()) for i in range(24 * 6)]
        pts = _points(spark, rows).withColumn("band", C.band_of(10))
        labels = pts.withColumn("label", F.col("id") - F.col("id") % 6)  # six articles a label
        states = C.cluster_states(labels, pts)
        assert states.count() == (24 * 2 if sources == 2 else 24 * 6)  # at most one counting member per source
        assert states.filter(F.size("srcs") > min(sources, 6)).count() == 0
        per_band = {r["band"]: r["n"] for r in pts.groupBy("band").agg(F.count("*").alias("n")).collect()}
        assert len(per_band) == 24 and sum(n * (n + per_band.get(b - 1, 0)) for b, n in per_band.items()) <= 2 * 24 * 36


def test_bands_blocks_and_chains_equal_the_sequential_pass(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 6))
    rows = [(i, f"s{rng.integers(0, 3)}", int(rng.integers(0, 400)) * H, (centers[rng.integers(0, 4)] + 0.5 * rng.normal(size=6)).tolist()) for i in range(80)]
    got = {r.id: (r.label, r.score) for r in C.cluster_labels(_points(spark, rows), 0.5, 15, block_rows=4).collect()}
    for k, (lab, sc) in sequential_reference(rows, 0.5, 15).items():
        assert got[k][0] == lab and abs(got[k][1] - sc) < 1e-9


def test_chunks_do_not_grow_with_the_depth_of_the_decisions(spark):
    """each decision hangs on the one before (a long chain); the passes over the articles follow their number alone."""
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=(90, 3)), axis=0)
    rows = [(i, f"s{i % 7}", i * H, walk[i].tolist()) for i in range(90)]
    stats = {}
    got = {r.id: (r.label, r.score) for r in C.cluster_labels(_points(spark, rows), 0.6, 40, stats=stats).collect()}
    assert stats["chunks"] == 1
    for k, (lab, sc) in sequential_reference(rows, 0.6, 40).items():
        assert got[k][0] == lab and abs(got[k][1] - sc) < 1e-9


def test_a_chunk_ends_where_candidates_run_out(spark, monkeypatch):
    """With one candidate an article the chunk often cannot tell the best state; it ends there and the result stays exact."""
    monkeypatch.setattr(C, "CANDIDATES", 1)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(2, 5))
    rows = [(i, f"s{rng.integers(0, 3)}", i // 3 * H, (centers[i % 2] + 0.4 * rng.normal(size=5)).tolist()) for i in range(48)]
    rows[10:20] = [(i, f"s{i % 3}", 5 * H, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(10, 20)]  # copies: ties go to the oldest
    stats = {}
    got = {r.id: (r.label, r.score) for r in C.cluster_labels(_points(spark, rows), 0.5, 200, block_rows=6, stats=stats).collect()}
    assert stats["chunks"] > 4  # 48 articles in chunks of 12, some cut short
    for k, (lab, sc) in sequential_reference(rows, 0.5, 200).items():
        assert got[k][0] == lab and abs(got[k][1] - sc) < 1e-9


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (1, "a", 0, [1.0, 0.0]), (2, None, H, [1.0, 0.1]), (None, "c", 2 * H, [1.0, 0.0])]
    got = sorted(((r.id, r.label) for r in C.cluster_labels(_points(spark, rows), 0.5, 10).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
