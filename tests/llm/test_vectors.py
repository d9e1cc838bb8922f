"""Operators on vectors against brute force: codes, hard negatives, near duplicates, with edge cases."""
import hashlib
import math

import numpy as np
import pytest

from eventlens.llm import angular, caps, lloyd
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ["id", "row", "v", "z", "ball", "filter", "shard", "part", "entry", "key", "of", "best"]


def clustered(seed, n, dim, spread=0.05, groups=6):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dim))
    x = centers[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))
    loose = rng.random(n) < 0.5
    x[loose] = rng.standard_normal((loose.sum(), dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def rows():
    x = clustered(1, 260, 16)
    out = [(i * 3, [float(np.float32(c)) for c in v], int(i % 4)) for i, v in enumerate(x)]
    out += [(300 + i, out[5][1], 1) for i in range(40)]  # many copies
    out += [(6, out[9][1], 2), (6, out[2][1], 2), (7, out[2][1], None), (None, out[3][1], 3), (None, None, None)]  # repeated and null ids, null label
    out += [(2001, [0.0] * 16, 0), (2002, [-0.0] * 16, 0), (2003, None, 0), (2004, [], 0), (2005, [float("nan")] + [1.0] * 15, 0),
            (2006, [float("inf")] + [1.0] * 15, 0), (2007, [None] + [1.0] * 15, 0), (2008, [1.0, 2.0], 0), (2100, [7.5 * c for c in out[5][1]], 3)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def fine(v, dim=16):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = np.array_split(np.arange(16), parts)
    book = [[[z[c] for c in cut] for _, z, _ in kept[:entries]] for cut in cuts]
    pick = lambda p, z: min((sum((z[c] - b) ** 2 for c, b in zip(cuts[p], e)), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p, cut in enumerate(cuts):
            at = [pick(p, z)[1] for _, z, _ in kept]
            for k in range(len(book[p])):
                mine = [z for (_, z, _), a in zip(kept, at) if a == k]
                if mine:
                    book[p][k] = [sum(z[c] for z in mine) // len(mine) for c in cut]
    found = []
    for i, z, label in kept:
        best = [pick(p, z) for p in range(parts)]
        found.append([i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label])
    sums = {}
    for _, _, e, label in found:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return [(i, code, e, sums[label], digest) for i, code, e, label in found]


def same(got, expected):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def test_codes_equal_brute_force(table, rows):
    same(lloyd.codes(table).collect(), codes_by_hand(rows))


def test_codes_of_hot_entries_and_many_owners(spark, rows, monkeypatch):
    monkeypatch.setattr(lloyd, "OWNER_BYTES", 512)  # many salts
    many = rows + [(5000 + i, rows[5][1], None) for i in range(200)]
    same(lloyd.codes(spark.createDataFrame(many, SCHEMA).repartition(5)).collect(), codes_by_hand(many))


def test_codes_of_large_numbers_are_exact(spark):
    x = [(i, [float(np.float32(c)) for c in (3e30 * (i + 1), -1.5e3, 0.25 * i, 7e5)] * 4, i % 2) for i in range(9)]
    got = {r["vec_id"]: r for r in lloyd.codes(spark.createDataFrame(x, SCHEMA), entries=3, rounds=2).collect()}
    expected = {r[0]: r for r in codes_by_hand(x, entries=3, rounds=2)}
    assert {i: r["code"] for i, r in got.items()} == {i: r[1] for i, r in expected.items()}
    for i, r in got.items():
        assert r["error"] == (expected[i][2] if expected[i][2] < 1 << 63 else None)
        assert r["codebooks_sha256"] == expected[i][4]


def test_codes_of_few_rows_and_none(spark, table):
    few = [(4, [0.5] * 16, None), (9, [0.25] * 16, 1)]
    same(lloyd.codes(spark.createDataFrame(few, SCHEMA)).collect(), codes_by_hand(few))
    assert lloyd.codes(table.filter("1 = 0")).count() == 0


def hard_by_hand(rows, anchor, scale=256, positives=5, negatives=5, dim=16):
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if i is not None and label is not None and fine(v, dim)]
    out = []
    for k, (i, a, label) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, z)), j, at, m) for at, (j, z, m) in enumerate(kept) if at != k)
        for ps, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            hits = [s for s in scored if s[3] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(i, j, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(hits)]
    return out


@pytest.mark.parametrize("shard_bytes", [angular.SHARD_BYTES, 6000])
def test_hard_negatives_equal_brute_force(table, rows, shard_bytes):
    got = angular.mine(table, F.col("id") % 6 == 0, shard_bytes=shard_bytes).collect()
    expected = hard_by_hand(rows, lambda i: i % 6 == 0)
    assert len(expected) > 300
    same(got, expected)


def test_hard_negatives_of_large_numbers_rare_labels_and_none(spark, table):
    x = clustered(3, 80, 8)
    rows = [(i, [float(c) for c in v * 10.0 ** (i % 7)], "ab"[i % 2] if i else "only") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    same(angular.mine(df, F.col("id") % 3 == 0, shard_bytes=3000).collect(), hard_by_hand(rows, lambda i: i % 3 == 0, dim=8))
    assert angular.mine(table.filter("1 = 0"), F.col("id") % 3 == 0).count() == 0


def test_bounds_hold_and_leave_windows_out():
    rng = np.random.default_rng(2)
    z = np.floor(256 * clustered(4, 4000, 12, spread=0.02, groups=20))
    refs = angular.references(z[:500], 16)
    norm, u = angular.directions(z)
    angles = angular._angles(u, refs)
    cell = angles.argmin(axis=1)
    order = np.lexsort((angles[np.arange(len(z)), cell], cell))
    z, norm, angles = z[order], norm[order], angles[order]
    starts = np.arange(0, len(z), 50)
    box = {"low": np.minimum.reduceat(angles, starts), "high": np.maximum.reduceat(angles, starts),
           "least": np.minimum.reduceat(norm, starts), "most": np.maximum.reduceat(norm, starts)}
    some = rng.choice(len(z), 60, replace=False)
    down, up = angular.bounds(angles[some], norm[some], box)
    s = z[some] @ z.T
    low, high = np.minimum.reduceat(s, starts, axis=1), np.maximum.reduceat(s, starts, axis=1)
    assert (down <= low).all() and (up >= high).all()
    fifth = np.sort(s, axis=1)[:, -6]
    assert (up < fifth[:, None]).mean() > 0.2  # on clustered vectors the triangle leaves windows out


def links_by_hand(rows, cosine=0.9, dim=16):
    fit = [k for k, (_, v, *_) in enumerate(rows) if fine(v, dim) and any(v)]
    x = np.array([rows[k][1] for k in fit], dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        p, q = root(fit[a]), root(fit[b])
        parent[max(p, q)] = min(p, q)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    n = dict(zip(fit, near.sum(axis=1).tolist()))
    out = []
    for k, (i, *_) in enumerate(rows):
        c = least.get(root(k))
        out.append((i, n.get(k, 0), c, c is None or i == c))
    return out


@pytest.mark.parametrize("block", [caps.BLOCK, 8])
def test_near_vectors_equal_brute_force(table, rows, block):
    expected = links_by_hand(rows)
    assert sum(r[1] for r in expected) > 2000
    same(caps.components(table, block=block).collect(), expected)


def test_near_copies_of_a_third_of_all_rows(spark):
    """One large group of near copies, in balls and blocks, beside scattered vectors and a chain of links."""
    rng = np.random.default_rng(8)
    dim = 32
    center = rng.standard_normal(dim)
    x = np.concatenate([center + 0.12 * rng.standard_normal((400, dim)), rng.standard_normal((800, dim))])
    turn = np.arange(6) * 0.4
    x = np.concatenate([x, np.cos(turn)[:, None] * np.eye(dim)[0] + np.sin(turn)[:, None] * np.eye(dim)[1]])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    got = caps.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()
    same(got, links_by_hand(rows, dim=dim))


@pytest.mark.parametrize("dim", [1, 2, 3, 24, 64])
def test_filters_find_pairs_at_the_threshold(dim):
    rng = np.random.default_rng(dim)
    x = caps.unit(rng.standard_normal((1500, dim)))
    y = rng.standard_normal((1500, dim))
    y = y - np.einsum("nd,nd->n", x, y)[:, None] * x
    y = 0.9 * x + math.sqrt(0.19) * caps.unit(y) if dim > 1 else x
    code = caps.Code(dim, 40)
    found = [not set(a.tolist()).isdisjoint(b.tolist()) for a, b in zip(code.decode(x), code.decode(y))]
    assert np.mean(found) > 0.995
    every = (code.products(x)[0][:, :, None] + code.products(x)[1][:, None, :]).reshape(len(x), -1)
    reached = np.take_along_axis(every, code.decode(x), 1).min(axis=1)
    assert ((every > reached[:, None] + 1e-9).sum(axis=1) < code.k).all()  # no better direction is left out


def test_near_vectors_of_an_empty_table(table):
    assert caps.components(table.filter("1 = 0")).count() == 0
    assert [tuple(r) for r in caps.components(table.filter("vec_id = 2003")).collect()] == [(2003, 0, 2003, True)]
