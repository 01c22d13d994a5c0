import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import centroids


def brute(rows, dims, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]
    at = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    sums = [sum(d for _, d, o in out if o == j) for j in range(len(at))]
    fits = lambda v: v if v < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    null = lambda v, all_: fits(v) if all(fits(x) is not None for x in all_) else None
    ds = [[d for _, d, o in out if o == j] for j in range(len(at))]
    return sorted(((i, o, fits(d), null(sums[o], ds[o]), null(sum(sums), [*sums, *(d for _, d, _ in out)]), sha[o]) for i, d, o in out), key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    return sorted((tuple(x) for x in centroids.cluster_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(5, 3), (16, 6), (40, 2), (1, 2)])
def test_against_brute_force(spark, k, rounds):
    r = np.random.default_rng(k)
    centres = r.normal(size=(9, 6)) * 3
    rows = [(i, (centres[i % 9] + r.normal(size=6)).tolist()) for i in range(250)]
    grid = [(1000 + i, [float(x) / 64 for x in r.integers(-2, 3, 6)]) for i in range(150)]  # many ties
    rows += grid + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (2000, None), (2001, [1.0] * 5), (2002, [None] * 6), (2003, [math.nan] * 6), (2004, [math.inf] * 6), (2005, []), (2006, [-0.0] * 6)]
    assert got(spark, rows, dims=6, k=k, rounds=rounds) == brute(rows, 6, k, rounds)


def test_components_of_any_size_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=3) * 10.0 ** (i % 12)).tolist()) for i in range(60)] + [(100, [3e38, -3e38, 1e20]), (101, [1e150, 0.0, 1.0])]
    assert got(spark, rows, dims=3, k=6, rounds=3) == brute(rows, 3, 6, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert got(spark, rows, dims=2) == brute(rows, 2, 16, 3)
    assert got(spark, [(1, None)], dims=2) == [] and got(spark, [], dims=2) == []


def test_balls_scan_fewer_than_all(spark):
    r = np.random.default_rng(1)
    at = r.integers(-10_000, 10_000, (64, 2))
    x = (at[r.integers(0, 64, 2000)] + r.integers(-50, 50, (2000, 2))).astype(np.int64)
    s = centroids.Search(at.tolist())
    own, up, low, n = s.assign(x, np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros(2000))
    again, *_, m = s.assign(x, own, up, low)
    want = ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)
    assert (own == want).all() and (again == want).all() and m == 0
    drifted, *_, few = s.assign(x, own, up + 200, low - 200)
    assert (drifted == want).all() and few < 2000 * 20
