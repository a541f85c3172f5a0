import math
import random

import numpy as np
import pytest

from paratope.llm import centroids


def brute(rows, k, rounds, dimensions):
    """Every distance of every round."""
    import hashlib

    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [centroids.whole(x) for x in v]) for i, v in kept]
    mark = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    order = sorted(range(len(kept)), key=lambda n: (*mark(kept[n][0]), kept[n][1]))[:k]
    now = [points[n][1] for n in order]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [near(p)[1] for _, p in points]
        for j in range(len(now)):
            mine = [p for (_, p), o in zip(points, own, strict=True) if o == j]
            if mine:
                now[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *near(p)[::-1]) for i, p in points]
    by = {j: sum(d for _, c, d in out if c == j) for _, j, _ in out}
    fits = lambda n: n if n < 1 << 63 else None
    return sorted([(i, j, fits(d), fits(by[j]), fits(sum(by.values())), centroids.digest(now[j])) for i, j, d in out], key=str)


def got(spark, rows, k, rounds, dimensions):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS point")
    out = centroids.with_inertia(*centroids.cluster(df, k, rounds, dimensions))
    return sorted([tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_with_ties_and_repeats(spark, seed):
    rng = random.Random(seed)
    grid = [k / 256 for k in range(-3, 4)]  # few places: many equal distances and equal rows
    rows = [(i, [rng.choice(grid) for _ in range(3)]) for i in range(300)] + [(7, [0.0, 0.0, 0.0])] * 3
    assert got(spark, rows, 9, 5, 3) == brute(rows, 9, 5, 3)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [1.0]), (None, [9.0, 9.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (8, [])]
    assert got(spark, rows, 3, 5, 2) == brute(rows, 3, 5, 2)
    assert got(spark, rows, 40, 5, 2) == brute(rows, 40, 5, 2)
    assert got(spark, [], 3, 5, 2) == []
    assert got(spark, [(1, None)], 3, 5, 2) == []


def test_components_of_any_size(spark):
    """Distances that don't fit are null; clusters stay exact."""
    rows = [(i, [float(i % 3), 1.0 * i]) for i in range(20)] + [(20, [1e300, 1.0]), (21, [1.7e308, -1.7e308]), (22, [3e7, 3.0]), (23, [2.0**60, 5.0]), (24, [6e5, 2.0])]
    assert got(spark, rows, 4, 5, 2) == brute(rows, 4, 5, 2)


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(20, 8)) * 5
    rows = [(i, [float(x) for x in middle[i % 20] + rng.normal(size=8) / 20]) for i in range(2000)]
    out, now = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5, 8)
    measured = out.agg({"measured": "sum"}).first()[0]
    assert len(now) == 20 and measured < 2000 * 20 / 4  # of the last pass, each row's own distance among them


def test_bounds_are_safe():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 1 << 61, 10000)
    down, up = centroids._root(s, False).astype(np.longdouble), centroids._root(s, True).astype(np.longdouble)
    assert (down * down <= s).all() and (up * up >= s).all()
    wide = np.array([int(x) << 900 for x in s], object)
    assert np.isinf(centroids._root(wide, True)).all() and (centroids._root(wide, False) <= centroids.LARGEST).all()
