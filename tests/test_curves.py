import numpy as np
import pytest
from pyspark.sql import functions as F

from paratope.operators import curves, evaluation


def table(rng, groups):
    return [(g, c, bool(rng.random() < 0.4), float(rng.integers(0, kinds))) for g, c, n, kinds in groups for _ in range(n)]


def test_points_and_merged_curves_equal_the_arrays(spark):
    rng = np.random.default_rng(2)
    rows = table(rng, [("g", "a", 40, 10), ("g", "b", 25, 100), ("g", "c", 30, 3), (None, "a", 20, 8), ("h", "x", 9, 1)])
    rows += [("one", "a", True, 1.0), ("one", "a", True, 2.0), ("g", "a", None, 3.0), ("g", "a", True, None), ("g", "b", True, float("nan"))]
    df = spark.createDataFrame(rows, "k string, c string, y boolean, s double")
    points = curves.roc_points(df, ["k", "c"], F.col("y"), F.col("s")).cache()
    found = {}
    for r in points.collect():
        found.setdefault((r.k, r.c), []).append((r.place, r.threshold, r.fpr, r.tpr))
    arrays = {}
    for k, c in {(r[0], r[1]) for r in rows}:
        own = [(r[2], r[3]) for r in rows if (r[0], r[1]) == (k, c) and r[2] is not None and r[3] is not None and r[3] == r[3]]
        fpr, tpr, area = evaluation.roc_curve(np.array([int(y) for y, _ in own]), np.array([s for _, s in own]))
        arrays[k, c] = fpr, tpr
        got = sorted(found[k, c])
        if k == "one":
            assert all(p[2] is None for p in got)
            continue
        assert [p[2] for p in got] == pytest.approx(fpr.tolist()) and [p[3] for p in got] == pytest.approx(tpr.tolist())
        assert got[0][1] == float("inf") and all(a[1] > b[1] for a, b in zip(got, got[1:], strict=False))
    areas = {(r.k, r.c): r.roc_auc for r in curves.area(points, ["k", "c"]).collect()}
    assert areas["g", "a"] == pytest.approx(np.trapezoid(arrays["g", "a"][1], arrays["g", "a"][0])) and areas["one", "a"] is None
    merged = curves.merged_points(points, ["k"], "c").cache()
    for k in ("g", None, "h"):
        grid, mean, area = evaluation.merged_curves([v for (key, _), v in arrays.items() if key == k])
        got = sorted((r.fpr, r.tpr) for r in merged.collect() if r.k == k)
        assert [x for x, _ in got] == pytest.approx(grid.tolist()) and [y for _, y in got] == pytest.approx(mean.tolist())
        assert {r.k: r.roc_auc for r in curves.area(merged, ["k"]).collect()}[k] == pytest.approx(area)
    assert merged.filter("k = 'one'").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "k string, c string, y boolean, s double")
    points = curves.roc_points(none, ["k", "c"], F.col("y"), F.col("s"))
    assert points.count() == 0 and curves.merged_points(points, ["k"], "c").count() == 0
