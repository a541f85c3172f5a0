import hashlib

import numpy as np
import pytest

from paratope.operators import curves, evaluation, models


def rows(rng):
    """Groups of different truths, one of them of a third of all rows, one of a single class, one under a null key."""
    out = []
    for g, n, slope in (("hot", 400, 2.0), ("b", 60, -1.0), (None, 50, 0.3), ("d", 40, 1.0), *((f"s{i}", 40, 0.5 * i) for i in range(14))):
        for _ in range(n):
            x, z = rng.normal(), rng.normal()
            out.append((g, len(out), bool(rng.random() < 1 / (1 + np.exp(-(slope * x - z + 0.4)))), x, z))
    return out + [("one", len(out), True, 0.5, 0.1), ("hot", -1, None, 1.0, 1.0), ("b", -2, True, None, 1.0)]


def test_all_groups_at_once_equal_single_fits(spark):
    data = rows(np.random.default_rng(1))
    df = spark.createDataFrame(data, "k string, id long, cognate boolean, u double, v double")
    found = {r.k: r.w for r in models.fitted_groups(df, ["k"], ["u", "v"], "cognate").collect()}
    for k in {r[0] for r in data} - {"one"}:
        own = [r for r in data if r[0] == k and None not in r[2:]]
        fit = evaluation.LogisticRegression().fit(np.array([r[3:] for r in own]), np.array([float(r[2]) for r in own]))
        assert found[k] == pytest.approx(fit.w.tolist(), abs=1e-7)
    assert len(found["one"]) == 3 and models.fitted_groups(df.limit(0), ["k"], ["u", "v"], "cognate").count() == 0


def test_within_group_curves(spark):
    data = rows(np.random.default_rng(2))[:560]
    df = spark.createDataFrame(data, "k string, id long, cognate boolean, u double, v double")
    found = {r.k: r.roc_auc for r in curves.area(models.within_group_points(df, ["k"], ["u", "v"], "id", repeats=3), ["k"]).collect()}
    split = evaluation.stratified_split(df, ["k", "cognate"], "id", 3).collect()
    for k in found:
        merged = []
        for i in range(3):
            side = lambda test, i=i, k=k: [r for r in split if r.k == k and r.iter == i and r.is_test is test]
            x = lambda own: np.array([[r.u, r.v] for r in own])
            fit = evaluation.LogisticRegression().fit(x(side(False)), np.array([float(r.cognate) for r in side(False)]))
            merged.append(evaluation.roc_curve(np.array([int(r.cognate) for r in side(True)]), fit.score(x(side(True))))[:2])
        assert found[k] == pytest.approx(evaluation.merged_curves(merged)[2])
    assert {"hot", "b"} <= set(found)


def test_equal_rows_are_kept_once(spark, monkeypatch):
    """What is kept for the steps and curves grows with distinct rows, with the curve of whole lists."""
    kept = []
    monkeypatch.setattr(models, "settled", lambda df, plain=models.settled: (kept.append((out := plain(df)).count()), out)[1])
    df = spark.range(4000).selectExpr("id", "id % 2 AS k", "pmod(hash(id), 3) = 0 AS cognate", "CAST(pmod(hash(id, 7), 4) AS double) AS x")
    found = models.within_group_points(df, ["k"], ["x"], "id", repeats=2).collect()
    assert {r.k for r in found} == {0, 1} and all(0 <= r.tpr <= 1 for r in found)
    assert len(kept) == 2 and max(kept) <= 2 * 2 * 4 * 2 * 2


def test_only_the_last_tests_bin_is_ordered(spark, monkeypatch):
    """A split orders the rows beside its end alone, and takes those that an order of all of them gives."""
    ordered = []
    monkeypatch.setattr(evaluation, "numbered", lambda df, *a, plain=evaluation.numbered: (ordered.append(df.count()), plain(df, *a))[1])
    df = spark.range(6000).selectExpr("id", "IF(id % 3 = 0, NULL, id % 3) AS k").unionByName(spark.createDataFrame([(-1, 7)], "id long, k long"))
    found = evaluation.stratified_split(df, ["k"], "id", 2).collect()
    assert len(found) == 2 * 6001 and sum(ordered) <= 2 * 3 * 40
    for i in range(2):
        for k in (None, 1, 2, 7):
            own = sorted((r for r in found if r.k == k and r.iter == i), key=lambda r: hashlib.md5(f"{i}|{r.id}".encode()).hexdigest())
            assert [r.is_test for r in own] == [True] * (len(own) // 10) + [False] * (len(own) - len(own) // 10)
