import math
import random

import numpy as np
import pytest

from paratope.llm import topk


def brute(rows, every, k):
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {(i, tuple(v)) for i, v in vectors if i % every == 0}:
        scored = sorted(((sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(qv)), key=lambda s: (-s[0], s[1]))
        out |= {(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])}
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS v", "3 AS rank")
    return {tuple(r) for r in topk.top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect()}


def test_equals_brute_force_with_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(8)]) for i in range(700)]
    assert got(spark, rows) == brute(rows, 50, 5)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [1.0]), (None, [9.0, 9.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (100, []), (150, [7.0])]
    assert got(spark, rows) == brute(rows, 50, 5)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0]), (3, [-3e6, 0.0])]
    assert got(spark, rows, k=2) == brute(rows, 50, 2)


def test_what_does_not_fit_raises(spark):
    assert got(spark, [(0, [1e10, 0.0]), (1, [0.0, 1e10]), (2, [-1e10, 0.5]), (3, [0.0, -5.0])], k=2) == brute([(0, [1e10, 0.0]), (1, [0.0, 1e10]), (3, [0.0, -5.0])], 50, 2)
    with pytest.raises(Exception, match="doesn't fit into 64 bits"):
        got(spark, [(0, [1e10, 1.0]), (1, [1e10, 2.0])])
    with pytest.raises(Exception, match="doesn't fit into 64 bits"):
        got(spark, [(0, [1e17, 1.0]), (1, [1.0, 2.0])])


def test_a_huge_vector_does_not_stop_the_others(spark):
    """It takes part: its scores are right where they fit, and where it isn't among the best they don't matter."""
    rows = [(i, [0.0, float(i % 7) / 4]) for i in range(120)] + [(203, [3e38, 0.0]), (201, [-1e17, 5.0]), (202, [1e30, 0.5])]
    assert got(spark, rows) == brute(rows, 50, 5)
    low = [(0, [1.0, 1.0]), *((i, [float(i), 2.0]) for i in range(1, 9)), (9, [-3e38, 1.0])]
    assert got(spark, low) == brute(low, 50, 5)


def test_far_clusters_are_not_visited(spark, monkeypatch):
    visits = []
    meet = topk._meet

    def counted(index, asked, sizes, k):
        visits.append(asked.count())
        return meet(index, asked, sizes, k)

    monkeypatch.setattr(topk, "_meet", counted)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8) / 50]) for i in range(1200)]
    assert got(spark, rows) == brute(rows, 50, 5)
    assert visits[0] == 24 and visits[1] < 24 * 11 / 2


def test_empty(spark):
    assert got(spark, []) == set()


def test_bounds_stop_the_search():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 4000
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 10)
    pivots = np.vstack([np.zeros(16), x[:31]])
    pd = topk._distances(x, pivots)
    scores, ids, done = topk.best_of(x[7], 7, pd[7], x, np.arange(4000), np.ascontiguousarray(pd.T), (x**2).sum(1), 5)
    exact = x @ x[7]
    exact[7] = -np.inf
    order = np.lexsort((np.arange(4000), -exact))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    assert done < 2000
