import random

import numpy as np
import pytest

from paratope.functions import distance
from paratope.operators import linkage


def drawn(rng, n, places):
    """Pairs within reach of points on a line of few places: many equal lengths, and of points in a plane: none."""
    if places:
        x = np.array([[rng.randrange(places), rng.randrange(3)] for _ in range(n)], float)
    else:
        x = np.array([[rng.random() * 6, rng.random() * 6] for _ in range(n)])
    return np.abs(x[:, None] - x[None]).sum(-1)


def taking_turns(d, cut):
    """The shortest edge first, of equal ones that of the smaller heads; all pairs of a merged cluster must lie within the cut."""
    n = len(d)
    head = list(range(n))
    while True:
        open_ = []
        for i in sorted(set(head)):
            for j in sorted(set(head)):
                if i < j:
                    longest = max(d[x, y] for x in range(n) if head[x] == i for y in range(n) if head[y] == j)
                    if longest <= cut:
                        open_.append((longest, i, j))
        if not open_:
            return head
        _, i, j = min(open_)
        head = [i if h == j else h for h in head]


@pytest.mark.parametrize("places", [0, 5, 9])
def test_sparse_linkage_equals_taking_turns(places):
    rng = random.Random(places)
    for n in (1, 2, 7, 18):
        for cut in (1.0, 2.0, 3.0):
            d = drawn(rng, n, places)
            edges = [(d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= cut]
            assert linkage.sparse_linkage(n, edges) == taking_turns(d, cut)
            if not places:
                labels = {}
                assert [labels.setdefault(h, len(labels) + 1) for h in linkage.sparse_linkage(n, edges)] == distance.complete_linkage(d, cut).tolist()


def test_rounds_equal_tasks(spark):
    """Groups of more members than a task takes are merged in rounds, with the same clusters; null keys and lonely members too."""
    rng = random.Random(3)
    members, edges = [], []
    for g, n, places in (("a", 30, 4), ("b", 25, 0), (None, 12, 3), ("c", 1, 0)):
        d = drawn(rng, n, places)
        members += [(g, f"m{i:03}") for i in range(n)]
        edges += [(g, f"m{i:03}", f"m{j:03}", float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    edges += [("a", "m000", "m000", 0.0), ("zz", "m000", "m001", 0.5), ("a", "m001", "m002", None)]
    df = spark.createDataFrame(members + members[:4], "k string, tcr_id string"), spark.createDataFrame(edges, "k string, a string, b string, dist double")
    one, many = (sorted(map(tuple, linkage.clusters(df[1], df[0], ["k"], 2.0, size=size).collect()), key=str) for size in (100, 2))
    assert one == many and len(one) == len(members)
    assert sum(c > 1 for _, _, c in one) > 5 and max(sum(x[0] == "a" and x[2] == c for x in one) for c in range(1, 31)) > 2


def test_empty(spark):
    none = spark.createDataFrame([], "k string, a string, b string, dist double")
    assert linkage.clusters(none, spark.createDataFrame([], "k string, tcr_id string"), ["k"]).count() == 0
    assert [tuple(r) for r in linkage.clusters(none, spark.createDataFrame([("g", "x")], "k string, tcr_id string"), ["k"]).collect()] == [("g", "x", 1)]


def test_edges_are_labelled_without_objects(spark, monkeypatch):
    """A group's edges reach the clustering as four-byte numbers, for names of any kind; unknown names have no say."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda *a: 1 / 0)
    for kind, name in (("long", int), ("string", "é{:03}".format)):
        members = spark.createDataFrame([(k, name(m)) for k in ("g", None) for m in range(6)] + [("h", name(1))], f"k string, tcr_id {kind}")
        edges = spark.createDataFrame([(k, name(a), name(b), 1.0) for k in ("g", None, "h") for a, b in ((0, 1), (2, 4), (4, 5), (2, 5), (3, 9))], f"k string, a {kind}, b {kind}, dist double")
        found = {(r.k, r.tcr_id): r.cluster for r in linkage.clusters(edges, members, ["k"], 1.2).collect()}
        assert found == {(k, name(m)): c for k in ("g", None) for m, c in enumerate([1, 1, 2, 3, 2, 2])} | {("h", name(1)): 1}
