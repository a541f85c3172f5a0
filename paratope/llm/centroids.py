"""Clusters by nearest centroid with Elkan's bounds.

Vectors are whole numbers, floor(SCALE * x), and so are centroids and squared distances: each comparison
that decides is exact. A row of the state table keeps its vector, its centroid, an upper bound of the
distance to it and a lower bound of the distance to each centroid, all rounded to the safe side. When
centroids move, the upper bound grows by its centroid's step and each lower bound shrinks by its own. A
centroid is skipped where its lower bound, or half its distance to the row's centroid, lies above the upper
bound; at equality it is measured, so that ties go to the smaller number.

A round reads the state and writes the next one in the shared folder (the one before is deleted); the new
centroids come from sums by centroid, added up in tasks, then in groups of tasks. The driver sees the
centroids only.

Cases: vectors that are null, of another length than DIMENSIONS or with null or non-finite components are
left out; repeated rows are vectors each; rows without an id start no centroid while others can, but are
assigned; with fewer than k vectors there are that many centroids; equal centroids keep the smaller number;
an empty table gives an empty result; extra columns are ignored. Components of any finite size are handled
exactly; a distance, or a sum of some, that doesn't fit into a long is null, and other rows are right.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.llm.common import finished, materialize, ship, written

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Components below this are added and squared in 64 bits; others in whole numbers of any size.
NARROW = 1 << 27
SLOTS = 64
LARGEST = np.float32(2.0**126)

STATE = "vec_id long, point array<int>, wide array<string>, cluster int, upper float, lower array<float>, distance long, measured int"


def usable(embedding: Column, dimensions: int) -> Column:
    """Whether a vector has that many components, all of them numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dimensions) & ~bad


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return SCALE * int(x) if abs(x) >= 2.0**52 else math.floor(SCALE * x)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "embedding").orderBy(F.col("mark").asc_nulls_last(), "embedding").limit(k).collect()
    return [[whole(x) for x in r["embedding"]] for r in rows]


def _table(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as a matrix: of 64 bits where squares of differences fit, else of Python's numbers."""
    fits = all(-NARROW < x < NARROW for r in rows for x in r)
    return np.array(rows, np.int64 if fits else object)


def squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid."""
    if x.dtype == object or centroid.dtype == object:
        x, centroid = x.astype(object), centroid.astype(object)
    d = x - centroid
    return (d * d).sum(1)


def _root(square: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as floats that are too large or too small, never the other way."""
    if square.dtype == object:
        roots = [math.isqrt(int(s)) + up for s in square]
        root = np.array([min(r, 1 << 126) for r in roots], np.float32)
        beyond = np.array([r >= 1 << 126 for r in roots], bool)
        return np.where(beyond, np.float32(np.inf) if up else LARGEST, np.nextafter(root, np.float32(np.inf if up else -np.inf), dtype=np.float32))
    return np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(np.inf if up else -np.inf), dtype=np.float32)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.nextafter(a + b, np.float32(np.inf), dtype=np.float32)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(a - np.minimum(b, LARGEST), np.float32(-np.inf), dtype=np.float32), np.float32(0))


class Centroids:
    """Centroids with what prunes: half their distances from each other, and how far each has moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, self.table = rows, _table(rows)
        k = len(rows)
        self.half = np.stack([_root(squares(self.table, c), False) for c in self.table]) * np.float32(0.5)
        self.half[np.arange(k), np.arange(k)] = np.inf
        self.nearest = self.half.min(1)
        old = _table(before or rows)
        self.step = np.array([_root(squares(old[j : j + 1], self.table[j]), True)[0] if list(old[j]) != list(self.table[j]) else 0 for j in range(k)], np.float32)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of x, bounds for the next round, exact squared distances (of all rows if final), and how many distances were measured."""
    k, n = len(centroids.rows), len(x)
    cluster = cluster.copy()
    upper = _plus(upper, centroids.step[cluster])
    lower = _less(lower, centroids.step)
    exact = np.zeros(n, x.dtype if centroids.table.dtype != object else object)
    known = np.zeros(n, bool)
    measured = 0

    def to_own(rows: np.ndarray) -> None:
        nonlocal measured
        for j in np.unique(cluster[rows]):
            at = rows[cluster[rows] == j]
            exact[at] = s = squares(x[at], centroids.table[j])
            upper[at], lower[at, j] = _root(s, True), _root(s, False)
            measured += len(at)
        known[rows] = True

    open_ = np.flatnonzero(upper >= centroids.nearest[cluster])
    for j in range(k):
        def may_win(rows: np.ndarray, j: int = j) -> np.ndarray:
            return rows[(cluster[rows] != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= centroids.half[cluster[rows], j])]

        rows = may_win(open_)
        stale = rows[~known[rows]]
        if len(stale):
            to_own(stale)
            rows = may_win(rows)
        if not len(rows):
            continue
        s = squares(x[rows], centroids.table[j])
        measured += len(rows)
        lower[rows, j] = _root(s, False)
        own = exact[rows]
        wins = ((s < own) | ((s == own) & (j < cluster[rows]))).astype(bool)
        won = rows[wins]
        cluster[won], exact[won], upper[won] = j, s[wins], _root(s[wins], True)
    if final:
        to_own(np.flatnonzero(~known))
    return cluster, upper, lower, exact, measured


def _floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _state_batch(ids: pa.Array, x: np.ndarray, cluster, upper, lower, distance: pa.Array, measured: int) -> pa.RecordBatch:
    n, wide = len(x), x.dtype == object
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(values) // max(1, n)), pa.int32()), pa.array(values, kind))
    point = pa.nulls(n, pa.list_(pa.int32())) if wide else lists(x.ravel().astype(np.int32), pa.int32())
    texts = lists([str(v) for v in x.ravel()], pa.string()) if wide else pa.nulls(n, pa.list_(pa.string()))
    counted = np.zeros(n, np.int32)
    counted[:1] = measured
    columns = [ids, point, texts, pa.array(cluster, pa.int32()), pa.array(upper, pa.float32()), lists(lower.ravel().astype(np.float32), pa.float32()), distance, pa.array(counted)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "point", "wide", "cluster", "upper", "lower", "distance", "measured"])


def _parts(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The narrow and the wide rows of a state batch, each with its matrix."""
    wide = batch.column("point").is_null()
    for part, kind in ((batch.filter(pa.compute.invert(wide)), np.int64), (batch.filter(wide), object)):
        if part.num_rows:
            values = part.column("wide").flatten().to_pylist() if kind is object else part.column("point").flatten().to_numpy()
            yield part, (np.array([int(v) for v in values], object) if kind is object else values.astype(np.int64)).reshape(part.num_rows, dimensions)


def _start(vectors: DataFrame, k: int, dimensions: int) -> DataFrame:
    """Whole numbers, and bounds that exclude nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(1)).astype(np.float64).reshape(batch.num_rows, dimensions)
            narrow = (np.abs(x) < NARROW // SCALE - 1).all(1)
            for rows, wide in ((narrow, False), (~narrow, True)):
                if rows.any():
                    own = np.array([[whole(v) for v in r] for r in x[rows].tolist()], object) if wide else np.floor(SCALE * x[rows]).astype(np.int64)
                    n = len(own)
                    yield _state_batch(batch.column(0).filter(pa.array(rows)), own, np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32), pa.nulls(n, pa.int64()), 0)

    return vectors.select("vec_id", "embedding").mapInArrow(run, STATE)


def _assigned(state: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, dimensions: int, final: bool) -> DataFrame:
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(centroids, before)
        for batch in batches:
            for part, x in _parts(batch, dimensions):
                lower = _floats(part.column("lower")).reshape(part.num_rows, k)
                cluster, upper, lower, exact, measured = assign(x, part.column("cluster").to_numpy(), part.column("upper").to_numpy(), lower, own, final)
                distance = pa.array([int(d) if d < 1 << 63 else None for d in exact], pa.int64()) if final else pa.nulls(len(x), pa.int64())
                yield _state_batch(part.column("vec_id"), x, cluster, upper, lower, distance, measured)

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors of each centroid and the exact sums of their components."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in _parts(batch, dimensions):
                cluster = part.column("cluster").to_numpy()
                for j in np.unique(cluster).tolist():
                    rows = x[cluster == j]
                    counts[j] = counts.get(j, 0) + len(rows)
                    sums[j] = sums.get(j, 0) + rows.sum(0).astype(object)
        slot = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SLOTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array([slot] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([[str(v) for v in sums[j]] for j in counts], pa.list_(pa.string()))],
            names=["cluster", "slot", "n", "sums"],
        )

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.array([int(v) for v in r], object) for r in rows["sums"])
        return pd.DataFrame({"cluster": rows["cluster"][:1].to_numpy(), "slot": [0], "n": [int(rows["n"].sum())], "sums": [[str(v) for v in total]]})

    shape = "cluster int, slot int, n long, sums array<string>"
    tasks = state.select("cluster", "point", "wide").mapInArrow(of_task, shape)
    groups = tasks.groupBy("cluster", "slot").applyInPandas(added, shape).groupBy("cluster").applyInPandas(added, shape)
    return {r["cluster"]: (r["n"], [int(v) for v in r["sums"]]) for r in groups.collect()}  # one row a centroid


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(rows of vec_id, cluster, distance (squared) and measured, the number of distances that the last pass took; the final centroids)."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding"), dimensions))
    now, before, mark = first_centroids(vectors, k, seed), None, written()
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, measured int"), []
    state = materialize(_start(vectors, len(now), dimensions), "centroids-start")
    for _ in range(rounds):
        state = finished(_assigned(state, now, before, dimensions, False), "centroids-state", mark)
        sums = _sums(state, dimensions)
        before, now = now, [[s // sums[j][0] for s in sums[j][1]] if j in sums else c for j, c in enumerate(now)]
    last = _assigned(state, now, before, dimensions, True).select("vec_id", "cluster", "distance", "measured")
    return finished(last, "centroids", mark), now


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; a sum with a distance that doesn't fit, or that doesn't fit itself, is null."""
    whole_sum = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = assigned.groupBy("cluster").agg(whole_sum.alias("s"))
    both = by_cluster.select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), "s")
    total = both.agg(F.when(F.count("s") == F.count(F.lit(1)), F.sum("s")).try_cast("long").alias("inertia"))
    digests = assigned.sparkSession.createDataFrame([(j, digest(c)) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    figures = both.drop("s").join(F.broadcast(digests), "cluster").join(F.broadcast(total), how="cross")  # one row a centroid, and one
    return assigned.drop("measured").join(F.broadcast(figures), "cluster")


def _oracle() -> str:
    def nearest(points: str, centroids: str) -> str:
        # |x - c|^2 in doubles is exact for whole numbers of this size
        d = "array_inner_product(v.x, v.x) - 2 * array_inner_product(v.x, c.x) + array_inner_product(c.x, c.x)"
        return f"SELECT v.r, v.vec_id, v.x, min(struct_pack(d := ({d})::BIGINT, j := c.j)) AS b FROM {points} v CROSS JOIN {centroids} c GROUP BY ALL"

    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE))::DOUBLE[{DIMENSIONS}] AS x FROM embeddings "
        f"WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: isfinite(e))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, embedding) - 1 AS j, x FROM v QUALIFY j < {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS MATERIALIZED ({nearest('v', f'c{i}')})")
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT j, list(floor(s / n) ORDER BY p)::DOUBLE[{DIMENSIONS}] AS x FROM (SELECT b.j AS j, p, sum(x[p]) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) t(p) GROUP BY ALL) GROUP BY j)"
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)")
    parts.append(f"z AS MATERIALIZED ({nearest('v', f'c{ROUNDS}')})")
    return (
        "WITH " + ", ".join(parts) + " SELECT vec_id, b.j::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(list_transform(c.x::DOUBLE[], lambda e: e::BIGINT), ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON c.j = b.j"
    )


ORACLE = _oracle()
