"""Exact top-k by inner product with a pivot table.

Every vector's distances to PIVOTS pivots (drawn by a hash of their ids, the origin always among them)
are computed once. For a query q and a candidate x the largest |d(q, p) - d(x, p)| bounds d(q, x) from
below, so (|q|^2 + |x|^2 - bound^2) / 2 bounds the inner product from above. Candidates are evaluated in
the order of that bound until it falls under the k-th score found: the result is exact.

Vectors are dealt into clusters by their nearest pivot. A cluster's least and greatest distance to each
pivot bound all its scores, so a query visits the cluster of the highest bound first, and then only those
whose bound reaches its k-th score so far. Queries and candidates meet in cells: at most QUERY_BLOCK
queries (on average) against DATA_BLOCK vectors of a cluster. A cell puts out k rows a query; a window
over them merges them.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors meet vectors of their own length only; rows that repeat a query's id aren't its candidates, other
repeated rows are candidates each; queries that repeat id and vector count once; equal scores go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are
ignored. Large components are multiplied in whole numbers of any size; a score among the best that doesn't
fit into 64 bits raises, and so does a component of 2^480 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.llm.common import finished, materialize, ship, written

K = 5
SCALE = 256
EVERY = 50
PIVOTS = 32
#: Vector lengths that get pivots of their own; rarer ones have the origin only.
LENGTHS = 16
DATA_BLOCK, QUERY_BLOCK = 20_000, 1024
CHUNK = 256
#: Components of this size would have distances beyond doubles; no float has them.
LARGEST = 2.0**480
#: Stands for scores of a cell that are too low for 64 bits.
LOWEST = -(2**63)


def integer_vector(embedding: Column) -> Column:
    """floor(SCALE * x) of each component, as doubles, which hold these whole numbers exactly: large doubles are whole, and SCALE is a power of two. Null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists(embedding, lambda x: F.abs(x.cast("double")) >= LARGEST)
    error = F.raise_error(F.lit("a vector's component is too large to be squared")).cast("array<double>")
    whole = lambda y: F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y) + 0.0
    return F.when(embedding.isNull() | bad, None).when(large, error).otherwise(F.transform(embedding, lambda x: whole(x.cast("double") * SCALE)))


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _matrix(column: pa.Array | pa.ChunkedArray, n: int, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(vectors: DataFrame) -> dict[int, list[list[int]]]:
    """By vector length: at most PIVOTS - 1 vectors with the smallest hashes."""
    lengths = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    drawn = {}
    for r in lengths:
        rows = vectors.filter(F.col("dim") == r["dim"]).select(F.md5(F.concat(F.lit("pivot:"), F.col("vec_id").cast("string"))).alias("h"), "v").orderBy("h", "v").limit(PIVOTS - 1).collect()
        drawn[r["dim"]] = [list(x["v"]) for x in rows]
    return drawn


def pivot_table(vectors: DataFrame, pivots: dict[int, list[list[int]]]) -> DataFrame:
    """vec_id, dim, v, `pd`, the distances to the origin and to the pivots of its length, and `near`, the number of the nearest of these pivots (0 where there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                n, dim = part.num_rows, int(dim)
                x = _matrix(part.column(2), n, np.float64) if dim else np.zeros((n, 0))
                own = pivots.get(dim, [])
                p = np.array([[0] * dim, *own], np.float64).reshape(1 + len(own), dim)
                d = _distances(x, p)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
                near = d[:, 1:].argmin(1) if own else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), lists, pa.array(near, pa.int32())], names=["vec_id", "dim", "v", "pd", "near"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v array<double>, pd array<double>, near int")


def best_of(q: np.ndarray, q_id: int, q_pd: np.ndarray, x: np.ndarray, ids: np.ndarray, pd: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best candidates, and how many were evaluated. x holds exact numbers; pd is (pivots, n)."""
    bound = np.zeros(len(ids))
    for row, d in zip(pd, q_pd, strict=True):
        np.maximum(bound, np.abs(row - d), out=bound)
    slack = 1e-6 * (1 + q_pd[0] + np.sqrt(squares))  # of the distances' rounding
    bound = np.maximum(bound - slack, 0)
    upper = (float((q * q).sum()) + squares - bound * bound) / 2 * (1 + 1e-12) + 0.5
    upper[ids == q_id] = -np.inf
    open_ = np.flatnonzero(upper > -np.inf)
    scores, found = np.zeros(0, x.dtype), np.zeros(0, np.int64)
    done, size = 0, CHUNK
    order = open_[np.argpartition(-upper[open_], CHUNK)] if len(open_) > CHUNK else open_
    head, rest = order[:CHUNK], order[CHUNK:]
    while len(head):
        scores = np.concatenate([scores, x[head] @ q])
        found = np.concatenate([found, ids[head]])
        done += len(head)
        best = sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))[:k] if x.dtype == object else np.lexsort((found, -scores))[:k]
        scores, found = scores[best], found[best]
        if len(scores) == k and len(rest):
            rest = rest[upper[rest] >= scores[-1]]  # a bound equal to the k-th score may hide a smaller id
        if done == len(head):  # after the first chunk the survivors are put in order once
            rest = rest[np.argsort(-upper[rest], kind="stable")]
        size *= 2
        head, rest = rest[:size], rest[size:]
    return scores, found, done


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        queries, data = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and data.num_rows:
            dim = table.column("dim")[0].as_py()
            x, q = (_matrix(t.column("v"), t.num_rows, np.float64) if dim else np.zeros((t.num_rows, 0)) for t in (data, queries))
            most = float(max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)))
            if dim * most * most >= 2**62:  # else products and sums are exact in doubles or in 64 bits
                x, q = _integers(x), _integers(q)
            elif dim * most * most >= 2**53:
                x, q = x.astype(np.int64), q.astype(np.int64)
            pd, q_pd = np.ascontiguousarray(_matrix(data.column("pd"), data.num_rows, np.float64).T), _matrix(queries.column("pd"), queries.num_rows, np.float64)
            ids, q_ids = data.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            squares = (x.astype(np.float64) ** 2).sum(1)
            for i in range(len(q)):
                scores, found, _ = best_of(q[i], int(q_ids[i]), q_pd[i], x, ids, pd, squares, k)
                out["query_id"] += [int(q_ids[i])] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [max(int(s), LOWEST) for s in scores]
        if any(s >= 2**63 for s in out["score"]):  # then it, or one still higher, is among the best
            raise OverflowError("a score among the best doesn't fit into 64 bits")
        qn = pa.array(out["query_id"], pa.int64())
        return pa.table({"query_id": qn, "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def clusters(index: DataFrame) -> DataFrame:
    """One row a vector length: an array of its clusters (near, n, lo, hi), at most PIVOTS, with the least and greatest distance to each pivot."""
    ends = [F.array(*(f(F.get("pd", F.lit(i))) for i in range(PIVOTS))).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    one = index.groupBy("dim", "near").agg(F.count(F.lit(1)).alias("n"), *ends)
    return one.groupBy("dim").agg(F.collect_list(F.struct("near", "n", "lo", "hi")).alias("clusters"))


def _upper(cluster: Column) -> Column:
    """The most that a query (pd) can score with a vector of the cluster; distances and products are given their rounding."""
    at = lambda c, i: F.get(c, i)
    norm, most = F.get("pd", F.lit(0)), F.get(cluster["hi"], F.lit(0))
    apart = F.transform(F.sequence(F.lit(0), F.size("pd") - 1), lambda i: F.greatest(at(cluster["lo"], i) - at(F.col("pd"), i), at(F.col("pd"), i) - at(cluster["hi"], i)))
    bound = F.greatest(F.array_max(apart) - 1e-6 * (1 + norm + most), F.lit(0.0))
    return (norm * norm + most * most - bound * bound) / 2 + 1e-9 * (norm * norm + most * most) + 0.5


def _meet(index: DataFrame, visits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The k best candidates (query_id, vec_id, score) of each visit (vec_id, dim, v, pd, near) of a query to a cluster."""
    asked = visits.groupBy("dim", "near").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
    blocks = F.broadcast(sizes.join(asked, ["dim", "near"]).select("dim", "near", "nd", "nq"))  # one row a vector length and pivot
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["dim", "near", "db", "qb"]
    data = index.join(blocks, ["dim", "near"]).withColumn("db", block("nd")).select("*", upto("nq").alias("qb"), F.lit(False).alias("is_query"))
    queries = visits.join(blocks, ["dim", "near"]).withColumn("qb", block("nq")).select("*", upto("nd").alias("db"), F.lit(True).alias("is_query"))
    columns = [*cell, "is_query", "vec_id", "v", "pd"]
    return data.select(*columns).unionByName(queries.select(*columns)).groupBy(*cell).applyInArrow(_cell(k), "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`."""
    ship(embeddings.sparkSession)
    mark = written()
    vectors = embeddings.select(F.col("vec_id").cast("long"), integer_vector(F.col("embedding")).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    vectors = materialize(vectors.select("vec_id", F.size("v").alias("dim"), "v"), "topk-vectors")
    index = materialize(pivot_table(vectors, choose_pivots(vectors)), "topk-pivots")
    known = F.broadcast(materialize(clusters(index), "topk-clusters"))  # one row a vector length
    sizes = known.select("dim", F.inline("clusters")).select("dim", "near", F.ceil(F.col("n") / DATA_BLOCK).cast("int").alias("nd"))
    wanted = index.filter(F.col("vec_id") % every == 0).drop("near").dropDuplicates(["vec_id", "v"])
    rated = F.transform("clusters", lambda c: F.struct(_upper(c).alias("upper"), c["near"].alias("near")))
    wanted = wanted.join(known, "dim").select("vec_id", "dim", "v", "pd", rated.alias("rated")).withColumn("first", F.array_max("rated")["near"])
    wanted = materialize(wanted, "topk-queries")
    found = materialize(_meet(index, wanted.withColumnRenamed("first", "near"), sizes, k), "topk-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    others = F.filter("rated", lambda c: (c["near"] != F.col("first")) & (F.col("reached").isNull() | (c["upper"] >= F.col("reached"))))
    later = wanted.join(reached, "vec_id", "left").select("vec_id", "dim", "v", "pd", F.explode(others).alias("c")).select("vec_id", "dim", "v", "pd", "c.near")
    both = found.unionByName(_meet(index, materialize(later, "topk-visits"), sizes, k))
    fits = F.when(F.col("score") > LOWEST, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best doesn't fit into 64 bits")).cast("long"))
    ranked = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))
    return finished(ranked, "topk-result", mark)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= {K}
"""
