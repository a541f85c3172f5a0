"""Complete linkage over a sparse graph: clusters whose members all lie within a cut of each other.

Only pairs within the cut can merge, so the graph of these edges is all that is needed: two clusters have an
edge while every pair of their members has one, and its length is the longest of them. Clusters merge along the
shortest edge; equal lengths go to the smaller names, a cluster being named by its least member. As a merged
edge is never before the edges that it comes from, pairs that are each other's first choice can merge at once.

Groups of up to SIZE edges are clustered in a task each, in rounds over arrays that merge every such pair while these
are many; larger ones in such rounds over all their edges, until what is left of them fits a task. All give the same
clusters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.operators.relational import numbered
from paratope.session import Steps, settled, ship

#: Edges that a task takes; some 100 bytes each. Those that are left to the heap, which takes four times as much.
SIZE, FEW = 2_000_000, 50_000


def sparse_linkage(n: int, edges: list[tuple[float, int, int]]) -> list[int]:
    """The least member of each member's cluster; edges are (length, i, j), i < j, those within the cut."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for d, i, j in edges:
        near[i][j] = near[j][i] = d
    heap = list(edges)
    heapify(heap)
    head = list(range(n))
    while heap:
        d, i, j = heappop(heap)
        if near[i].get(j) != d:
            continue
        x, y = near[i], near[j]
        near[i], near[j], head[j] = {}, {}, i
        for z in x.keys() | y.keys():
            if z in (i, j):
                continue
            near[z].pop(i, None)
            near[z].pop(j, None)
            if z in x and z in y:
                longest = max(x[z], y[z])
                near[i][z] = near[z][i] = longest
                heappush(heap, (longest, min(i, z), max(i, z)))
    for i in range(n):  # heads are smaller, so theirs are known
        head[i] = head[head[i]]
    return head


def merged(n: int, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """sparse_linkage of edges in arrays; of several between two members the shortest counts."""
    head = np.arange(n)
    order = np.lexsort((d, j, i))
    d, i, j = d[order], i[order], j[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(d)]
    d, i, j = d[new], i[new], j[new]
    while len(d) > FEW:
        order = np.lexsort((j, i, d))
        d, i, j = d[order], i[order], j[order]
        place = np.arange(len(d))
        first = np.full((2, n), len(d))
        for side, ends in enumerate((i, j)):
            first[side, ends[::-1]] = place[::-1]  # the last one written is the first edge
        first = first.min(0)
        pair = (first[i] == place) & (first[j] == place)
        to, times = np.arange(n, dtype=i.dtype), np.ones(n, np.int8)
        to[j[pair]], times[i[pair]], times[j[pair]] = i[pair], 2, 2
        head, size = to[head], times[i] * times[j]
        x, y = np.minimum(to[i], to[j]), np.maximum(to[i], to[j])
        order = np.lexsort((y, x))
        order = order[x[order] != y[order]]
        x, y, d, size = x[order], y[order], d[order], size[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(d)])
        if len(start):
            whole = np.diff(np.r_[start, len(d)]) == size[start]  # every pair of parts has its edge
            d, i, j = np.maximum.reduceat(d, start)[whole], x[start][whole], y[start][whole]
        else:
            d, i, j = d[:0], x[:0], y[:0]
        if 64 * np.count_nonzero(pair) < n:
            break
    return np.array(sparse_linkage(n, list(zip(d.tolist(), i.tolist(), j.tolist(), strict=True))))[head] if n else head


def _rounds(edges: DataFrame, parts: DataFrame, size: int, finish: Callable) -> DataFrame:
    """_g, member, cluster of edges (_g, a, b, dist) and parts (_g, member, cluster); finish(edges, names) clusters the groups of at most `size` edges."""
    spark, steps, done = edges.sparkSession, Steps(), []
    edges, parts = steps.put(edges), steps.put(parts)
    while True:
        large = settled(edges.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("_g"))
        few = parts.join(large, "_g", "left_anti")
        heads = finish(edges.join(large, "_g", "left_anti"), few.select("_g", F.col("cluster").alias("member")).distinct())
        done.append(settled(few.join(heads.select("_g", F.col("member").alias("cluster"), F.col("cluster").alias("_c")), ["_g", "cluster"]).select("_g", "member", F.col("_c").alias("cluster"))))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        edges, parts = edges.join(large, "_g", "left_semi"), parts.join(large, "_g", "left_semi")
        both = edges.select("_g", F.col("a").alias("x"), F.col("b").alias("y"), "dist").unionByName(edges.select("_g", F.col("b").alias("x"), F.col("a").alias("y"), "dist"))
        first = steps.put(both.groupBy("_g", "x").agg(F.min_by("y", F.struct("dist", F.least("x", "y"), F.greatest("x", "y"))).alias("y")))
        other = first.select("_g", F.col("x").alias("y"), F.col("y").alias("x"))
        pairs = steps.put(first.join(other, ["_g", "x", "y"]).filter("x < y").select("_g", F.col("x").alias("keep"), F.col("y").alias("gone")))
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, [*done, settled(parts)])
        moved = pairs.select("_g", F.col("gone").alias("old"), F.col("keep").alias("new")).unionByName(pairs.select("_g", F.col("keep").alias("old"), F.col("keep").alias("new")))
        for side in ("a", "b"):
            ends = moved.select("_g", F.col("old").alias(side), F.col("new").alias(f"_{side}"))
            edges = edges.join(ends, ["_g", side], "left")
        held = F.when(F.col("_a").isNull(), 1).otherwise(2) * F.when(F.col("_b").isNull(), 1).otherwise(2)
        named = edges.select("_g", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "dist", held.alias("size")).filter("x <> y")
        joined = named.groupBy("_g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        edges = steps.put(joined.filter("n = size").select("_g", "a", "b", "dist"))  # every pair of parts has its edge
        parts = steps.put(parts.join(pairs.withColumnRenamed("gone", "cluster"), ["_g", "cluster"], "left").select("_g", "member", F.coalesce("keep", "cluster").alias("cluster")))
        steps.turn(spark)


def clusters(edges: DataFrame, members: DataFrame, keys: list[str], cut: float = 120, member: str = "tcr_id", size: int = SIZE) -> DataFrame:
    """keys, member and cluster (from 1, by the least members' order) of each group's members; edges(keys, a, b, dist), those beyond the cut or null have no say."""
    ship(members.sparkSession)
    group = F.to_json(F.struct(*keys)).alias("_g")  # nulls are a group too
    own = settled(members.select(group, F.col(member).alias("member"), *keys).distinct())
    near = edges.filter(F.col("dist") <= cut).select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").filter("a <> b")
    near = settled(near)
    large = settled(near.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("_g"))

    def label(names: pa.Table, pairs: pa.Table) -> pa.Table:
        order = names["member"].combine_chunks()
        order = order.take(pc.sort_indices(order))
        at = [pc.index_in(pairs[c], value_set=order) for c in ("a", "b")]  # 4 bytes an edge, no objects
        held = pc.and_(*(x.is_valid() for x in at))
        i, j, d = (x.filter(held).to_numpy() for x in (*at, pairs["dist"]))
        heads = merged(len(order), d, i, j)
        return pa.table({"_g": pa.repeat(names["_g"][0], len(order)) if len(order) else names["_g"], "member": order, "cluster": order.take(pa.array(heads, pa.int64()))})

    named = own.select("_g", "member", F.col("member").alias("cluster"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    finish = lambda edges, names: names.groupBy("_g").cogroup(edges.groupBy("_g")).applyInArrow(label, fields)
    some = not large.isEmpty()
    few = own.select("_g", "member").join(large, "_g", "left_anti") if some else own.select("_g", "member")
    done = finish(near.join(large, "_g", "left_anti") if some else near, few)
    if some:
        held = named.join(large, "_g", "left_semi")
        inside = near.join(large, "_g", "left_semi")
        for side in ("a", "b"):
            inside = inside.join(held.select("_g", F.col("member").alias(side)), ["_g", side], "left_semi")
        done = done.unionByName(_rounds(inside.groupBy("_g", "a", "b").agg(F.min("dist").alias("dist")), held, size, finish))
    done = settled(done)
    heads = numbered(done.filter("member = cluster").select("_g", "cluster"), ["_g"], [F.col("cluster")], "place")
    named = own.select("_g", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    return done.join(heads, ["_g", "cluster"]).join(named, "_g").select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.col("member").alias(member), F.col("place").cast("long").alias("cluster"))
