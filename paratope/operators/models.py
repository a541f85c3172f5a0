"""Logistic regressions of all groups at once: a Newton step is one grouped sum, so a group may be larger than a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.operators import curves
from paratope.operators.evaluation import stratified_split
from paratope.session import Steps, settled, ship

#: Largest exponent of a score.
STEEP = 500.0


def probability(x: Column, w: Column) -> Column:
    """1 / (1 + exp(-x w)) of two arrays."""
    z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-STEEP), F.least(F.lit(STEEP), z))))


def fitted_groups(df: DataFrame, keys: list[str], features: list[str], label: str, c: float = 1.0, max_iter: int = 100, tolerance: float = 1e-10, times: str | None = None) -> DataFrame:
    """keys and w, the weights of the features and last the intercept, which isn't regularised, of each group's own regression.

    Rows with a null in a feature or the label don't count; equal rows are counted together first, each as often as
    `times` says, else once. Each step sums gradient and curvature of the groups
    that haven't converged; sums are taken in tasks first. A group of one class has weights, too, which the
    penalty and max_iter hold; nulls among keys are a group.
    """
    ship(df.sparkSession)
    d = len(features) + 1
    vector = F.array(*(F.col(f).cast("double") for f in features), F.lit(1.0)).alias("x")
    count = F.sum(F.lit(1) if times is None else F.col(times)).cast("double").alias("n")
    alike = df.dropna(subset=[*features, label]).groupBy(*keys, *features, label).agg(count)
    own = settled(alike.select(F.to_json(F.struct(*keys)).alias("_g"), vector, F.col(label).cast("double").alias("y"), "n", *keys))
    named = own.select("_g", *keys).distinct()
    rows = own.select("_g", "x", "y", "n")
    penalty = np.r_[np.full(d - 1, 1 / c), 1e-12]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, moved = [], []
            for w, sums in zip(batch["w"], batch["sums"], strict=True):
                w, sums = np.array(w, float), np.array(sums, float)
                h = np.zeros((d, d))
                for (i, j), v in zip(pairs, sums[d:], strict=True):
                    h[i, j] = h[j, i] = v
                step = np.linalg.solve(h + np.diag(penalty + 1e-9), sums[:d] + penalty * w)
                out.append((w - step).tolist())
                moved.append(float(np.abs(step).max()))
            yield pd.DataFrame({"_g": batch["_g"].tolist(), "w": out, "moved": moved}, columns=["_g", "w", "moved"])

    spark, steps = df.sparkSession, Steps()
    start = F.array(*[F.lit(0.0)] * d)
    weights = steps.put(rows.select("_g").distinct().withColumns({"w": start, "moved": F.lit(float("inf"))}))
    for _ in range(max_iter):
        open_ = weights.filter(F.col("moved") >= tolerance)
        if open_.isEmpty():
            break
        met = rows.join(open_.select("_g", "w"), "_g")
        p = met.withColumn("p", probability(F.col("x"), F.col("w")))
        at = lambda i: F.col("x")[i]
        gradient = [F.sum(F.col("n") * (F.col("p") - F.col("y")) * at(i)) for i in range(d)]
        bend = [F.sum(F.col("n") * F.col("p") * (1 - F.col("p")) * at(i) * at(j)) for i, j in pairs]
        sums = p.groupBy("_g").agg(F.first("w").alias("w"), F.array(*gradient, *bend).alias("sums"))
        stepped = sums.mapInPandas(solve, "_g string, w array<double>, moved double")
        weights = steps.put(stepped.unionByName(weights.filter(F.col("moved") < tolerance)))
        steps.turn(spark)
    return named.join(weights.select("_g", "w"), "_g").drop("_g")


def within_group_points(df: DataFrame, keys: list[str], features: list[str], row_key: str, label: str = "cognate", repeats: int = 10) -> DataFrame:
    """keys, fpr, tpr: the merged curve of `repeats` fits on nine tenths of each class of a group, tested on the rest; groups with fewer than ten rows of a class are left out."""
    chosen = df.dropna(subset=[*features, label]).select(*keys, row_key, label, *features)
    parts = stratified_split(chosen.select(*keys, label, *features, row_key), [*keys, label], row_key, repeats)
    split = settled(parts.groupBy(*keys, label, *features, "iter", "is_test").agg(F.count(F.lit(1)).alias("_times")))  # equal rows have equal scores
    tests = split.filter("is_test")
    same = lambda a, b, names: reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))
    both = tests.groupBy(*keys).agg(F.count_distinct(label).alias("n")).filter("n = 2").drop("n")
    used = split.alias("s").join(both.alias("b"), same("s", "b", keys), "left_semi")
    weights = fitted_groups(used.filter("NOT is_test"), [*keys, "iter"], features, label, times="_times")
    x = F.array(*(F.col(f"t.{f}").cast("double") for f in features), F.lit(1.0))
    scored = used.filter("is_test").alias("t").join(weights.alias("w"), same("t", "w", [*keys, "iter"])).select(*(F.col(f"t.{c}") for c in [*keys, "iter", label, "_times"]), probability(x, F.col("w.w")).alias("score"))
    points = curves.roc_points(scored, [*keys, "iter"], F.col(label), F.col("score"), times=F.col("_times"))
    return curves.merged_points(points, keys, "iter")
