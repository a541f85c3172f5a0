"""Curves as tables: a row a point, so that no list of a group's rows or points is made.

points: keys, place, threshold, fpr, tpr, from (0, 0) on by falling score; place orders them where a curve rises
straight up. Groups with rows of one class only have nulls in the other's rate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roc_points(df: DataFrame, keys: list[str], label: Column, score: Column, bare: bool = True, times: Column | None = None) -> DataFrame:
    """keys, place, threshold, fpr, tpr of each group's curve; with `bare` inner points of straight lines are left out. A row counts `times`, else once. Rows without a label or score don't count."""
    rows = df.select(*keys, label.cast("int").alias("_y"), score.cast("double").alias("_s"), (F.lit(1) if times is None else times).alias("_t")).filter("_y IS NOT NULL AND _s IS NOT NULL AND NOT isnan(_s)")
    scores = rows.groupBy(*keys, "_s").agg(F.sum(F.col("_y") * F.col("_t")).alias("_p"), F.sum((1 - F.col("_y")) * F.col("_t")).alias("_n"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("_s"))
    group = Window.partitionBy(*keys)
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    counted = scores.select("*", F.sum("_p").over(upto).alias("_tp"), F.sum("_n").over(upto).alias("_fp"), F.row_number().over(falling).alias("place"), F.lead("_p").over(falling).alias("_np"), F.lead("_n").over(falling).alias("_nn"), F.sum("_p").over(group).alias("_ps"), F.sum("_n").over(group).alias("_ns"))
    if bare:
        counted = counted.filter((F.col("place") == 1) | F.col("_np").isNull() | (F.col("_np") != F.col("_p")) | (F.col("_nn") != F.col("_n")))
    rate = lambda part, all_: F.try_divide(F.col(part), F.col(all_))
    inner = counted.select(*keys, F.col("place").cast("long").alias("place"), F.col("_s").alias("threshold"), rate("_fp", "_ns").alias("fpr"), rate("_tp", "_ps").alias("tpr"))
    totals = scores.groupBy(*keys).agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    begin = totals.select(*keys, F.lit(0).cast("long").alias("place"), F.lit(float("inf")).alias("threshold"), F.when(F.col("_ns") > 0, 0.0).alias("fpr"), F.when(F.col("_ps") > 0, 0.0).alias("tpr"))
    return begin.unionByName(inner)


def merged_points(points: DataFrame, keys: list[str], curve: str) -> DataFrame:
    """keys, fpr, tpr: the mean of each group's curves on the union of their grids, between points along straight lines.

    At a rate where a curve rises straight up its last point counts; on the way there its first one.
    """
    known = points.filter("fpr IS NOT NULL AND tpr IS NOT NULL")
    knots = known.groupBy(*keys, curve, "fpr").agg(F.min_by("tpr", "place").alias("enter"), F.max_by("tpr", "place").alias("leave"))
    side = lambda df, name: df.alias(name)
    same = lambda a, b, columns: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))
    grid, curves = side(knots.select(*keys, "fpr").distinct(), "g"), side(knots.select(*keys, curve).distinct(), "c")
    full = grid.join(curves, same("g", "c", keys)).select(*(F.col(f"g.{k}").alias(k) for k in keys), F.col(f"c.{curve}").alias(curve), "g.fpr")
    placed = side(full, "f").join(side(knots, "k"), same("f", "k", [*keys, curve, "fpr"]), "left").select("f.*", "enter", "leave", F.col("k.fpr").alias("at"))
    line = Window.partitionBy(*keys, curve).orderBy("fpr")
    back, ahead = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    x0, y0 = F.last("at", True).over(back), F.last("leave", True).over(back)
    x1, y1 = F.first("at", True).over(ahead), F.first("enter", True).over(ahead)
    ends = placed.select("*", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("fpr") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = F.when(F.col("at").isNotNull(), F.col("leave")).when(F.col("x1").isNull(), F.col("y0")).when(F.col("x0").isNull(), F.col("y1")).otherwise(between)
    return ends.select(*keys, "fpr", value.alias("tpr")).groupBy(*keys, "fpr").agg(F.avg("tpr").alias("tpr"))


def area(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and roc_auc by trapezoids; null where a rate is."""
    order = ["fpr", "place"] if "place" in points.columns else ["fpr"]
    line = Window.partitionBy(*keys).orderBy(*order)
    piece = (F.col("fpr") - F.lag("fpr").over(line)) * (F.col("tpr") + F.lag("tpr").over(line)) / 2
    total = points.select(*keys, piece.alias("_a")).groupBy(*keys).agg(F.sum("_a").alias("roc_auc"))
    return total
