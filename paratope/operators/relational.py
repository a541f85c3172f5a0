"""Joins, aggregates, windows and reshaping that the jobs share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.schema import ANTIGEN_COLUMNS
from paratope.session import settled


def with_enough(df: DataFrame, keys: list[str], positive: Column, least: int) -> DataFrame:
    """The distinct keys with at least `least` rows that are positive."""
    return df.filter(positive).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)


def cognate_threshold(triads: DataFrame, antigens: DataFrame, least: int, keys: list[str] = ANTIGEN_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to antigens with enough cognate triads."""
    valid = with_enough(triads, keys, F.col("cognate"), least)
    return triads.join(valid, keys, "left_semi"), antigens.join(valid, keys, "left_semi")


def demand(triads: DataFrame, depth: int, keys: list[str] = ANTIGEN_COLUMNS) -> DataFrame:
    return triads.groupBy(*keys).agg((F.count(F.lit(1)) * depth).alias("needed_negs"))


def corrected(df: DataFrame, key: str, corrections: dict[str, dict[str, str]]) -> DataFrame:
    """Values of a table {key: {column: value}} put in place in one pass; rows keep their order and null keys stay."""
    columns = sorted({c for values in corrections.values() for c in values})
    if not columns:
        return df
    rows = [(k, *(values.get(c) for c in columns)) for k, values in corrections.items()]
    fixes = df.sparkSession.createDataFrame(rows, ", ".join(["_key string", *(f"`_{c}` string" for c in columns)]))
    joined = df.join(F.broadcast(fixes), F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop("_key", *(f"_{c}" for c in columns))


def only_one(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key with each column's only value that isn't null; several values raise."""
    picked = [F.when(F.count_distinct(c) > 1, F.raise_error(F.lit(f"several values of {c} for a key"))).otherwise(F.min(c)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*picked)


def identity_matches(queries: DataFrame, hits: DataFrame, least: float = 95.0) -> DataFrame:
    """Structures whose chains match a query's: peptide and first MHC chain, for class II the second too; the best first.

    queries: query columns peptide, mhc_class, mhc_1_seq, mhc_2_seq; hits: query_id, pdb, per_identity. Adds
    pmhc_match, pmhc_match_id (list) and the best match's identities.
    """
    good = hits.filter(F.col("per_identity") >= least).select("query_id", "pdb", "per_identity").distinct()
    asked = queries.select("peptide", "mhc_class", "mhc_1_seq", "mhc_2_seq").distinct()

    def side(column: str, name: str) -> DataFrame:
        return good.select(F.col("query_id").alias(column), F.col("pdb"), F.col("per_identity").alias(f"pmhc_match_{name}_per_identity"))

    pair = asked.join(side("peptide", "peptide"), "peptide").join(side("mhc_1_seq", "mhc_1"), ["mhc_1_seq", "pdb"])
    two = pair.filter("mhc_class = 'II'").join(side("mhc_2_seq", "mhc_2"), ["mhc_2_seq", "pdb"])
    one = pair.filter("mhc_class <> 'II' OR mhc_class IS NULL").withColumn("pmhc_match_mhc_2_per_identity", F.lit(None).cast("double"))
    names = [f"pmhc_match_{n}_per_identity" for n in ("peptide", "mhc_1", "mhc_2")]
    keys = ["peptide", "mhc_class", "mhc_1_seq", "mhc_2_seq"]
    all_ = two.unionByName(one)
    rank = F.struct(*((-F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names), F.col("pdb"))
    best = all_.groupBy(*keys).agg(F.min_by(F.struct(*names), rank).alias("_b"), F.transform(F.sort_array(F.collect_list(rank)), lambda x: x["pdb"]).alias("pmhc_match_id"))
    same = reduce(lambda a, b: a & b, (F.col(f"q.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys))
    joined = queries.alias("q").join(best.alias("m"), same, "left")
    return joined.select("q.*", F.col("m.pmhc_match_id").isNotNull().alias("pmhc_match"), "m.pmhc_match_id", *(F.col(f"m._b.{n}").alias(n) for n in names))


def fold_join(base: DataFrame, features: list[DataFrame], key: str = "job_name") -> DataFrame:
    """Inner joins by key; a column that the left side has already is taken from there."""

    def one(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.select(key, *(c for c in right.columns if c not in left.columns)), key)

    return reduce(one, features, base)


def first_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's value in the first row of a key; nulls count as values."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def list_of(column: str, distinct: bool = False) -> Column:
    """All elements of a list column's rows in one sorted list; null lists count as empty."""
    flat = F.flatten(F.collect_list(F.coalesce(F.col(column), F.array().cast("array<string>"))))
    return F.sort_array(F.array_distinct(flat) if distinct else flat)


def first_seen(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """keys and the list of distinct values in the order in which they come first; nulls go."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))


def relaxed_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all, columns by name: types widen to what holds both, and what a side lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def by_class(df: DataFrame, kind: Column, rules: dict) -> DataFrame:
    """Columns replaced by each class's own expressions {class: {column: expression}}, in one pass; other classes stay as they are."""
    columns = sorted({c for own in rules.values() for c in own})
    chosen = {c: reduce(lambda acc, r, c=c: acc.when(kind == r[0], r[1][c]) if c in r[1] else acc, rules.items(), F.when(F.lit(False), F.col(c))).otherwise(F.col(c)) for c in columns}
    return df.withColumns(chosen)


def explode_together(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns of equal length, one row an element."""
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.arrays_zip(*columns)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def cluster_rank(df: DataFrame, group: list[str], cluster: str) -> DataFrame:
    """Adds len (the cluster's rows) and rank, from 0, smallest cluster first, equal ones by label."""
    sizes = df.groupBy(*group, cluster).agg(F.count(F.lit(1)).alias("len"))
    order = Window.partitionBy(*group).orderBy("len", cluster)
    return df.join(sizes.withColumn("rank", F.row_number().over(order) - 1), [*group, cluster])


def best_so_far(df: DataFrame, group: list[str], order: str, score: str, value: str, name: str) -> DataFrame:
    """Adds the value of the best-scored row up to each row; the earliest wins a tie."""
    run = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max_by(value, F.struct(F.col(score), -F.col(order).cast("long"))).over(run))


def islands(df: DataFrame, group: list[str], position: str, gap: int = 10, least: int = 15) -> DataFrame:
    """Runs of positions with steps of at most `gap`, gaps filled, at least `least` long: group, island, first, last."""
    order = Window.partitionBy(*group).orderBy(position)
    step = F.col(position) - F.lag(position).over(order)
    marked = df.select(*group, position).distinct().withColumn("_new", F.when(step <= gap, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*group, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= least)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "_i") -> DataFrame:
    """Adds each row's place, from 1, in an order within its key. For a few large keys: ranges of (key, order) are numbered each on its own and moved on by the counts before them, so no task sees a whole key."""
    at = [f"_order{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(at, order, strict=True))).repartitionByRange(*keys, *at)
    ranged = settled(ranged.withColumn("_part", F.spark_partition_id()))  # ranges are sampled, so they are cut once
    inner = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*at))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").alias("s")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_part"]))
    joined = ranged.withColumn("_inner", inner).alias("r").join(starts, same)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("_start") + F.col("_inner")).alias(name))


def windows_of(df: DataFrame, group: list[str], order: str, size: int = 9) -> Window:
    return Window.partitionBy(*group).orderBy(order).rowsBetween(0, size - 1)


def geometric_mean(column: Column, negative: Column | None = None) -> Column:
    """exp(mean(ln x)), 0 if any value is 0; negative values raise, or count as `negative` where it is given."""
    safe = F.when(column < 0, F.raise_error(F.lit("geometric mean of a negative value")) if negative is None else negative).when(column > 0, F.log(column))
    return F.when(F.min(column) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(safe)))


def confidence(df: DataFrame, ranges: dict[str, tuple[float, float]], higher_is_better: dict[str, bool], entity: str = "entity_id", lists: tuple[str, ...] = (), distinct_lists: tuple[str, ...] = (), first: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """One row an entity: 1 - geometric mean of each feature after scaling it by its upper bound so that 0 is best, NaN where a value is beyond its range; lists gathered, distinct lists united."""
    aggregates = [F.min_by(F.struct(*first), F.struct(*(order or first))).alias("_first")] if first else []
    aggregates += [list_of(c, distinct=True).alias(c) for c in distinct_lists]
    aggregates += [F.transform(F.collect_list(F.struct(c)), lambda x, c=c: x[c]).alias(c) for c in lists]
    for name, better in higher_is_better.items():
        scaled = F.col(name) / ranges[name][1]
        aggregates.append((1 - geometric_mean(1 - scaled if better else scaled, F.lit(float("nan")))).alias(name))
    out = df.groupBy(entity).agg(*aggregates)
    return out.select(entity, "_first.*", *(c for c in out.columns if c not in (entity, "_first"))) if first else out


def scaled(df: DataFrame, rising: dict[str, bool | None]) -> DataFrame:
    """Min-max scaling of the columns over the whole table, falling where `rising` is false; a flat column gives null. One aggregate row is joined to all."""
    bounds = df.agg(*(f(c).alias(f"_{n}_{c}") for c in rising for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))
    for c, up in rising.items():
        if up is not None:
            value = F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
            out = out.withColumn(c, value if up else 1 - value)
    return out.drop(*bounds.columns)
