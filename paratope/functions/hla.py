"""MHC names: resolution, partner chains, topological domains and sequence lookup."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partner chains by beta chain. Of the two partners stated for DQB1*03:01 the later one holds.
DQA_FOR = {
    "DQB1*06:02": "DQA1*01:02",
    "DQB1*02:01": "DQA1*05:01",
    "DQB1*02:02": "DQA1*02:01",
    "DQB1*05:01": "DQA1*01:01",
    "DQB1*03:02": "DQA1*03:01",
    "DQB1*03:01": "DQA1*03:02",
    "DQB1*06:03": "DQA1*01:03",
    "DQB1*03:03": "DQA1*02:01",
    "DQB1*06:04": "DQA1*01:02",
    "DQB1*04:02": "DQA1*04:01",
    "DQB1*05:03": "DQA1*01:04",
    "DQB1*05:02": "DQA1*01:02",
}
DPA_FOR = {
    "DPB1*04:01": "DPA1*01:03",
    "DPB1*01:01": "DPA1*02:01",
    "DPB1*02:01": "DPA1*01:03",
    "DPB1*04:02": "DPA1*03:01",
    "DPB1*05:01": "DPA1*02:01",
}
DRA = "DRA*01:02"
LIGHT = "B2M"
#: Human extracellular domains as (name prefix, start, stop), 0-based, the first fitting prefix holding.
HUMAN_DOMAINS = [
    ("DRB", 29, 227),
    ("DRA", 26, 216),
    ("B2M", 0, None),
    ("DQA1", 23, 216),
    ("DQA2", 23, 217),
    ("DQB1", 32, 230),
    ("DQB2", 33, 229),
    ("A", 24, 308),
    ("B", 24, 309),
    ("C", 24, 308),
    ("E", 21, 305),
    ("DPB1", 29, 225),
    ("DPA1", 28, 222),
]
#: Mouse domains by (name, chain); without bounds the sequence is taken whole.
MOUSE_DOMAINS = [
    ("H2-Db", "heavy", 24, 309),
    ("H2-Kb", "heavy", 21, 305),
    ("H2-Kd", "heavy", 21, 305),
    ("H2-Ld", "heavy", 24, 309),
    ("H2-Dd", "heavy", 24, 311),
    ("B2M", "light", 0, None),
    ("H2-IAg7", "alpha", 23, 218),
    ("H2-IAb", "alpha", 23, 218),
    ("H2-IEk", "alpha", 25, 216),
    ("H2-IAg7", "beta", 0, None),
    ("H2-IAb", "beta", 27, 226),
    ("H2-IEk", "beta", 26, 225),
]


def two_fields(name: Column) -> Column:
    """The allele name cut to two fields."""
    return F.substring_index(name, ":", 2)


def is_two_fields(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit(":"), F.lit(""))) == 1


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def infer_chains(alpha: Column, beta: Column) -> Column:
    """struct(mhc_1_name, mhc_2_name, mhc_name_inferred) of a class II pair; all null where it can't be told."""
    short_a, short_b = two_fields(alpha), two_fields(beta)
    make = lambda a, b, how: F.struct(a.alias("mhc_1_name"), b.alias("mhc_2_name"), how.alias("mhc_name_inferred"))
    none = F.lit(None).cast("string")
    nothing = make(none, none, none)
    given = F.coalesce(is_two_fields(short_a), F.lit(False))

    def by_table(table: dict[str, str]) -> Column:
        partner = F.try_element_at(_lookup(table), short_b)
        return F.when(given, make(short_a, short_b, F.lit("neither"))).when(partner.isNotNull(), make(partner, short_b, F.lit("chain_1"))).otherwise(nothing)

    full = is_two_fields(short_b)
    return (
        F.when(beta.startswith("DRB") & full, make(F.lit(DRA), short_b, F.lit("neither")))
        .when(beta.startswith("DQB") & full, by_table(DQA_FOR))
        .when(beta.startswith("DPB") & full, by_table(DPA_FOR))
        .otherwise(nothing)
    )


def _cut(seq: Column, start: int, stop: int | None) -> Column:
    return F.substring(seq, start + 1, stop - start) if stop is not None else seq


def human_domain(name: Column, seq: Column) -> Column:
    """The extracellular part of a human chain; an unknown name raises at run time."""
    rules = reduce(lambda acc, r: acc.when(name.startswith(r[0]) if r[0] != LIGHT else name == LIGHT, _cut(seq, r[1], r[2])), HUMAN_DOMAINS[1:], F.when(name.startswith(HUMAN_DOMAINS[0][0]), _cut(seq, *HUMAN_DOMAINS[0][1:])))
    return F.when(name.isNull() | seq.isNull(), None).otherwise(rules.otherwise(F.raise_error(F.concat(F.lit("no topological domain for "), name))))


def mouse_domain(name: Column, which: Column, seq: Column) -> Column:
    rules = None
    for n, c, start, stop in MOUSE_DOMAINS:
        test = (name == n) if n == LIGHT else (name == n) & (which == c)
        rules = F.when(test, _cut(seq, start, stop)) if rules is None else rules.when(test, _cut(seq, start, stop))
    return rules


def with_mouse_sequence(df: DataFrame, chains: DataFrame, name: str, which: str, out: str, top_only: bool = True) -> DataFrame:
    """Adds the sequence of a mouse chain by its name and kind, from (name, chain, sequence); unknown ones give null."""
    known = chains.select(F.col("name").alias("_name"), F.col("chain").alias("_chain"), F.col("sequence").alias("_seq"))
    joined = df.join(F.broadcast(known), (F.col(name) == F.col("_name")) & (F.col(which) == F.col("_chain")), "left")  # one row a chain of a fixed table
    return joined.withColumn(out, mouse_domain(F.col(name), F.col(which), F.col("_seq")) if top_only else F.col("_seq")).drop("_name", "_chain", "_seq")


def with_sequence(df: DataFrame, alleles: DataFrame, name: str, out: str, top_only: bool = True) -> DataFrame:
    """Adds the chain's sequence from a table (name, sequence); names without one give null. A name resolved to fewer fields than the table's takes the first full name it begins, and names that end in N aren't expressed."""
    usable = alleles.filter(~F.col("name").endswith("N")).select(F.col("name").alias("_full"), "sequence")
    keyed = usable.select(two_fields(F.col("_full")).alias("_key"), "_full", "sequence").groupBy("_key").agg(F.min_by("sequence", "_full").alias("_seq"))
    joined = df.join(keyed, two_fields(F.col(name)) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(out, human_domain(F.col(name), F.col("_seq")) if top_only else F.col("_seq")).drop("_seq")
