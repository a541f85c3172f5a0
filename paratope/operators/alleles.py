"""Allele matching by the longest common substring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paratope.functions.distance import longest_common_substring
from paratope.functions.hla import two_fields
from paratope.functions.substrings import SubstringIndex
from paratope.session import BROADCAST_ROWS, fitted, settled, ship

#: The order of chains where a sequence is matched against those of all.
CHAINS = ("alpha", "beta", "heavy", "light")


def _sizes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_substring(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def common_size(a: str, b: str):
    return F.pandas_udf(_sizes, "long")(a, b)


def _preference(row) -> tuple:
    chain = row["chain"]
    return (row["status"] == "Partial", CHAINS.index(chain) if chain in CHAINS else len(CHAINS), chain or "", row["ord"])


def match_alleles(chains: DataFrame, reference: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The reference allele with the longest substring in common, for each distinct (seq, chain, species).

    reference: chain, species, name, sequence, status, ord. Of equal sizes a Full one is preferred to a Partial
    one, then the first by ord. A sequence whose chain is null is matched against all chains of its species, in
    the order of CHAINS. The reference is a table of species' alleles: up to `most` distinct ones it is indexed by its
    suffixes, once, and each sequence is looked up; beyond, pairs are compared.
    """
    spark = chains.sparkSession
    ship(spark)
    keys = ["chain", "species"]
    asked = chains.select("seq", *keys).filter("seq IS NOT NULL").distinct()
    # of alleles with one sequence only the preferred can be found
    first = F.min_by(F.struct("name", "status", "ord"), F.struct(F.when(F.col("status") == "Partial", 1).otherwise(0), "ord", "name"))
    reference = settled(reference.groupBy(*keys, "sequence").agg(first.alias("b")).select(*keys, "b.name", "sequence", "b.status", "b.ord"))
    rows = reference.limit(most + 1).collect()
    out = "seq string, chain string, species string, name string, sequence string, status string, size long"
    if len(rows) > most:
        same = (F.col("a.species") == F.col("r.species")) & (F.col("a.chain").isNull() | (F.col("a.chain") == F.col("r.chain")))
        sized = asked.alias("a").join(fitted(reference).alias("r"), same).select("a.*", "name", "sequence", "status", "ord", F.col("r.chain").alias("_chain")).withColumn("size", common_size("seq", "sequence"))
        at = F.coalesce(F.array_position(F.array(*map(F.lit, CHAINS)), F.col("_chain")), F.lit(0))
        order = F.struct(-F.col("size"), F.when(F.col("status") == "Partial", 1).otherwise(0), F.when(at == 0, len(CHAINS) + 1).otherwise(at), "_chain", "ord")
        found = sized.groupBy("seq", *keys).agg(F.min_by(F.struct("name", "sequence", "status", "size"), order).alias("b")).select("seq", *keys, "b.*")
    else:
        wanted = {(r["chain"], r["species"]) for r in asked.select(*keys).distinct().collect()}  # kinds of chains, not chains
        indexed = {}
        for chain, species in wanted:
            own = sorted((r for r in rows if r["species"] == species and chain in (None, r["chain"])), key=_preference)
            if own:
                indexed[chain, species] = SubstringIndex([r["sequence"] or "" for r in own]), [(r["name"], r["sequence"], r["status"]) for r in own]
        shared = spark.sparkContext.broadcast(indexed)  # of at most `most` alleles, five bytes a residue

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for seq, chain, species in batch[["seq", *keys]].itertuples(index=False):
                    chain = chain if isinstance(chain, str) else None
                    index, named = shared.value.get((chain, species), (None, None))
                    if index is not None:
                        size, at = index.best(seq)
                        rows.append((seq, chain, species, *named[at], size))
                yield pd.DataFrame(rows, columns=["seq", *keys, "name", "sequence", "status", "size"], dtype=object)

        # short rows with much work each: a number of parts that isn't coalesced
        found = asked.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(look_up, out)
    return found.withColumn("proportion", F.col("size") / F.length("seq"))


def with_status(names: DataFrame, statuses: DataFrame, name: str = "name") -> DataFrame:
    """names with `status`, from (Allele, Partial); a name without exactly one row raises when it is read."""
    counted = statuses.groupBy(F.col("Allele").alias(name)).agg(F.count(F.lit(1)).alias("_n"), F.first("Partial").alias("status"))
    joined = names.join(counted, name, "left")
    error = F.raise_error(F.concat(F.lit("exactly one status is needed for allele "), F.coalesce(F.col(name), F.lit("null"))))
    return joined.filter(F.when(F.coalesce("_n", F.lit(0)) != 1, error).otherwise(F.lit(True))).drop("_n")


def with_matches(df: DataFrame, reference: DataFrame, light: DataFrame) -> DataFrame:
    """Adds each MHC chain's match: mhc_n_match_seq, mhc_n_name (two fields), mhc_n_match_size, mhc_n_match_proportion, mhc_n_status, mhc_1_name_maxres and mhc_2_maxres.

    The species of the first chain chooses the alleles of both. A light chain is not matched: it has the
    species' constant from light(species, name, sequence) and no size; a chain of unknown kind is matched against
    all; a missing second chain has nulls.
    """
    kind = F.when(F.col("mhc_1_species") == "human", "human").otherwise("mouse")
    rows = df.drop("mhc_1_name", "mhc_2_name").withColumn("_species", kind)
    chains = rows.select(F.inline(F.array(*(F.struct(F.col(f"mhc_{n}_seq").alias("seq"), F.col(f"mhc_{n}_chain").alias("chain"), F.col("_species").alias("species")) for n in (1, 2)))))
    found = match_alleles(chains.filter("chain IS NULL OR chain <> 'light'"), reference)
    constant = light.select(F.lit("light").alias("_chain"), F.col("species").alias("_kind"), F.col("name").alias("_light"), F.col("sequence").alias("_light_seq"))
    for n in (1, 2):
        rest = {"name": "_match", "sequence": "_match_seq", "status": "_match_status", "size": "_match_size", "proportion": "_match_part"}
        m = found.select(F.col("seq").alias("_seq"), F.col("chain").alias("_of"), F.col("species").alias("_by"), *(F.col(k).alias(v) for k, v in rest.items()))
        same = (F.col(f"mhc_{n}_seq") == F.col("_seq")) & F.col(f"mhc_{n}_chain").eqNullSafe(F.col("_of")) & (F.col("_species") == F.col("_by"))
        rows = rows.join(m, same, "left").join(F.broadcast(constant), (F.col(f"mhc_{n}_chain") == F.col("_chain")) & (F.col("_species") == F.col("_kind")) & F.col(f"mhc_{n}_seq").isNotNull(), "left")
        name = F.coalesce("_match", "_light")
        rows = rows.withColumns({
            f"mhc_{n}_match_seq": F.coalesce("_match_seq", "_light_seq"), f"mhc_{n}_name": two_fields(name), f"mhc_{n}_match_size": F.col("_match_size"), f"mhc_{n}_match_proportion": F.col("_match_part"),
            f"mhc_{n}_status": F.when(F.col("_light").isNotNull(), "Full").otherwise(F.col("_match_status")), "mhc_1_name_maxres" if n == 1 else "mhc_2_maxres": name,
        }).drop("_seq", "_of", "_by", "_chain", "_kind", "_light", "_light_seq", *rest.values())
    return rows.drop("_species")
