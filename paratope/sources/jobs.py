"""Inference job documents and the registry of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paratope.functions.text import chain_letter
from paratope.operators.relational import numbered

DIALECT, VERSION = "alphafold3", 1


def query_only(sequence: Column) -> Column:
    """The text of an alignment that holds nothing but its query."""
    return F.concat(F.lit(">query\n"), sequence, F.lit("\n"))


def empty_protein(sequence: Column, letter: Column) -> Column:
    return F.struct(letter.alias("id"), sequence.alias("sequence"), query_only(sequence).alias("unpairedMsa"), query_only(sequence).alias("pairedMsa"), F.array().cast("array<string>").alias("templates"))


def job_document(name: Column, sequences: Column, seeds: Column) -> Column:
    """The JSON of a job whose chains are a list of sequences, lettered from A, without alignments."""
    chains = F.transform(sequences, lambda s, i: F.struct(empty_protein(s, chain_letter(i)).alias("protein")))
    return F.to_json(F.struct(name.alias("name"), seeds.alias("modelSeeds"), chains.alias("sequences"), F.lit(DIALECT).alias("dialect"), F.lit(VERSION).alias("version")))


_PROTEIN = "struct<id:string,sequence:string,unpairedMsa:string,pairedMsa:string,templates:array<struct<mmcif:string,queryIndices:array<int>,templateIndices:array<int>>>>"


def protein_of(document: Column) -> Column:
    """The protein of a stored alignment document."""
    return F.get(F.from_json(document, f"struct<sequences:array<struct<protein:{_PROTEIN}>>>")["sequences"], F.lit(0))["protein"]


def job_of_chains(name: Column, proteins: Column, seeds: Column) -> Column:
    """The JSON of a job whose chains are a list of proteins, lettered from A."""
    lettered = F.transform(proteins, lambda p, i: F.struct(F.struct(chain_letter(i).alias("id"), *(p[c].alias(c) for c in ("sequence", "unpairedMsa", "pairedMsa", "templates"))).alias("protein")))
    return F.to_json(F.struct(name.alias("name"), seeds.alias("modelSeeds"), lettered.alias("sequences"), F.lit(DIALECT).alias("dialect"), F.lit(VERSION).alias("version")))


_DOCUMENT = "struct<sequences:array<struct<protein:struct<id:string,sequence:string,unpairedMsa:string,pairedMsa:string>>>>"


def alignment_of(document: Column) -> Column:
    """struct(sequence, is_empty) of an alignment document: empty if both alignments hold the query only."""
    protein = F.get(F.from_json(document, _DOCUMENT)["sequences"], F.lit(0))["protein"]
    alone = query_only(protein["sequence"])
    return F.struct(protein["sequence"].alias("sequence"), ((protein["unpairedMsa"] == alone) & (protein["pairedMsa"] == alone)).alias("is_empty"))


def registry_name(kind: Column, sequence: Column) -> Column:
    """File name of a stored alignment: peptides by themselves, others by SHA-256."""
    return F.when(kind == "peptide", sequence).otherwise(F.sha2(sequence, 256))


def upsert(registry: DataFrame, fresh: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row a key: the newest of both; a fresh row wins a tie."""
    both = registry.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc_nulls_last(), F.desc("_fresh"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_fresh")


def exactly_one(df: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """df; a key with several rows raises when it is read, and so does a key of `wanted` without a row. With `wanted`, rows of other keys go."""
    error = lambda text: F.raise_error(F.concat(F.lit(f"a key has {text}: "), F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))))
    if wanted is not None:
        df = wanted.select(*keys).distinct().join(df.withColumn("_there", F.lit(1)), keys, "left")
        df = df.filter(F.when(F.col("_there").isNull(), error("no row")).otherwise(F.lit(True))).drop("_there")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, error("several rows")).otherwise(F.lit(True))).drop("_n")


def missing(wanted: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(registry.select(*keys), keys, "left_anti")


def batches(df: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Adds `batch`: rows numbered in order, `size` together; no task sees all rows."""
    return numbered(df, [], [F.col(c) for c in order]).withColumn("batch", F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i")
