"""FASTA in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, record (0-based), description and sequence, the lines of a record joined. Files are split at record starts, so records are never cut."""
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head, rest = F.substring_index(body, "\n", 1), F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, "^[^\n]*\n", "")).otherwise("")
    rows = blocks.select("file", "start", "at", F.trim(head).alias("description"), F.regexp_replace(rest, r"[\s>]", "").alias("sequence")).filter("description <> '' OR sequence <> ''")
    return rows.select("file", "at", "description", "sequence")


def allele_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of an allele FASTA whose second token is the name; names that end in N aren't expressed and are left out."""
    name = F.get(F.split("description", r"\s+"), F.lit(1))
    return read_fasta(spark, path).select(name.alias("name"), "sequence").filter(~F.col("name").endswith("N"))


def allele_reference(spark: SparkSession, files: dict[str, list[str]], statuses: DataFrame, species: str = "human") -> DataFrame:
    """The alleles of FASTA files by chain as a reference of matching: chain, species, name, sequence, status, ord (the files' and records' order). statuses(Allele, Partial) has one row an allele."""
    from paratope.operators.alleles import with_status

    parts = []
    for i, (chain, path) in enumerate((c, p) for c, paths in files.items() for p in paths):
        named = read_fasta(spark, path).select(F.get(F.split("description", r"\s+"), F.lit(1)).alias("name"), "sequence", "at").filter(~F.col("name").endswith("N"))
        parts.append(named.select(F.lit(chain).alias("chain"), F.lit(species).alias("species"), "name", "sequence", F.struct(F.lit(i).alias("file"), "at").alias("ord")))
    return with_status(reduce(lambda a, b: a.unionByName(b), parts), statuses).select("chain", "species", "name", "sequence", "status", "ord")


def fasta_text(sequences: Column) -> Column:
    """A FASTA text of a list of sequences with headers 1, 2, ..."""
    return F.concat(F.array_join(F.transform(sequences, lambda s, i: F.concat(F.lit(">"), (i + 1).cast("string"), F.lit("\n"), s)), "\n"), F.lit("\n"))


def write_fasta(df: DataFrame, sequences: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.rtrim(fasta_text(F.col(sequences))).alias("value")).write.mode(mode).text(path)
