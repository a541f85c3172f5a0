"""Readers and writers of delimited and columnar tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paratope.schema import DOCKING_COLUMNS, DOCKING_TSV
from paratope.session import settled


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """A parquet table, a glob or a list of either; a given schema saves reading footers."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", nulls: tuple[str, ...] = ("",), comment: str | None = None, typed: bool = True) -> DataFrame:
    """A delimited file with a header. Columns are taken by the header's names; any of several texts may stand for null."""
    options = {"header": "true", "sep": separator, "multiLine": "false", "enforceSchema": "true"}
    if comment:
        options["comment"] = comment
    raw = spark.read.options(**options).csv(path)
    picked = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`") if field.name in raw.columns else F.lit(None).cast("string")
        value = F.when(value.isin(*nulls), None).otherwise(value)
        picked.append((value.try_cast(field.dataType) if typed else value).alias(field.name))
    return raw.select(*picked)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), codec: str = "zstd", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def docking_features(spark: SparkSession, jobs: DataFrame, glob: str, key: str = "job_name") -> DataFrame:
    """Docking geometry of each job from one TSV a job, named after it; jobs without a file get nulls. All files are read in one scan."""
    raw = spark.read.options(header="true", sep="\t").csv(glob)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1)
    rows = raw.select(stem.alias("_key"), *(F.col(c).try_cast(DOCKING_TSV[c].dataType).alias(c) for c in DOCKING_COLUMNS))
    first = rows.groupBy("_key").agg(*(F.first(c).alias(c) for c in DOCKING_COLUMNS))
    return jobs.join(first, F.col(key) == F.col("_key"), "left").drop("_key")


def new_only(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in `done` yet."""
    return candidates.join(done.select(key), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached_rows(asked: DataFrame, path: str, key: str, schema: T.StructType, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the asked keys from a cache of CSV files at `path`; keys that it lacks are fetched once, all together, and appended in one write.

    fetch gets the missing keys, one row each, and returns rows of `schema`; a key for which it returns none is
    asked for again the next time. Null keys have no row. A job that fails before its write is done adds nothing.
    """
    spark = asked.sparkSession
    wanted = asked.select(key).filter(F.col(key).isNotNull()).distinct()
    known = read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)
    missing = settled(new_only(wanted, known, key))
    if not missing.isEmpty():
        write_csv(fetch(missing).select(*schema.names), path, "append")
    held = read_csv(spark, path, schema) if exists(spark, path) else known
    return held.join(wanted, key, "left_semi")


def trimmed(df: DataFrame, columns: list[str], lower: bool = False) -> DataFrame:
    """Texts without white space at their ends, in lower case if wanted: a row of a sheet as a job's parameters."""
    cut = {c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "") for c in columns}
    return df.withColumns({c: F.lower(v) if lower else v for c, v in cut.items()})
