"""Hash keys and surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paratope.schema import ANTIGEN_COLUMNS, TCR_KEY

_HASHES = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}


def hash_sequence(text: Column | str, kind: str = "md5") -> Column:
    """Hex digest of a string column."""
    if kind.lower() not in _HASHES:
        raise ValueError(f"unsupported hash {kind!r}")
    return _HASHES[kind.lower()](F.col(text) if isinstance(text, str) else text)


def with_job_name(df: DataFrame, columns: list[str], name: str = "job_name") -> DataFrame:
    """MD5 of the columns' joined texts, nulls left out, no separator."""
    return df.withColumn(name, F.md5(F.concat_ws("", *columns)))


def key_id(columns: list[str]) -> Column:
    """A 128-bit surrogate of a composite key that tells nulls and boundaries apart."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x1e")) for c in columns)))


def with_ids(df: DataFrame) -> DataFrame:
    """antigen_id and tcr_id beside a triad table with CDR columns."""
    return df.withColumns({"antigen_id": key_id(ANTIGEN_COLUMNS), "tcr_id": key_id(TCR_KEY)})


def seeded_order(seed: str, *columns: str) -> Column:
    """A pseudo-random order that any engine reproduces: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)))


def seeded_number(seed: str, *columns: str) -> Column:
    """32 bits of that order's MD5 as a number."""
    return F.conv(F.substring(seeded_order(seed, *columns), 1, 8), 16, 10).cast("long")


def epoch_days(date: Column) -> Column:
    return F.unix_date(date)
