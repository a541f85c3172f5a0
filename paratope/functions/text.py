"""String and list expressions of the cleaning jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after(text: Column, mark: str) -> Column:
    """What stands between the first and second occurrence of mark (or the end); null where mark is missing."""
    return F.get(F.split(text, f"\\Q{mark}\\E"), F.lit(1))


def parts(text: Column, separator: str) -> Column:
    return F.split(text, f"\\Q{separator}\\E")


def last_parts(items: Column, separator: str = "/") -> Column:
    """Each element's last part; a null list stays null."""
    return F.transform(items, lambda x: F.element_at(F.split(x, f"\\Q{separator}\\E"), -1))


def stripped(items: Column) -> Column:
    return F.transform(items, lambda x: F.trim(x))  # F.trim itself would take the index for the characters to trim


def index_of(items: Column, value: str) -> Column:
    """0-based position; null if missing."""
    return (F.nullif(F.array_position(items, value), F.lit(0)) - 1).cast("int")


def item(items: Column, index: Column) -> Column:
    """The element at a 0-based index, null beyond the list."""
    return F.get(items, index)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def drop_through(text: Column, part: Column) -> Column:
    """The text behind the first occurrence of part; unchanged where it doesn't occur."""
    at = F.position(part, text)
    return F.when(at > 0, F.substring(text, at + F.length(part), F.length(text))).otherwise(text)


def zero_to_one(value: Column, low: Column, high: Column, rising: bool = True) -> Column:
    """Min-max scaling; a flat column gives null."""
    scaled = F.try_divide(value - low, high - low)
    return scaled if rising else 1 - scaled


def chain_letter(position: Column) -> Column:
    """A, B, ... for a 0-based position."""
    return F.char((position + 65).cast("int"))


def chain_ids(description: Column) -> Column:
    """The chain ids in a structure database's FASTA description: `...|Chain A|...` or `...|Chains A[auth B], C|...`; the author's id counts."""
    token = F.get(F.split(description, r"\|"), F.lit(1))
    listed = F.split(F.regexp_replace(token, "^Chains? ", ""), ",")
    return F.transform(listed, lambda c: F.when(F.contains(c, F.lit("[auth ")), F.regexp_extract(c, r"\[auth ([^\]]*)\]", 1)).otherwise(F.replace(c, F.lit(" "), F.lit(""))))


def instant(stamp: Column) -> Column:
    """The time of an ISO text with an offset (Z, +00:00 or +0000); a text without one is UTC where the session is."""
    return F.to_timestamp(F.regexp_replace(stamp, r"([+-]\d\d)(\d\d)$", "$1:$2"))
