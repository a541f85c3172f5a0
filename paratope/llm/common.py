"""What the operators of this subpackage share: table reading and lineage cuts in shared storage."""

from __future__ import annotations

import ctypes
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paratope.session import shared_dir, ship

__all__ = ["SPACE", "WORD", "drop_tables", "finished", "let", "lower_ascii", "materialize", "shared_dir", "ship", "table", "worker_cache", "written"]

#: Characters that separate words, as the inside of a regular expression's class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

class _Written(threading.local):
    """Paths of the tables that this thread has written and not deleted, in order."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()

_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What an operator keeps in a Python worker from task to task. Workers are shared by all operators: those before give up theirs, and freed memory goes back to the system."""
    if any(kept for other, kept in _CACHES.items() if other != name):
        for other, kept in _CACHES.items():
            if other != name:
                kept.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    return _CACHES.setdefault(name, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back, so a lost executor costs only re-reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables of this thread stand; a mark for finished() and drop_tables()."""
    return len(_WRITTEN.paths)


def finished(df: DataFrame, label: str, since: int, codec: str = "zstd") -> DataFrame:
    """df as a table; the tables written since the mark, which led to it, are deleted."""
    out = materialize(df, label, codec)
    path = _WRITTEN.paths.pop()
    drop_tables(df.sparkSession, since)
    _WRITTEN.paths.append(path)
    return out


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this thread has written since a mark; call it when no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN.paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.paths.pop())
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is evaluated once; a plain reference inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
