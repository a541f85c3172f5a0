"""New files only: the jobs that skip what is computed already, as streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paratope.sources.tables import exists, new_only


def process_new(spark: SparkSession, source: str, schema: T.StructType, target: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """Works on every file of `source` once, files_per_batch at a time, and appends rows whose key isn't in `target` yet; stops when nothing new is there."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        if exists(batch.sparkSession, target):  # of the target only the keys are read
            fresh = new_only(fresh, batch.sparkSession.read.parquet(target), key)
        work(fresh).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_once(spark: SparkSession, source: str, schema: T.StructType, target: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 50, time: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Works on the first row of every key in the files of `source`, by the stream's state: the target is never read.

    Keys are remembered in the state store, for ever, or with a time column for `delay` behind the latest time
    seen. Batch n is written to target/batch=n and replaces what an earlier attempt at it left, so a batch that
    is run again after a failure adds nothing, and neither does a file that comes again. A target that others
    filled before needs process_new.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
