"""Whole files: published by pattern, and trees archived in compressed form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paratope.session import ship


def copy_files(spark: SparkSession, source: str, target: str, pattern: str = "*", codec: str | None = None, again: bool = False) -> DataFrame:
    """Copies the files below `source` whose names fit the pattern to the same places below `target`, compressed by `codec` (gzip, zstd) under a longer name; files that are there already are left unless `again`. One row a file: path, size, copied. Empty files aren't listed by the reader and go.

    The executors write, each file under another name first, so both folders must be in stores that all reach. Rows are computed where they are read: collect them once.
    """
    ship(spark)
    base, suffix = target.rstrip("/"), {None: "", "gzip": ".gz", "zstd": ".zst"}[codec]
    root = source.rstrip("/").split("://", 1)[-1]
    root = "/" + root.lstrip("/") if source.startswith(("/", "file:")) else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
    relative = F.expr("substring(path, locate(:root, path) + length(:root) + 1)".replace(":root", "'" + root.replace("'", "\\'") + "'"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(base if "://" in base else "file://" + base)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{folder}/{path}{suffix}"
                fresh = again or store.get_file_info(place).type == fs.FileType.NotFound
                if fresh:
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(place + ".part", compression=codec) as out:
                        out.write(content or b"")
                    store.move(place + ".part", place)
                rows.append((path, len(content or b""), fresh))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "size", "copied"])

    return files.select(relative.alias("path"), "content").mapInArrow(run, "path string, size long, copied boolean")


def ranking_scores(spark: SparkSession, glob: str) -> DataFrame:
    """(job_name, seed, ranking_score) of HDF5 files named after their jobs, from ranking_scores/seed and ranking_scores/ranking_score. It needs the h5py library on the executors."""
    ship(spark)
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"([^/]+)\.h5$", 1).alias("job_name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import h5py

        for batch in batches:
            for job, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    seeds, scores = f["ranking_scores"]["seed"][:], f["ranking_scores"]["ranking_score"][:]
                yield pa.RecordBatch.from_arrays([pa.array([job] * len(seeds)), pa.array(seeds, pa.int32()), pa.array(scores, pa.float64())], names=["job_name", "seed", "ranking_score"])

    return files.mapInArrow(run, "job_name string, seed int, ranking_score double")
