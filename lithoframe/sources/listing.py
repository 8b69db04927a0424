"""Object listings and file fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = 4 << 20  # fixed value: bytes hashed at each end of a file


def list_objects(spark: SparkSession, path: str, container: str) -> DataFrame:
    """(container, path, size, modified) of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit(container).alias("container"), "path", F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"))


def fingerprint(files: DataFrame, small_file_once: bool = False) -> DataFrame:
    """sha256 of the first and last 4 MiB of (path, content).

    Up to 4 MiB both ends are the whole file, so it is hashed twice over unless ``small_file_once``.
    """
    size = F.length("content")
    head = F.substring("content", 1, EDGE)
    tail = F.substr("content", F.greatest(F.lit(1), size - EDGE + 1), F.lit(EDGE))
    both = F.concat(head, tail)
    data = F.when(size <= EDGE, F.col("content")).otherwise(both) if small_file_once else both
    return files.select("path", size.cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))


def fingerprint_files(files: DataFrame, edge: int = EDGE, small_file_once: bool = False) -> DataFrame:
    """The same fingerprint of the files named by ``path``, of which only the two ends are read, whatever their size."""
    from lithoframe.sources.segy import _open

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, marks = batch.column(0).to_pylist(), [], []
            for path in paths:
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    size = f.size()
                    mark = hashlib.sha256(f.read_at(min(edge, size), 0))
                    if size > edge or not small_file_once:
                        mark.update(f.read_at(min(edge, size), max(0, size - edge)))
                sizes.append(size)
                marks.append(mark.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.string())],
                                             ["path", "size", "sha256"])

    return files.select("path").mapInArrow(run, "path string, size long, sha256 string")
