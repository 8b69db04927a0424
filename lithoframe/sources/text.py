"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) with lines numbered from 0 in file order.

    Files stay splittable: a line's number is its rank inside its split plus the lines of earlier
    splits, and only the split totals are accumulated. Bytes that are not UTF-8 are replaced.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return raw.join(offsets, ["file", "_at"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "line")
