"""Volumes, bricks and masks on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Brick edges along inline, crossline and sample.
BRICK = (64, 64, 128)


def write_volume(traces: DataFrame, path: str, overwrite: bool = False) -> None:
    """Traces partitioned by survey and inline block, sorted by position inside.

    Ranges of inlines read few folders; the sort gives files narrow crossline statistics.
    """
    blocked = traces.withColumn("il_block", F.floor(F.col("inline") / BRICK[0]).cast("int"))
    placed = blocked.repartitionByRange("survey_id", "il_block", "crossline", "inline").sortWithinPartitions(
        "survey_id", "il_block", "crossline", "inline")
    placed.write.partitionBy("survey_id", "il_block").mode(
        "overwrite" if overwrite else "errorifexists").parquet(path)


def read_volume(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inline_range(volume: DataFrame, first: int, last: int) -> DataFrame:
    """Traces of an inclusive inline range; of a written volume only the folders of its blocks are listed and read."""
    near = volume.where(F.col("inline").between(first, last))
    return near.where(F.col("il_block").between(first // BRICK[0], last // BRICK[0])) if "il_block" in volume.columns else near


def bricks(volume: DataFrame, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """Index-space traces as brick slices: (survey_id, ib, xb, sb, il, xl, samples)."""
    n = F.ceil(F.size("samples") / brick[2]).cast("int")
    return volume.withColumn("sb", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "survey_id", F.floor(F.col("il") / brick[0]).cast("int").alias("ib"),
        F.floor(F.col("xl") / brick[1]).cast("int").alias("xb"), "sb", "il", "xl",
        F.slice("samples", F.col("sb") * brick[2] + 1, F.lit(brick[2])).alias("samples"))


def write_bricks(slices: DataFrame, path: str, overwrite: bool = False) -> None:
    """Brick slices, a folder for each brick: sections along any axis read the bricks that they cross."""
    keys = ("survey_id", "ib", "xb", "sb")
    slices.repartitionByRange(*keys).sortWithinPartitions(*keys, "il", "xl").write.partitionBy(*keys).mode("overwrite" if overwrite else "errorifexists").parquet(path)


def brick_traces(stored: DataFrame) -> DataFrame:
    """Whole traces (survey_id, il, xl, samples) from stored brick slices: the slices of a trace, joined in the order of sb."""
    slices = F.array_sort(F.collect_list(F.struct("sb", "samples")))     # as many as bricks down the trace
    return stored.groupBy("survey_id", "il", "xl").agg(slices.alias("_s")).select(
        "survey_id", "il", "xl", F.flatten(F.col("_s.samples")).alias("samples"))


def brick_section(stored: DataFrame, axis: str, k: int, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """Traces at position k of an axis (il or xl), from the bricks across it alone. A position outside gives none."""
    block, size = {"il": ("ib", brick[0]), "xl": ("xb", brick[1])}[axis]
    return brick_traces(stored.where((F.col(block) == k // size) & (F.col(axis) == k)))


def brick_time_slice(stored: DataFrame, k: int, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """Sample k of every trace (survey_id, il, xl, s, amplitude), from the bricks at that depth alone; none for a shorter trace."""
    at = F.get("samples", F.lit(k % brick[2]))
    return stored.where((F.col("sb") == k // brick[2]) & (F.size("samples") > k % brick[2])).select(
        "survey_id", "il", "xl", F.lit(k).alias("s"), at.alias("amplitude"))


def write_mask(mask: DataFrame, path: str, overwrite: bool = False) -> None:
    """A sparse mask or a probability table; an existing one is kept unless told otherwise."""
    mask.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
