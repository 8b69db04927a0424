"""Sections, time slices, slabs and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized
from lithoframe.operators.geometry import SURVEY, grid_size, insertion_index
from lithoframe.sources.volume import BRICK, inline_range

CELL = ["survey_id", "inline", "crossline"]


def inline_section(traces: DataFrame, inline: int) -> DataFrame:
    """Traces of one inline; of a written volume only its block of inlines is read."""
    return inline_range(traces, inline, inline).select(*CELL, "samples")


def crossline_section(traces: DataFrame, crossline: int) -> DataFrame:
    return traces.where(F.col("crossline") == crossline).select(*CELL, "samples")


def require_rows(section: DataFrame, what: str) -> DataFrame:
    """Raise LookupError for a section that does not exist."""
    if section.isEmpty():
        raise LookupError(f"{what} not found")
    return section


def _distinct_inlines(traces: DataFrame) -> DataFrame:
    return traces.select("survey_id", F.col("inline").alias("number")).distinct()


def clamped_inline_section(traces: DataFrame, target: int) -> DataFrame:
    """The first inline at or after ``target`` in each survey, else its last inline.

    A column of samples (amplitudes, or the probabilities of a run) comes along as it is named. A table without rows
    gives none.
    """
    at = insertion_index(_distinct_inlines(traces), target).select("survey_id", F.col("number").alias("inline"))
    shown = [c for c in ("run_id", "samples", "prob") if c in traces.columns]
    return _pruned(traces, at).select(*[c for c in shown if c == "run_id"], *CELL, *[c for c in shown if c != "run_id"])


def _pruned(traces: DataFrame, lines: DataFrame) -> DataFrame:
    """Traces of (survey_id, inline) lines; of a written volume only the folders of their blocks are read."""
    keys = ["survey_id", "inline"]
    if "il_block" in traces.columns:
        lines = lines.withColumn("il_block", F.floor(F.col("inline") / BRICK[0]).cast("int"))
        keys = ["survey_id", "il_block", "inline"]
    return traces.join(sized(lines.select(*keys).distinct()), keys)


def time_slice(traces: DataFrame, k: int | None = None) -> DataFrame:
    """Sample k of every trace; by default the sample a third of the way down."""
    at = F.floor(F.size("samples") / 3).cast("int") if k is None else F.lit(k)
    return traces.select(*CELL, at.alias("s"), F.get("samples", at).alias("amplitude"))


def middle_sections(traces: DataFrame, geometry: DataFrame) -> DataFrame:
    """The middle inline and the middle crossline, tagged by ``section``.

    Middle means position n // 2 along the axis of the grid.
    """
    mid = lambda axis: (F.col(f"{axis}_min") + F.floor(grid_size(axis) / 2).cast("int")
                        * F.col(f"{axis}_step")).alias(f"_{axis}")
    at = sized(geometry).select("survey_id", mid("inline"), mid("crossline"))
    both = F.array_compact(F.array(*[
        F.when(F.col(axis) == F.col(f"_{axis}"), F.lit(axis)) for axis in ("inline", "crossline")]))
    return traces.join(at, SURVEY).where(
        (F.col("inline") == F.col("_inline")) | (F.col("crossline") == F.col("_crossline"))
    ).select(*CELL, F.explode(both).alias("section"), "samples")


def slab_bounds(traces: DataFrame, geometry: DataFrame, target: int, window: int,
                patch: int) -> DataFrame:
    """Range [lo, hi) among the existing inlines of a slab around a target line, at least one patch wide.

    ``first`` and ``last`` are the line numbers at its ends.
    """
    half = max(window, patch // 2 + 1)
    lines = _distinct_inlines(traces)
    at = lines.groupBy("survey_id").agg(  # one number per line of a survey
        F.sort_array(F.collect_set("number")).alias("_lines"),
        F.least(F.count_if(F.col("number") < target), F.count("*") - 1).alias("idx"))
    n = F.size("_lines")
    lo, hi = F.greatest(F.lit(0), F.col("idx") - half), F.least(n, F.col("idx") + half + 1)
    bounds = geometry.join(at, SURVEY).withColumns({"_lo": lo, "_hi": hi})
    narrow = F.col("_hi") - F.col("_lo") < patch
    # a slab cut short by an edge grows back from that edge
    new_lo = F.when(narrow, F.greatest(F.lit(0), F.least(F.col("_lo"), n - patch))).otherwise(F.col("_lo"))
    return bounds.withColumn("lo", new_lo.cast("int")).select(
        "survey_id", "inline_min", "inline_step", "lo",
        F.when(narrow, F.least(n, F.col("lo") + patch)).otherwise(F.col("_hi")).cast("int").alias("hi"), "_lines").select(
        "survey_id", "inline_min", "inline_step", "lo", "hi", F.get("_lines", F.col("lo")).alias("first"),
        F.get("_lines", F.col("hi") - 1).alias("last"))


def slab(traces: DataFrame, bounds: DataFrame) -> DataFrame:
    """Traces from the ``first`` to the ``last`` inline number of their survey.

    Of a written volume only the folders of the blocks in between are read.
    """
    b, keys = bounds.select("survey_id", F.col("first").alias("_first"), F.col("last").alias("_last")), SURVEY
    if "il_block" in traces.columns:
        block = lambda c: F.floor(F.col(c) / BRICK[0]).cast("int")
        b = b.where(F.col("_last") >= F.col("_first")).withColumn(
            "il_block", F.explode(F.sequence(block("_first"), block("_last"))))
        keys = ["survey_id", "il_block"]
    return traces.join(sized(b), keys).where(F.col("inline").between(F.col("_first"), F.col("_last"))).select(*traces.columns)


def inline_index_range(traces: DataFrame, geometry: DataFrame, start: int, end: int) -> DataFrame:
    """Held-out region: grid positions [start, end) of the inlines, clamped to the axis."""
    lo, hi = F.greatest(F.lit(0), F.lit(start)), F.least(grid_size("inline"), F.lit(end))
    number = lambda i: F.col("inline_min") + i * F.col("inline_step")
    return slab(traces, geometry.select("survey_id", number(lo).alias("first"), number(hi - 1).alias("last")))


def inline_number_range(traces: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive range of inline numbers; of a written volume only the folders of its blocks are read."""
    return inline_range(traces, first, last)


def overlay(traces: DataFrame, probs: DataFrame, inline: int, threshold: float = 0.5) -> DataFrame:
    """Amplitude, probability and mask of one inline of every run that covers it.

    ``probs`` is (run_id, survey_id, inline, crossline, prob). Both sides are filtered before they
    meet on (survey, crossline), and read one block where they are laid out by il_block.
    """
    seen = inline_range(probs, inline, inline).drop("il_block")
    return _overlaid(inline_section(traces, inline), seen, threshold)


def positional_overlay(traces: DataFrame, probs: DataFrame, geometry: DataFrame, position: int, threshold: float = 0.5) -> DataFrame:
    """The overlay of runs that keep no line numbers: ``inline`` and ``crossline`` of ``probs`` count from 0 along the grid.

    The rows come back with line numbers. A position beyond the grid, or without a trace, gives none.
    """
    at = sized(geometry.where(F.lit(position).between(0, grid_size("inline") - 1)).select(
        "survey_id", (F.col("inline_min") + position * F.col("inline_step")).cast("int").alias("_inline"), "crossline_min", "crossline_step"))
    seen = inline_range(probs, position, position).join(at, SURVEY).select(
        "run_id", "survey_id", F.col("_inline").alias("inline"),
        (F.col("crossline_min") + F.col("crossline") * F.col("crossline_step")).cast("int").alias("crossline"), "prob")
    lines = at.select("survey_id", F.col("_inline").alias("inline"))
    return _overlaid(_pruned(traces, lines).select(*CELL, "samples"), seen, threshold)


def _overlaid(section: DataFrame, seen: DataFrame, threshold: float) -> DataFrame:
    return section.join(seen, CELL).select(
        "run_id", *CELL, "samples", "prob",
        F.transform("prob", lambda p: (p >= threshold).cast("int")).alias("mask"))


def require_in_run(runs: DataFrame, run_id: str, inline: int, n_inlines: int | None = None) -> None:
    """Raise LookupError, naming the window, when a run does not hold the inline.

    For a run without line numbers ``inline`` is a position, and held against ``n_inlines`` where that is given.
    """
    row = runs.where(F.col("run_id") == run_id).select(
        F.array_contains("inline_coords", inline).alias("held"),
        F.array_min("inline_coords").alias("lo"), F.array_max("inline_coords").alias("hi")).first()
    if row is None:
        raise LookupError(f"run {run_id} not found")
    if row["held"] is False and row["lo"] is not None:
        raise LookupError(f"inline {inline} is outside the run window [{row['lo']}, {row['hi']}]")
    if row["lo"] is None and n_inlines is not None and not 0 <= inline < n_inlines:
        raise LookupError(f"position {inline} is outside the {n_inlines} inlines of the run")


def stick_crossings(picks: DataFrame, inline: int) -> DataFrame:
    """Pick points lying on an inline, as (crossline, twt)."""
    return picks.where(F.col("inline") == inline).select("stick_id", "crossline", "twt")


def first_inline_samples(traces: DataFrame, n: int = 100) -> DataFrame:
    """The first n samples, in grid order, on the lowest inline of (survey_id, inline, crossline, samples) traces.

    The line is found on headers; only its traces are opened into samples.
    """
    lowest = traces.agg(F.min("inline").alias("inline"))
    return voxels(traces.join(F.broadcast(lowest), "inline")).orderBy(  # one row
        "survey_id", "crossline", "s").limit(n)


def voxels(traces: DataFrame) -> DataFrame:
    """Long form: one row per sample."""
    return traces.select(*CELL, F.posexplode("samples").alias("s", "amplitude"))
