"""Held-out evaluation and scoring runs, read to written results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut, sized
from lithoframe.operators import metrics, patches, scoring, slices
from lithoframe.operators.geometry import grid_shape, regularise


def _region(traces: DataFrame, geometry: DataFrame, lo: int, hi: int) -> DataFrame:
    """Grid positions [lo, hi) of the inlines in index space from 0 on; a cell without a trace is zeros."""
    step = F.col("inline_step")
    part = geometry.withColumns({
        "inline_max": F.least(F.col("inline_max"), F.col("inline_min") + (hi - 1) * step), "inline_min": F.col("inline_min") + lo * step})
    return patches.to_index_space(regularise(slices.inline_index_range(traces, geometry, lo, hi), part), part)


def held_out_evaluation(traces: DataFrame, truth: DataFrame, geometry: DataFrame, patch: patches.Size,
                        start: int, end: int, predict: scoring.Predict = scoring.amplitude_logits,
                        overlap: float = scoring.OVERLAP, threshold: float = scoring.THRESHOLD) -> DataFrame:
    """Score the grid positions [start, end) of the inlines, missing traces as zeros, and compare with the truth there."""
    geometry = sized(geometry)
    volume = _region(traces, geometry, start, end)
    n = F.least(F.col("n_inlines"), F.lit(end)) - start
    shapes = sized(grid_shape(geometry).withColumn("n_inlines", n))
    probs = scoring.score_volume(volume, shapes, patch, predict, overlap)
    inside = truth.where((F.col("il") >= start) & (F.col("il") < end)).withColumn("il", F.col("il") - start)
    return metrics.evaluation_row(scoring.threshold_mask(probs, threshold), inside, shapes)


def scoring_run(traces: DataFrame, geometry: DataFrame, run_id: str, out: str, patch: patches.Size,
                inline_center: int | None = None, window: int = 16,
                predict: scoring.Predict = scoring.amplitude_logits,
                overlap: float = scoring.OVERLAP, threshold: float = scoring.THRESHOLD) -> DataFrame:
    """Score one survey, or a slab of it, and write probabilities, mask and manifest under ``out``.

    Positions are those of the grid; a cell without a trace is scored as zeros. Traces of several surveys are refused.
    The manifest row is written last: a run without one did not finish.
    """
    geometry = sized(geometry)
    surveys = geometry.limit(2).collect()
    if len(surveys) != 1:
        raise ValueError("a run scores one survey; give its traces and geometry alone")
    g, size = surveys[0], grid_shape(geometry).first()
    patch = patches.clamp_patch(patch, (size["n_inlines"], size["n_crosslines"], size["n_samples"]))
    lo, hi = 0, size["n_inlines"]
    if inline_center is not None:
        b = slices.slab_bounds(traces, geometry, inline_center, window, patch[0]).first()
        lo = (b["first"] - g["inline_min"]) // g["inline_step"]
        hi = (b["last"] - g["inline_min"]) // g["inline_step"] + 1
        lo = max(0, min(lo, hi - patch[0]))
    volume = _region(traces, geometry, lo, hi)
    shapes = sized(grid_shape(geometry).withColumn("n_inlines", F.lit(hi - lo)))
    number = lambda axis, i: F.lit(g[f"{axis}_min"]) + i * g[f"{axis}_step"]
    probs = scoring.score_volume(volume, shapes, patch, predict, overlap).select(
        F.lit(run_id).alias("run_id"), "survey_id", number("inline", F.col("il") + lo).alias("inline"),
        number("crossline", F.col("xl")).alias("crossline"), "prob")
    probs.write.mode("errorifexists").parquet(f"{out}/{run_id}/fault_probability")
    stored = traces.sparkSession.read.parquet(f"{out}/{run_id}/fault_probability")
    mask = stored.select("run_id", "survey_id", "inline", "crossline", F.posexplode("prob").alias("s", "p")).where(
        F.col("p") >= threshold).drop("p")
    mask.write.mode("errorifexists").parquet(f"{out}/{run_id}/fault_mask")
    totals = stored.agg(
        F.sum(F.size("prob")).alias("n"),
        F.sum(F.size(F.filter("prob", lambda p: p >= threshold))).alias("hit"))
    axis = lambda name, first, count: F.transform(
        F.sequence(F.lit(first), F.lit(first + count - 1)), lambda i: number(name, i))
    now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None))
    manifest = totals.select(
        F.lit(run_id).alias("run_id"), F.lit(g["survey_id"]).alias("survey_id"), F.lit("complete").alias("status"),
        F.lit(f"{out}/{run_id}/fault_probability").alias("prob_zarr_path"),
        F.lit(f"{out}/{run_id}/fault_mask").alias("mask_zarr_path"),
        (F.col("hit") / F.greatest(F.col("n"), F.lit(1))).alias("fault_voxel_fraction"),
        axis("inline", lo, hi - lo).alias("inline_coords"),
        axis("crossline", 0, size["n_crosslines"]).alias("crossline_coords"),
        F.transform(F.sequence(F.lit(0), F.lit(g["n_samples"] - 1)),
                    lambda i: F.lit(g["datum_ms"]) + i * g["sample_rate_ms"]).alias("twtt_ms"),
        now.alias("created_at"), now.alias("updated_at"), now.alias("completed_at"),
        F.lit(None).cast("string").alias("error"))
    manifest = cut(manifest)
    manifest.write.mode("append").parquet(f"{out}/runs")
    return manifest
