"""Amplitude statistics, spectra, conditioning and quality gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions import quantiles
from lithoframe.functions.arrays import dot
from lithoframe.functions.lineage import sized
from lithoframe.functions.numeric import clamp, mean_of, ratio
from lithoframe.operators.geometry import SURVEY, grid_size, line_to_index

# Fixed values.
REFERENCE_VELOCITY = 2000.0
SAMPLED_TRACES = 500
MIN_WAVELET_ENERGY = 1e-30
CLIP_LIMIT = 1.5
HISTOGRAM_BINS = 300
TAILS = {"p01": 0.01, "p99": 0.99}


def sample_values(traces: DataFrame, *extra: str) -> DataFrame:
    """Every sample as a double ``v`` beside the named key columns."""
    keys = ["survey_id", *extra]
    return traces.select(*keys, F.explode("samples").alias("v")).withColumn(
        "v", F.col("v").cast("double"))


def amplitude_stats(traces: DataFrame) -> DataFrame:
    """min, max, mean, population std, p01, p99 and non-zero share per survey."""
    return quantiles.summary(sample_values(traces), SURVEY, TAILS)


def section_stats(traces: DataFrame) -> DataFrame:
    """Plain statistics of each inline section."""
    return sample_values(traces, "inline").groupBy("survey_id", "inline").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"))


def evenly_spaced(traces: DataFrame, geometry: DataFrame, n: int = SAMPLED_TRACES) -> DataFrame:
    """At most n grid cells at a fixed stride over the line-by-line cell order."""
    g = sized(geometry).select(
        "survey_id", "inline_min", "inline_step", grid_size("inline").cast("long").alias("_il"),
        "crossline_min", "crossline_step", grid_size("crossline").cast("long").alias("_xl"))
    index = lambda axis, size: line_to_index(F.col(axis), F.col(f"{axis}_min"), F.col(f"{axis}_step"),
                                             F.col(size)).cast("long")
    linear = index("inline", "_il") * F.col("_xl") + index("crossline", "_xl")
    stride = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_il") * F.col("_xl") / n))
    kept = traces.join(g, SURVEY).where(
        (linear % stride == 0) & (F.floor(linear / stride) < n))
    return kept.select(*traces.columns)


def spectrum_sums(traces: DataFrame) -> DataFrame:
    """Magnitude spectra summed per survey and frequency bin; batches are summed before the shuffle."""
    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (survey, dt, n), part in batch.groupby(["survey_id", "dt_ms", "n"], dropna=False):
                size = 1 << max(0, int(n) - 1).bit_length()
                mags = np.abs(np.fft.rfft(np.stack(part["samples"]).astype("f8"), n=size, axis=1))
                yield pd.DataFrame({
                    "survey_id": survey, "bin": np.arange(mags.shape[1]),
                    "hz": np.fft.rfftfreq(size, d=dt / 1000.0), "mag": mags.sum(axis=0),
                    "traces": len(part)})

    rows = traces.select("survey_id", F.col("dt_ms").cast("double"), F.size("samples").alias("n"),
                         "samples")
    parts = rows.mapInPandas(
        transform, "survey_id string, bin int, hz double, mag double, traces long")
    return parts.groupBy("survey_id", "bin").agg(
        F.first("hz").alias("hz"), (F.sum("mag") / F.sum("traces")).alias("mag"))


def dominant_frequency(traces: DataFrame) -> DataFrame:
    """Frequency of the largest mean magnitude; the lowest bin wins a tie."""
    return spectrum_sums(traces).groupBy("survey_id").agg(
        F.max_by("hz", F.struct(F.col("mag"), -F.col("bin"))).alias("dominant_freq_hz"))


def vertical_resolution(freq: Column, velocity: float = REFERENCE_VELOCITY) -> Column:
    """A quarter wavelength, NaN without a positive frequency."""
    return F.when(freq > 0, F.lit(velocity) / (4.0 * freq)).otherwise(F.lit(float("nan")))


def nyquist(dt_ms: Column) -> Column:
    return F.lit(1000.0) / (2.0 * dt_ms)


def mean_trace(traces: DataFrame) -> DataFrame:
    """The average trace of a survey, as one array as long as a trace."""
    means = traces.select("survey_id", F.posexplode("samples").alias("s", "v")).groupBy(
        "survey_id", "s").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("survey_id").agg(
        F.sort_array(F.collect_list(F.struct("s", "v"))).alias("p")).select(
        "survey_id", F.col("p.v").alias("mean_trace"))


def wavelet_symmetry(traces: DataFrame) -> DataFrame:
    """Correlation of the mean trace with its time reverse: +1 symmetric, -1 antisymmetric."""
    x = F.col("mean_trace")
    energy = dot(x, x)
    return mean_trace(traces).select("survey_id", F.when(
        energy >= MIN_WAVELET_ENERGY, dot(x, F.reverse(x)) / energy).otherwise(
        F.lit(float("nan"))).alias("wavelet_symmetry"))


def volume_qc(traces: DataFrame, geometry: DataFrame, sidecars: DataFrame | None = None,
              velocity: float = REFERENCE_VELOCITY) -> DataFrame:
    """One quality row per survey.

    ``sidecars`` (survey_id, amplitude_stats) may hold statistics from ingest; only surveys without
    them are scanned for amplitudes. Spectrum and symmetry are means over all traces.
    """
    names = ("min", "max", "mean", "std", "p01", "p99", "nonzero_fraction")
    if sidecars is None:
        stats = amplitude_stats(traces).withColumn("sidecar_stats_used", F.lit(False))
    else:
        known = sidecars.where(F.col("amplitude_stats").isNotNull()).select(
            "survey_id", *[F.col("amplitude_stats")[n].alias(n) for n in names])
        rest = traces.join(sized(known.select("survey_id")), SURVEY, "left_anti")
        stats = known.withColumn("sidecar_stats_used", F.lit(True)).unionByName(
            amplitude_stats(rest).select("survey_id", *names)
            .withColumn("sidecar_stats_used", F.lit(False)))
    freq = F.col("dominant_freq_hz")
    return (geometry.select("survey_id", "n_inlines", "n_crosslines", "n_samples",
                            F.col("sample_rate_ms").alias("dt_ms"))
            .join(stats, SURVEY)
            .join(dominant_frequency(traces), SURVEY)
            .join(wavelet_symmetry(traces), SURVEY)
            .select("survey_id", "n_inlines", "n_crosslines", "n_samples", "dt_ms",
                    F.round("nonzero_fraction", 6).alias("nonzero_fraction"),
                    *[F.col(n).alias(f"amp_{n}") for n in names[:-1]],
                    F.round(freq, 2).alias("dominant_freq_hz"),
                    F.round(vertical_resolution(freq, velocity), 1).alias("vertical_resolution_m"),
                    F.round("wavelet_symmetry", 6).alias("wavelet_symmetry"),
                    nyquist(F.col("dt_ms")).alias("nyquist_hz"),
                    "sidecar_stats_used"))


def normalise(traces: DataFrame, p99: DataFrame, clip: bool = True) -> DataFrame:
    """Samples over the survey-wide p99, optionally clipped, beside the untouched samples."""
    scale = F.when(F.col("p99") > 0, F.col("p99")).otherwise(
        F.raise_error("p99 must be positive").cast("double"))
    bound = lambda x: clamp(x, F.lit(-CLIP_LIMIT), F.lit(CLIP_LIMIT)) if clip else x
    levels = sized(p99.select("survey_id", scale.alias("_scale")))
    return traces.join(levels, SURVEY).withColumn("samples_norm", F.transform(
        "samples", lambda x: bound(x.cast("double") / F.col("_scale")).cast("float"))).drop("_scale")


def display_clip(traces: DataFrame, q: float = 0.99) -> DataFrame:
    """Percentile of |amplitude| per inline section, 1.0 for a dead section."""
    mags = sample_values(traces, "inline").withColumn("v", F.abs("v"))
    return quantiles.exact_percentiles(mags, ["survey_id", "inline"], {"clip": q}).withColumn(
        "clip", F.when(F.col("clip") == 0, F.lit(1.0)).otherwise(F.col("clip")))


def amplitude_histogram(traces: DataFrame, tails: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins between p01 and p99, values outside clipped to the ends."""
    t = sized(tails.select("survey_id", "p01", "p99"))
    v = clamp(F.col("v"), F.col("p01"), F.col("p99"))
    width = F.col("p99") - F.col("p01")
    at = F.when(width > 0, F.least(F.floor((v - F.col("p01")) / width * bins), F.lit(bins - 1)))
    return sample_values(traces).join(t, SURVEY).groupBy(
        "survey_id", F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def section_fault_fraction(probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of samples at or above the threshold, per inline."""
    return probs.select("survey_id", "inline", F.explode("prob").alias("p")).groupBy(
        "survey_id", "inline").agg(mean_of(F.col("p") >= threshold).alias("fault_fraction"))


def run_fault_fraction(probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fault voxels over all voxels of a run, 0 for an empty run."""
    counted = probs.select(
        "survey_id", F.size("prob").alias("n"),
        F.size(F.filter("prob", lambda p: p >= threshold)).alias("hit"))
    return counted.groupBy("survey_id").agg(
        (F.sum("hit") / F.greatest(F.sum("n"), F.lit(1))).alias("fault_voxel_fraction"))


def probability_gate(probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Summary of a probability volume and its pass or fail verdict."""
    # Narrowest usable range, smallest and largest usable fault share.
    min_range, min_share, max_share = 0.05, 0.001, 0.5
    values = probs.select("survey_id", F.explode("prob").alias("v"))
    stats = quantiles.summary(values.withColumn("v", F.col("v").cast("double")), SURVEY,
                              {"p10": 0.1, "p90": 0.9})
    flat = F.col("max") - F.col("min") < min_range
    few = F.col("fault_voxel_fraction") < min_share
    many = F.col("fault_voxel_fraction") > max_share
    return stats.join(run_fault_fraction(probs, threshold), SURVEY).select(
        "survey_id", "min", "max", "mean", "p10", "p90", "fault_voxel_fraction",
        F.when(flat | few | many, "FAIL").otherwise("PASS").alias("verdict"))


def label_gate(fault_voxels: Column, total_voxels: Column) -> Column:
    """Verdict on label density."""
    share = fault_voxels / total_voxels
    # Densities below which a label volume is very sparse or sparse.
    return (F.when(fault_voxels == 0, "FAIL").when(share < 1e-4, "WARN")
            .when(share < 5e-3, "CAUTION").otherwise("PASS"))


def label_report(mask: DataFrame, baseline: DataFrame, shapes: DataFrame) -> DataFrame:
    """Voxel counts before and after densifying, their ratio and the density verdict per survey.

    ``shapes`` is (survey_id, n_inlines, n_crosslines, n_samples).
    """
    count = lambda df, name: df.groupBy("survey_id").agg(F.count("*").alias(name))
    total = F.col("n_inlines").cast("long") * F.col("n_crosslines") * F.col("n_samples")
    return (shapes.join(count(mask, "fault_voxels"), SURVEY, "left")
            .join(count(baseline, "baseline_voxels"), SURVEY, "left")
            .fillna(0, ["fault_voxels", "baseline_voxels"])
            .select("survey_id", "fault_voxels", "baseline_voxels", total.alias("total_voxels"),
                    (F.col("fault_voxels") / total).alias("fault_fraction"),
                    (F.col("fault_voxels") / F.greatest(F.col("baseline_voxels"), F.lit(1)))
                    .alias("improvement"),
                    label_gate(F.col("fault_voxels"), total).alias("verdict")))


def stick_report(picks: DataFrame, shapes: DataFrame) -> DataFrame:
    """Extent of the picks per survey and how many fall outside the volume."""
    g = sized(shapes).select("survey_id", "n_inlines", "n_crosslines", "n_samples")
    outside = F.lit(False)
    for c, n in (("il", "n_inlines"), ("xl", "n_crosslines"), ("s", "n_samples")):
        outside = outside | (F.col(c) < 0) | (F.col(c) >= F.col(n))
    per_stick = picks.join(g, SURVEY).groupBy("survey_id", "stick_id").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("il", "xl", "s") for n, f in (("min", F.min), ("max", F.max))],
        F.count("*").alias("points"), F.count_if(outside).alias("outside"))
    return per_stick.groupBy("survey_id").agg(
        F.count("*").alias("sticks"), F.sum("points").alias("points"), F.sum("outside").alias("outside"),
        *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in ("il", "xl", "s")
          for n, f in (("min", F.min), ("max", F.max))])


def ingest_summary(surveys: DataFrame) -> DataFrame:
    """The ingest line of each survey: shape, tails, synthetic flag."""
    g, a = F.col("geometry"), F.col("amplitude_stats")
    return surveys.select(
        "survey_id", "n_inlines_loaded",
        *[g[n].alias(n) for n in ("inline_min", "inline_max", "crossline_min", "crossline_max",
                                  "n_samples", "sample_rate_ms")],
        a["p01"].alias("p01"), a["p99"].alias("p99"),
        F.col("sample_mode").alias("synthetic_proxy"))
