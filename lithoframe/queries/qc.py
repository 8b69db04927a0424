"""Amplitude statistics and quality control queries."""

import uuid

from pyspark.sql import functions as F

from lithoframe.functions.arrays import total
from lithoframe.functions.lineage import checkpoint_dir
from lithoframe.operators import qc as a
from lithoframe.operators.geometry import infer_geometry
from lithoframe.queries import query
from lithoframe.queries.tables import (
    IRREGULAR, PICKS, PROBS, SHAPE, TRACES, irregular_traces, picks, probs, q6, r6, shapes, traces,
)

_VOX = """,
  vox AS (SELECT survey_id, inline, CAST(samples[t.s + 1] AS DOUBLE) AS a, CAST(t.s AS INTEGER) AS s
          FROM traces, unnest(range(len(samples))) AS t(s))"""
_STATS = f"""min(a) AS min, max(a) AS max, {q6("avg(a)")} AS mean, {q6("stddev_pop(a)")} AS std,
         {q6("quantile_cont(a, 0.01)")} AS p01, {q6("quantile_cont(a, 0.99)")} AS p99,
         {q6("avg(CAST(a <> 0 AS INTEGER))")} AS nonzero_fraction"""


@query("a1_amplitude_stats", f"WITH {IRREGULAR} {_VOX} SELECT survey_id, count(*) AS n, {_STATS} FROM vox GROUP BY survey_id")
def a1(spark, sf):
    return a.amplitude_stats(irregular_traces(spark, sf)).select("survey_id", "n", "min", "max",
        *[r6(F.col(c)).alias(c) for c in ("mean", "std", "p01", "p99", "nonzero_fraction")])


@query("a2_section_stats", f"""WITH {TRACES}
  SELECT inline, min(a) AS min, max(a) AS max, {q6("avg(a)")} AS mean, {q6("stddev_pop(a)")} AS std
  FROM voxels GROUP BY inline""")
def a2(spark, sf):
    return a.section_stats(traces(spark, sf)).select(
        "inline", "min", "max", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


_PICKED = """,
  idx AS (SELECT t.*, (inline - il0) * n_xl + crossline - xl0 AS i, greatest(1, n_il * n_xl // 500) AS stride
          FROM traces t, geom),
  picked AS (SELECT * FROM idx WHERE i % stride = 0 AND i // stride < 500)"""
_ALL = ", picked AS (SELECT * FROM traces)"
_SPECTRUM = """,
  dft AS (
    SELECT trace_no, b.k, sqrt(pow(sum(x * cos(2 * pi() * b.k * s / 64)), 2) + pow(sum(x * sin(2 * pi() * b.k * s / 64)), 2)) AS mag
    FROM (SELECT trace_no, t.s, CAST(samples[t.s + 1] AS DOUBLE) AS x FROM picked, unnest(range(64)) AS t(s)),
         unnest(range(33)) AS b(k)
    GROUP BY trace_no, b.k),
  peak AS (SELECT k * 1000.0 / (64 * 4.0) AS hz FROM (SELECT k, avg(mag) AS m FROM dft GROUP BY k) ORDER BY m DESC, k LIMIT 1)"""
_SYMMETRY = """,
  mt AS (SELECT t.s, avg(CAST(samples[t.s + 1] AS DOUBLE)) AS x FROM picked, unnest(range(64)) AS t(s) GROUP BY t.s),
  sym AS (SELECT sum(l.x * r.x) / sum(l.x * l.x) AS c FROM mt l JOIN mt r ON r.s = 63 - l.s)"""


@query("a3_volume_qc", f"""WITH {TRACES} {_ALL} {_SPECTRUM} {_SYMMETRY}
  SELECT 'survey_0' AS survey_id, min(a) AS amp_min, max(a) AS amp_max, {q6("avg(a)")} AS amp_mean,
         {q6("stddev_pop(a)")} AS amp_std, {q6("quantile_cont(a, 0.01)")} AS amp_p01,
         {q6("quantile_cont(a, 0.99)")} AS amp_p99, {q6("avg(CAST(a <> 0 AS INTEGER))")} AS nonzero_fraction,
         CAST(4.0 AS DOUBLE) AS dt_ms, {q6("any_value(hz)", 2)} AS dominant_freq_hz,
         {q6("2000.0 / (4.0 * any_value(hz))", 1)} AS vertical_resolution_m,
         {q6("any_value(c)")} AS wavelet_symmetry, CAST(125.0 AS DOUBLE) AS nyquist_hz, false AS sidecar_stats_used
  FROM voxels, peak, sym""")
def a3(spark, sf):
    t = traces(spark, sf)
    return a.volume_qc(t, infer_geometry(t)).select(
        "survey_id", "amp_min", "amp_max",
        *[r6(F.col(c)).alias(c) for c in ("amp_mean", "amp_std", "amp_p01", "amp_p99")],
        "nonzero_fraction", "dt_ms", "dominant_freq_hz", "vertical_resolution_m", "wavelet_symmetry",
        "nyquist_hz", "sidecar_stats_used")


@query("a4_evenly_spaced_traces", f"""WITH {TRACES} {_PICKED} SELECT trace_no FROM picked""")
def a4(spark, sf):
    t = traces(spark, sf)
    return a.evenly_spaced(t, infer_geometry(t)).select("trace_no")


@query("a5_dominant_frequency", f"""WITH {TRACES} {_ALL} {_SPECTRUM}
  SELECT 'survey_0' AS survey_id, {q6("hz")} AS dominant_freq_hz FROM peak""")
def a5(spark, sf):
    return a.dominant_frequency(traces(spark, sf))


@query("a5_mean_spectrum", f"""WITH {TRACES}, picked AS (SELECT * FROM traces) {_SPECTRUM}
  SELECT CAST(k AS INTEGER) AS bin, {q6("k * 1000.0 / 256.0")} AS hz, {q6("avg(mag)", 5)} AS mag FROM dft GROUP BY k""")
def a5_spectrum(spark, sf):
    return a.spectrum_sums(traces(spark, sf)).select(
        "bin", r6(F.col("hz")).alias("hz"), r6(F.col("mag"), 5).alias("mag"))


@query("a6_vertical_resolution", f"""WITH {TRACES} {_ALL} {_SPECTRUM}
  SELECT 'survey_0' AS survey_id, {q6("2000.0 / (4.0 * hz)")} AS vertical_resolution_m FROM peak""")
def a6(spark, sf):
    return a5(spark, sf).select(
        "survey_id", r6(a.vertical_resolution(F.col("dominant_freq_hz"))).alias("vertical_resolution_m"))


@query("a7_wavelet_symmetry", f"""WITH {TRACES} {_ALL} {_SYMMETRY}
  SELECT 'survey_0' AS survey_id, {q6("c")} AS wavelet_symmetry FROM sym""")
def a7(spark, sf):
    return a.wavelet_symmetry(traces(spark, sf)).select(
        "survey_id", r6(F.col("wavelet_symmetry")).alias("wavelet_symmetry"))


@query("a8_nyquist", f"WITH {TRACES} SELECT DISTINCT survey_id, CAST(1000.0 / (2 * 4.0) AS DOUBLE) AS nyquist_hz FROM traces")
def a8(spark, sf):
    return traces(spark, sf).select("survey_id", a.nyquist(F.col("dt_ms")).alias("nyquist_hz")).distinct()


_P99 = ", lim AS (SELECT quantile_cont(a, 0.01) AS p01, quantile_cont(a, 0.99) AS p99 FROM voxels)"


def _tails(t):
    from lithoframe.functions.quantiles import exact_percentiles
    return exact_percentiles(a.sample_values(t), ["survey_id"], a.TAILS)


@query("a9_global_normalise", f"""WITH {TRACES} {_P99}
  SELECT inline, crossline, s, {q6("CAST(greatest(-1.5, least(1.5, a / p99)) AS FLOAT)", 5)} AS v FROM voxels, lim""")
def a9(spark, sf):
    t = traces(spark, sf)
    return a.normalise(t, _tails(t)).select(
        "inline", "crossline", F.posexplode("samples_norm").alias("s", "v")).withColumn(
        "v", r6(F.col("v").cast("double"), 5))


@query("a10_condition_volume", f"""WITH {TRACES} {_P99}
  SELECT inline, crossline, {q6("sum(a)")} AS raw_sum,
         {q6("sum(CAST(CAST(greatest(-1.5, least(1.5, a / p99)) AS FLOAT) AS DOUBLE))", 4)} AS norm_sum
  FROM voxels, lim GROUP BY inline, crossline""")
def a10(spark, sf):
    from lithoframe.plans.condition import condition_volume
    out = f"{checkpoint_dir(spark)}/conditioned-{uuid.uuid4().hex}"
    condition_volume(traces(spark, sf), out)
    return spark.read.parquet(out).select(
        "inline", "crossline", r6(total(F.col("samples"))).alias("raw_sum"),
        r6(total(F.col("samples_norm")), 4).alias("norm_sum"))


@query("a11_display_clip", f"""WITH {TRACES}
  SELECT inline, {q6("CASE WHEN quantile_cont(abs(a), 0.99) = 0 THEN 1.0 ELSE quantile_cont(abs(a), 0.99) END")} AS clip
  FROM voxels GROUP BY inline""")
def a11(spark, sf):
    return a.display_clip(traces(spark, sf)).select("inline", r6(F.col("clip")).alias("clip"))


@query("a12_amplitude_histogram", f"""WITH {TRACES} {_P99}
  SELECT CAST(least(299, floor((greatest(p01, least(p99, a)) - p01) / (p99 - p01) * 300)) AS INTEGER) AS bin, count(*) AS n
  FROM voxels, lim GROUP BY 1""")
def a12(spark, sf):
    t = traces(spark, sf)
    return a.amplitude_histogram(t, _tails(t)).select("bin", "n")


@query("a13_section_fault_fraction", f"""WITH {TRACES}, {PROBS}
  SELECT inline, {q6("avg(CAST(p >= 0.5 AS INTEGER))")} AS fault_fraction FROM probs GROUP BY inline""")
def a13(spark, sf):
    return a.section_fault_fraction(probs(spark, sf)).select(
        "inline", r6(F.col("fault_fraction")).alias("fault_fraction"))


@query("a14_run_fault_fraction", f"""WITH {TRACES}, {PROBS}
  SELECT survey_id, {q6("count(*) FILTER (WHERE p >= 0.5) / count(*)")} AS fault_voxel_fraction FROM probs GROUP BY survey_id""")
def a14(spark, sf):
    return a.run_fault_fraction(probs(spark, sf)).select(
        "survey_id", r6(F.col("fault_voxel_fraction")).alias("fault_voxel_fraction"))


@query("a15_probability_gate", f"""WITH {TRACES}, {PROBS},
  f AS (SELECT survey_id, min(CAST(CAST(p AS FLOAT) AS DOUBLE)) AS lo, max(CAST(CAST(p AS FLOAT) AS DOUBLE)) AS hi,
               avg(CAST(CAST(p AS FLOAT) AS DOUBLE)) AS mean, quantile_cont(CAST(CAST(p AS FLOAT) AS DOUBLE), 0.1) AS p10,
               quantile_cont(CAST(CAST(p AS FLOAT) AS DOUBLE), 0.9) AS p90,
               count(*) FILTER (WHERE CAST(p AS FLOAT) >= 0.7) / count(*) AS frac FROM probs GROUP BY survey_id)
  SELECT survey_id, {q6("lo")} AS min, {q6("hi")} AS max, {q6("mean")} AS mean, {q6("p10")} AS p10, {q6("p90")} AS p90,
         {q6("frac")} AS fault_voxel_fraction,
         CASE WHEN hi - lo < 0.05 OR frac < 0.001 OR frac > 0.5 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f""")
def a15(spark, sf):
    p = probs(spark, sf).withColumn("prob", F.col("prob").cast("array<float>"))
    return a.probability_gate(p, 0.7).select("survey_id", *[
        r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "p10", "p90", "fault_voxel_fraction")], "verdict")


@query("a17_stick_report", f"""WITH {PICKS}
  SELECT survey_id, count(DISTINCT stick_id) AS sticks, count(*) AS points,
         count(*) FILTER (WHERE il < 0 OR il >= {SHAPE["n_inlines"]} OR xl < 0 OR xl >= {SHAPE["n_crosslines"]}
                          OR s < 0 OR s >= {SHAPE["n_samples"]}) AS outside,
         {q6("min(il)")} AS il_min, {q6("max(il)")} AS il_max, {q6("min(xl)")} AS xl_min, {q6("max(xl)")} AS xl_max,
         {q6("min(s)")} AS s_min, {q6("max(s)")} AS s_max
  FROM picks GROUP BY survey_id""")
def a17(spark, sf):
    return a.stick_report(picks(spark, sf), shapes(spark, sf)).select(
        "survey_id", "sticks", "points", "outside",
        *[r6(F.col(f"{c}_{n}")).alias(f"{c}_{n}") for c in ("il", "xl", "s") for n in ("min", "max")])


@query("a18_ingest_summary", f"""WITH {IRREGULAR} {_VOX}
  SELECT survey_id, CAST(n_inlines AS INTEGER) AS n_inlines_loaded, inline_min, inline_max, crossline_min, crossline_max,
         CAST(n_samples AS INTEGER) AS n_samples, CAST(4.0 AS DOUBLE) AS sample_rate_ms,
         {q6("quantile_cont(a, 0.01)")} AS p01, {q6("quantile_cont(a, 0.99)")} AS p99, false AS synthetic_proxy
  FROM geom JOIN vox USING (survey_id) GROUP BY ALL""")
def a18(spark, sf):
    from lithoframe.plans.ingest import survey_rows
    rows = survey_rows(irregular_traces(spark, sf), source_file="embeddings", sample_mode=False)
    return a.ingest_summary(rows).withColumns({"p01": r6(F.col("p01")), "p99": r6(F.col("p99"))})
