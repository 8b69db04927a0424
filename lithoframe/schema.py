"""Row shapes shared by the operators.

A volume is a table of traces: one row per (survey, inline, crossline) with the samples in an array.
Masks are sparse: one row per voxel that is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRACES = T.StructType([
    T.StructField("survey_id", T.StringType()),
    T.StructField("trace_no", T.LongType()),
    T.StructField("inline", T.IntegerType()),
    T.StructField("crossline", T.IntegerType()),
    T.StructField("cdp_x", T.DoubleType()),
    T.StructField("cdp_y", T.DoubleType()),
    T.StructField("coord_scalar", T.IntegerType()),
    T.StructField("delay_ms", T.DoubleType()),
    T.StructField("dt_ms", T.DoubleType()),
    T.StructField("n_samples", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])

TIE_POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("il", T.IntegerType()),
    T.StructField("xl", T.IntegerType()),
])

GEOMETRY = T.StructType([
    T.StructField("inline_min", T.IntegerType()),
    T.StructField("inline_max", T.IntegerType()),
    T.StructField("inline_step", T.IntegerType()),
    T.StructField("crossline_min", T.IntegerType()),
    T.StructField("crossline_max", T.IntegerType()),
    T.StructField("crossline_step", T.IntegerType()),
    T.StructField("sample_rate_ms", T.DoubleType()),
    T.StructField("n_samples", T.IntegerType()),
    T.StructField("n_inlines", T.IntegerType()),
    T.StructField("n_crosslines", T.IntegerType()),
    T.StructField("datum_ms", T.DoubleType()),
    T.StructField("corner_points", T.ArrayType(TIE_POINT)),
])

AMPLITUDE_STATS = T.StructType([
    T.StructField(n, T.DoubleType())
    for n in ("min", "max", "mean", "std", "p01", "p99", "nonzero_fraction")
])

SURVEYS = T.StructType([
    T.StructField("survey_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_sha256", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("sample_mode", T.BooleanType()),
    T.StructField("n_inlines_loaded", T.IntegerType()),
    T.StructField("geometry", GEOMETRY),
    T.StructField("amplitude_stats", AMPLITUDE_STATS),
    T.StructField("zarr_path", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

WELLS = T.StructType([
    T.StructField("well_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("uwi", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("kb_elevation_m", T.DoubleType()),
    T.StructField("total_depth_m", T.DoubleType()),
    T.StructField("spud_date", T.StringType()),
    T.StructField("formation_tops", T.ArrayType(T.StructType([
        T.StructField("formation", T.StringType()),
        T.StructField("depth_m", T.DoubleType()),
        T.StructField("tvdss_m", T.DoubleType()),
    ]))),
    T.StructField("logs_available", T.ArrayType(T.StringType())),
])

WELL_LOGS = T.StructType([
    T.StructField("well_id", T.StringType()),
    T.StructField("depth_unit", T.StringType()),
    T.StructField("depth_values", T.ArrayType(T.DoubleType())),
    T.StructField("curves", T.ArrayType(T.StructType([
        T.StructField("mnemonic", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]))),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("survey_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("prob_zarr_path", T.StringType()),
    T.StructField("mask_zarr_path", T.StringType()),
    T.StructField("fault_voxel_fraction", T.DoubleType()),
    T.StructField("inline_coords", T.ArrayType(T.IntegerType())),
    T.StructField("crossline_coords", T.ArrayType(T.IntegerType())),
    T.StructField("twtt_ms", T.ArrayType(T.DoubleType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

# Job states and split names a table may hold.
JOB_STATES = ("pending", "running", "complete", "failed")
SPLITS = ("train", "val", "test")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, on the driver, when an input lacks a column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
