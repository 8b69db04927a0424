"""Ingest: traces to a partitioned volume plus one catalog row per survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe import schema
from lithoframe.functions.lineage import sized
from lithoframe.operators import qc
from lithoframe.operators.geometry import SURVEY, fit_georeference, infer_geometry, keep_first_inlines, survey_axes
from lithoframe.sources.volume import read_volume, write_volume


def survey_rows(traces: DataFrame, source_file: str, sample_mode: bool,
                path: str | None = None, fingerprint: str | None = None) -> DataFrame:
    """Catalog rows: geometry with tie points, amplitude statistics, provenance."""
    geometry = fit_georeference(traces, infer_geometry(traces))
    stats = qc.amplitude_stats(traces)
    nest = lambda struct: F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in struct])
    return geometry.join(stats, SURVEY).select(
        "survey_id", F.lit(source_file).alias("source_file"),
        F.lit(fingerprint).cast("string").alias("source_sha256"),
        F.current_timestamp().alias("ingested_at"), F.lit(sample_mode).alias("sample_mode"),
        F.col("n_inlines").alias("n_inlines_loaded"),
        nest(schema.GEOMETRY).alias("geometry"), nest(schema.AMPLITUDE_STATS).alias("amplitude_stats"),
        F.lit(path).cast("string").alias("zarr_path"),
        F.create_map().cast("map<string,string>").alias("extra"))


def ingest(traces: DataFrame, out: str, source_file: str, sample_mode: bool = False, fingerprint: str | None = None,
           overwrite: bool = False) -> DataFrame:
    """Traces to ``out``/volume, axis arrays to ``out``/axes and one sidecar record per survey to ``out``/sidecar.

    The source is decoded once, into the volume; all that follows reads what it needs of that. Sample mode keeps the first
    inlines only. The sidecar is written last: an ingest without one did not finish. Returns the sidecar rows.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    kept = keep_first_inlines(traces, infer_geometry(traces)) if sample_mode else traces
    write_volume(kept, f"{out}/volume", overwrite)
    stored = read_volume(traces.sparkSession, f"{out}/volume")
    survey_axes(infer_geometry(stored)).write.mode(mode).parquet(f"{out}/axes")
    rows = sized(survey_rows(stored, source_file, sample_mode, f"{out}/volume", fingerprint))
    rows.write.mode(mode).json(f"{out}/sidecar")
    return rows
