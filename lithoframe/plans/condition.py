"""Conditioning: normalised amplitudes stored beside the originals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lithoframe.operators import qc
from lithoframe.operators.geometry import infer_geometry


def conditioned(traces: DataFrame, stats: DataFrame, clip: bool = True) -> DataFrame:
    """Traces with ``samples_norm``; the recorded samples are left as they are."""
    return qc.normalise(traces, stats.select("survey_id", "p99"), clip)


def condition_volume(traces: DataFrame, out_path: str, clip: bool = True) -> DataFrame:
    """Write the conditioned traces and return their quality rows."""
    report = qc.volume_qc(traces, infer_geometry(traces))
    stats = report.select("survey_id", report["amp_p99"].alias("p99"))
    conditioned(traces, stats, clip).write.partitionBy("survey_id").mode("errorifexists").parquet(out_path)
    return report
