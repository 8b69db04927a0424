"""Amplitude tables of other shapes, made into traces."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted spellings of the line columns, and the prefix of one-column-per-sample tables.
ALIASES = {"inline": ("inline", "il"), "crossline": ("crossline", "xl")}
SAMPLE_PREFIX = "amp_"


def recognise(df: DataFrame) -> DataFrame | None:
    """Rename line columns to inline and crossline; warn and give None if the table lacks a part."""
    named = {}
    for want, spellings in ALIASES.items():
        hit = next((c for c in df.columns if c.lower() in spellings), None)
        if hit is not None:
            named[hit] = want
    wide = any(c.startswith(SAMPLE_PREFIX) for c in df.columns)
    if len(named) < 2 or not (wide or "amplitude" in df.columns):
        warnings.warn(f"not an amplitude table: columns {df.columns}", stacklevel=2)
        return None
    return df.withColumnsRenamed(named)


def wide_to_traces(df: DataFrame, survey_id: str) -> DataFrame:
    """``amp_<n>`` columns, in the order of n, become the samples."""
    number = lambda c: int(re.sub(r"\D", "", c) or 0)
    cols = sorted((c for c in df.columns if c.startswith(SAMPLE_PREFIX)), key=number)
    return df.select(F.lit(survey_id).alias("survey_id"), "inline", "crossline",
                     F.array(*[F.col(c).cast("float") for c in cols]).alias("samples"))


def long_to_traces(df: DataFrame, survey_id: str, order: str | None = None) -> DataFrame:
    """(inline, crossline, twtt_ms, amplitude) rows to one trace per cell, samples by time.

    Repeated samples are settled before a cell is gathered (the last by ``order``, else the
    largest), so a cell never gathers more than its time axis.
    """
    keys = ["inline", "crossline", "twtt_ms"]
    one = (F.max_by("amplitude", order) if order else F.max("amplitude")).alias("amplitude")
    unique = df.groupBy(*keys).agg(one)
    gathered = unique.groupBy("inline", "crossline").agg(
        F.sort_array(F.collect_list(F.struct("twtt_ms", "amplitude"))).alias("p"))
    return gathered.select(F.lit(survey_id).alias("survey_id"), "inline", "crossline",
                           F.col("p.twtt_ms").alias("twtt_ms"),
                           F.transform("p.amplitude", lambda a: a.cast("float")).alias("samples"))
