"""Labels: stick text to a written fault mask with its density verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.operators import qc, raster, sticks
from lithoframe.operators.geometry import three_point_transform

# Fixed value: dilation of a label job unless told otherwise.
LABEL_DILATION = 3


def stick_keys(picks: DataFrame, survey_id: str) -> tuple[DataFrame, list[str]]:
    """Parsed picks with one stick column, and the columns that order points in a stick."""
    order = [c for c in ("point_id", "line_no") if c in picks.columns]
    number = F.col("stick_no") if "stick_no" in picks.columns else F.lit(0)
    return picks.withColumns({
        "survey_id": F.lit(survey_id), "stick_id": F.struct("file", number.alias("n"))}), order


def label_volume(lines: DataFrame, fmt: str, geometry: DataFrame, survey_id: str,
                 dilation: int = LABEL_DILATION, max_gap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mask of a survey and its density report.

    Index files are painted as they are; world files go through the tie points of the geometry.
    """
    picks, order = stick_keys(sticks.parse_sticks(lines, fmt), survey_id)
    if {"il", "xl"} <= set(picks.columns):
        mask = cut(raster.rasterise_index_sticks(picks, order, geometry, dilation, max_gap))
        base = mask if max_gap is None else raster.rasterise_index_sticks(picks, order, geometry, dilation)
    else:
        mask = cut(raster.rasterise_world_sticks(
            picks, order, three_point_transform(geometry), geometry, dilation))
        base = mask
    return mask, qc.label_report(mask, base, geometry)
