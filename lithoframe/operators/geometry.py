"""Survey geometry, grid regularisation and georeferencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.arrays import blank
from lithoframe.functions.lineage import sized
from lithoframe.functions.numeric import clamp, floor_div

SURVEY = ["survey_id"]

# Lines loaded in sample mode, and the largest residual a usable fit may have.
SAMPLE_INLINES = 50
MAX_FIT_RESIDUAL_M = 100.0


def line_numbers(traces: DataFrame) -> DataFrame:
    """Distinct line numbers: (survey_id, axis, number, traces). Reads header columns only."""
    return traces.select("survey_id", F.explode(F.array(
        F.struct(F.lit("inline").alias("axis"), F.col("inline").alias("number")),
        F.struct(F.lit("crossline").alias("axis"), F.col("crossline").alias("number")),
    )).alias("line")).groupBy("survey_id", "line.axis", "line.number").agg(
        F.count("*").alias("traces"))


def infer_geometry(traces: DataFrame) -> DataFrame:
    """One row per survey; works for rectangular and irregular trace sets alike.

    The step of an axis is its second smallest line number minus its smallest, 1 for a single line. One scan of
    header columns: what a survey's records share is folded per line, and the lines of a survey per survey.
    """
    axis = lambda name: F.struct(F.lit(name).alias("axis"), F.col(name).alias("number"))
    lines = traces.select("survey_id", "n_samples", "dt_ms", F.struct("trace_no", "delay_ms").alias("record"),
                          F.explode(F.array(axis("inline"), axis("crossline"))).alias("line")).groupBy(
        "survey_id", "line.axis", "line.number").agg(
        F.count("*").alias("n"), F.max("n_samples").alias("n_samples"), F.max("dt_ms").alias("dt_ms"),
        F.min("record").alias("record"))
    of = lambda name, c: F.when(F.col("axis") == name, F.col(c))
    numbers = {name: F.sort_array(F.collect_set(of(name, "number"))).alias(name) for name in ("inline", "crossline")}
    one = lines.groupBy("survey_id").agg(
        *numbers.values(), F.sum(of("inline", "n")).alias("n_traces"), F.max("n_samples").alias("n_samples"),
        F.max("dt_ms").alias("sample_rate_ms"), F.min("record").alias("record"))

    def extent(name: str) -> list[Column]:
        lo, second = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        return [lo.cast("int").alias(f"{name}_min"), F.element_at(name, -1).cast("int").alias(f"{name}_max"),
                F.coalesce(second - lo, F.lit(1)).cast("int").alias(f"{name}_step"), F.size(name).alias(f"n_{name}s")]

    return sized(one.select("survey_id", *extent("inline"), *extent("crossline"), "n_traces", "n_samples",
                            "sample_rate_ms", F.col("record.delay_ms").alias("datum_ms")))


def flag_irregular(geometry: DataFrame) -> DataFrame:
    """A survey is irregular when its trace count differs from its line-count product."""
    cells = F.col("n_inlines").cast("long") * F.col("n_crosslines")
    return geometry.withColumn("irregular", F.col("n_traces") != cells)


def survey_axes(geometry: DataFrame) -> DataFrame:
    """The axis arrays of a survey, built from min, max and step."""
    return geometry.select(
        "survey_id",
        F.sequence("inline_min", "inline_max", "inline_step").alias("inlines"),
        F.sequence("crossline_min", "crossline_max", "crossline_step").alias("crosslines"),
        F.transform(F.sequence(F.lit(0), F.col("n_samples") - 1),
                    lambda i: F.col("datum_ms") + i * F.col("sample_rate_ms")).alias("twtt_ms"))


def grid_cells(geometry: DataFrame) -> DataFrame:
    """Every (inline, crossline) cell; lines are spread over tasks before crosslines are listed."""
    lines = geometry.select("survey_id", "crossline_min", "crossline_max", "crossline_step",
                            F.explode(F.sequence("inline_min", "inline_max", "inline_step"))
                            .alias("inline")).repartition("survey_id", "inline")
    return lines.select("survey_id", "inline", F.explode(
        F.sequence("crossline_min", "crossline_max", "crossline_step")).alias("crossline"))


def regularise(traces: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """Zero-fill the grid: one row per cell, blank samples where no trace was recorded.

    Traces off the step grid fall away; of several traces in a cell the last recorded stays. The
    winner of a cell is found on header columns, so samples are shuffled once.
    """
    geometry = infer_geometry(traces) if geometry is None else geometry
    geometry = sized(geometry)
    cell = ["survey_id", "inline", "crossline"]
    winner = traces.groupBy(*cell).agg(F.max("trace_no").alias("trace_no"))
    placed = grid_cells(geometry).join(winner, cell, "left")
    filled = placed.join(traces.select(*cell, "trace_no", "samples"), [*cell, "trace_no"], "left")
    return filled.join(geometry.select("survey_id", "n_samples"), SURVEY).select(
        *cell, F.coalesce("samples", blank(F.col("n_samples"))).alias("samples"),
        F.col("trace_no").isNotNull().alias("recorded"))


def keep_first_inlines(traces: DataFrame, geometry: DataFrame,
                       n: int = SAMPLE_INLINES) -> DataFrame:
    """Sample mode: the first n inline positions of each survey."""
    if n < 1:
        raise ValueError("n must be at least 1")
    bounds = sized(geometry).select(
        "survey_id", (F.col("inline_min") + (n - 1) * F.col("inline_step")).alias("_last"))
    return traces.join(bounds, SURVEY).where(F.col("inline") <= F.col("_last")).drop("_last")


def fill_report(traces: DataFrame, geometry: DataFrame) -> DataFrame:
    """How many recorded traces lie on the grid, their share of all, and the share of cells they fill."""
    g = sized(geometry)
    on = lambda axis: (
        (F.col(axis) - F.col(f"{axis}_min")) % F.col(f"{axis}_step") == 0)
    cells = traces.select("survey_id", "inline", "crossline").join(g, SURVEY)
    per_cell = cells.groupBy("survey_id", "inline", "crossline").agg(
        F.count("*").alias("n"), F.first(on("inline") & on("crossline")).alias("on_grid"),
        F.first(grid_size("inline").cast("long") * grid_size("crossline")).alias("cells"))
    return per_cell.groupBy("survey_id").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("on_grid"), F.col("n")).otherwise(0)).alias("placed"),
        F.count_if("on_grid").alias("filled_cells"),
        F.first("cells").alias("cells"),
    ).withColumns({"percent_fill": 100.0 * F.col("placed") / F.greatest(F.col("total"), F.lit(1)),
                   "percent_cells": 100.0 * F.col("filled_cells") / F.col("cells")})


def scale_coordinates(traces: DataFrame) -> DataFrame:
    """World coordinates: the scalar of the first trace holds for the whole survey."""
    first = sized(traces.groupBy("survey_id").agg(
        F.min_by("coord_scalar", "trace_no").alias("_scalar")))
    s = F.col("_scalar")
    scaled = lambda c: F.when(s < 0, c / F.abs(s)).when(s > 0, c * s).otherwise(c)
    return traces.join(first, SURVEY).withColumns({
        "x": scaled(F.col("cdp_x")), "y": scaled(F.col("cdp_y"))}).drop("_scalar")


def fit_georeference(traces: DataFrame, geometry: DataFrame) -> DataFrame:
    """Least-squares plane x, y ~ (inline, crossline, 1), evaluated at three grid corners.

    Covariances are distributive, so every trace with a position takes part. ``corner_points`` is
    null without positions, below three traces, on a degenerate layout or on a poor fit.
    """
    world = scale_coordinates(traces).where(~((F.col("x") == 0) & (F.col("y") == 0))).select(
        "survey_id", F.col("inline").cast("double").alias("il"),
        F.col("crossline").cast("double").alias("xl"), "x", "y")
    sums = world.groupBy("survey_id").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("il", "xl", "x", "y")],
        F.var_pop("il").alias("ii"), F.var_pop("xl").alias("jj"),
        F.covar_pop("il", "xl").alias("ij"),
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in ("il", "xl") for b in ("x", "y")])
    det = F.col("ii") * F.col("jj") - F.col("ij") * F.col("ij")
    flat_i, flat_j = F.col("ii") == 0, F.col("jj") == 0

    def slopes(w: str) -> list[Column]:
        along = (F.when(flat_i, F.lit(0.0))
                 .when(flat_j, F.col(f"il_{w}") / F.col("ii"))
                 .when(det > 0, (F.col(f"il_{w}") * F.col("jj") - F.col(f"xl_{w}") * F.col("ij")) / det))
        across = (F.when(flat_j, F.lit(0.0))
                  .when(flat_i, F.col(f"xl_{w}") / F.col("jj"))
                  .when(det > 0, (F.col(f"xl_{w}") * F.col("ii") - F.col(f"il_{w}") * F.col("ij")) / det))
        return [along.alias(f"{w}_il"), across.alias(f"{w}_xl")]

    fit = sized(sums.where(F.col("n") >= 3).select(
        "survey_id", "m_il", "m_xl", "m_x", "m_y", *slopes("x"), *slopes("y")))
    at = lambda w, il, xl: (F.col(f"m_{w}") + F.col(f"{w}_il") * (il - F.col("m_il"))
                            + F.col(f"{w}_xl") * (xl - F.col("m_xl")))
    here = (F.col("il"), F.col("xl"))
    residual = world.join(fit, SURVEY).groupBy("survey_id").agg(
        F.max(F.hypot(F.col("x") - at("x", *here), F.col("y") - at("y", *here))).alias("max_residual"))
    corner = lambda il, xl: F.struct(
        at("x", F.col(il), F.col(xl)).alias("x"), at("y", F.col(il), F.col(xl)).alias("y"),
        F.col(il).alias("il"), F.col(xl).alias("xl"))
    corners = F.array(corner("inline_min", "crossline_min"), corner("inline_max", "crossline_min"),
                      corner("inline_min", "crossline_max"))
    return sized(geometry.join(fit, SURVEY, "left").join(residual, SURVEY, "left")
                 .withColumn("corner_points", F.when(F.col("max_residual") <= MAX_FIT_RESIDUAL_M, corners))
                 .select(*geometry.columns, "max_residual", "corner_points"))


def three_point_transform(geometry: DataFrame) -> DataFrame:
    """Affine world-to-grid transform from the first three tie points of each survey."""
    p = [F.col("corner_points")[i] for i in range(3)]
    d = lambda i, f: (p[i][f] - p[0][f]).cast("double")
    det = d(1, "x") * d(2, "y") - d(1, "y") * d(2, "x")
    ready = geometry.withColumn("corner_points", F.when(
        F.coalesce(F.size("corner_points"), F.lit(0)) < 3,
        F.raise_error("at least three tie points are needed").cast(
            geometry.schema["corner_points"].dataType)).otherwise(F.col("corner_points")))
    safe = F.when(F.abs(det) > 0, det).otherwise(
        F.raise_error("tie points are collinear").cast("double"))
    by_x = lambda f: (d(1, f) * d(2, "y") - d(2, f) * d(1, "y")) / safe
    by_y = lambda f: (d(2, f) * d(1, "x") - d(1, f) * d(2, "x")) / safe
    return sized(ready.select(
        "survey_id", p[0]["x"].alias("x0"), p[0]["y"].alias("y0"),
        p[0]["il"].cast("double").alias("il0"), p[0]["xl"].cast("double").alias("xl0"),
        by_x("il").alias("il_dx"), by_y("il").alias("il_dy"),
        by_x("xl").alias("xl_dx"), by_y("xl").alias("xl_dy"),
        "sample_rate_ms", "datum_ms"))


def world_to_grid(points: DataFrame, transform: DataFrame) -> DataFrame:
    """Add fractional line numbers and the fractional sample index to (survey_id, x, y, z)."""
    t = sized(transform)
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return points.join(t, SURVEY).select(
        *points.columns,
        (F.col("il0") + F.col("il_dx") * dx + F.col("il_dy") * dy).alias("il"),
        (F.col("xl0") + F.col("xl_dx") * dx + F.col("xl_dy") * dy).alias("xl"),
        ((F.col("z") - F.col("datum_ms")) / F.col("sample_rate_ms")).alias("s"))


def grid_size(axis: str) -> Column:
    """Positions along an axis by range and step, lines that were never recorded included."""
    return (floor_div(F.col(f"{axis}_max") - F.col(f"{axis}_min"), F.col(f"{axis}_step")) + 1).cast("int")


def grid_shape(geometry: DataFrame) -> DataFrame:
    """(survey_id, n_inlines, n_crosslines, n_samples) of the grid that positions address."""
    return geometry.select("survey_id", grid_size("inline").alias("n_inlines"),
                           grid_size("crossline").alias("n_crosslines"), "n_samples")


def line_to_index(number: Column, first: Column, step: Column, n: Column) -> Column:
    """0-based position of a line number on a grid of n positions, clamped to it."""
    return clamp(F.floor((number - first) / step), F.lit(0), n - 1).cast("int")


def insertion_index(lines: DataFrame, target: int) -> DataFrame:
    """Left insertion point of ``target`` on each survey axis, clamped to the last line.

    ``lines`` is (survey_id, number). Also returns the line number found there, which is the first
    one at or after the target, not the nearest.
    """
    return lines.groupBy("survey_id").agg(
        F.least(F.count_if(F.col("number") < target), F.count("*") - 1).alias("idx"),
        F.coalesce(F.min(F.when(F.col("number") >= target, F.col("number"))),
                   F.max("number")).alias("number"))


def survey_bounds(traces: DataFrame) -> DataFrame:
    """Line extents, line counts and trace count of each survey."""
    axes = line_numbers(traces)
    of = lambda axis, fn: fn(F.when(F.col("axis") == axis, F.col("number")))
    return axes.groupBy("survey_id").agg(
        of("inline", F.min).alias("inline_min"), of("inline", F.max).alias("inline_max"),
        of("crossline", F.min).alias("crossline_min"), of("crossline", F.max).alias("crossline_max"),
        F.count_if(F.col("axis") == "inline").alias("n_inlines"),
        F.count_if(F.col("axis") == "crossline").alias("n_crosslines"),
        F.sum(F.when(F.col("axis") == "inline", F.col("traces"))).alias("n_traces"))
