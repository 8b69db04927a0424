"""Geometry queries."""

from pyspark.sql import functions as F

from lithoframe.functions.arrays import total
from lithoframe.functions.lineage import sized
from lithoframe.operators import geometry as g
from lithoframe.queries import query
from lithoframe.queries.tables import IRREGULAR, TRACES, irregular_traces, q6, r6, traces, world_sticks

GEOMETRY_COLUMNS = ["survey_id", "inline_min", "inline_max", "inline_step", "n_inlines",
                     "crossline_min", "crossline_max", "crossline_step", "n_crosslines"]
_GEOMETRY_SQL = """
  SELECT survey_id, inline_min, inline_max, CAST(inline_step AS INTEGER) AS inline_step,
         CAST(n_inlines AS INTEGER) AS n_inlines, crossline_min, crossline_max,
         CAST(crossline_step AS INTEGER) AS crossline_step, CAST(n_crosslines AS INTEGER) AS n_crosslines
"""


GEOMETRY_SQL = f"""WITH {TRACES}
  SELECT 'survey_0' AS survey_id, il0 AS inline_min, il1 AS inline_max, 1 AS inline_step,
         CAST(n_il AS INTEGER) AS n_inlines, xl0 AS crossline_min, xl1 AS crossline_max,
         1 AS crossline_step, CAST(n_xl AS INTEGER) AS n_crosslines,
         CAST((SELECT max(len(samples)) FROM traces) AS INTEGER) AS n_samples, CAST(4.0 AS DOUBLE) AS sample_rate_ms
  FROM geom"""


@query("g1_geometry_regular", GEOMETRY_SQL)
def g1(spark, sf):
    return g.infer_geometry(traces(spark, sf)).select(
        *GEOMETRY_COLUMNS, "n_samples", "sample_rate_ms")


@query("g2_geometry_irregular", f"WITH {IRREGULAR} {_GEOMETRY_SQL} FROM geom")
def g2(spark, sf):
    return g.infer_geometry(irregular_traces(spark, sf)).select(*GEOMETRY_COLUMNS)


@query("g3_irregular_flag", f"""WITH {IRREGULAR}
  SELECT survey_id, n_traces, n_traces <> n_inlines * n_crosslines AS irregular FROM geom""")
def g3(spark, sf):
    return g.flag_irregular(g.infer_geometry(irregular_traces(spark, sf))).select(
        "survey_id", "n_traces", "irregular")


_FILLED = f"""{IRREGULAR},
  il_grid AS (SELECT survey_id, unnest(range(inline_min, inline_max + 1, inline_step)) AS inline FROM geom),
  xl_grid AS (SELECT survey_id, unnest(range(crossline_min, crossline_max + 1, crossline_step)) AS crossline FROM geom),
  kept AS (SELECT survey_id, inline, crossline, arg_max(samples, trace_no) AS samples
           FROM traces GROUP BY ALL),
  filled AS (
    SELECT survey_id, CAST(i.inline AS INTEGER) AS inline, CAST(x.crossline AS INTEGER) AS crossline,
           k.samples IS NOT NULL AS recorded, k.samples AS samples
    FROM il_grid i JOIN xl_grid x USING (survey_id)
    LEFT JOIN kept k USING (survey_id, inline, crossline))"""


@query("g4_regularise", f"""WITH {_FILLED}
  SELECT survey_id, inline, crossline, recorded,
         coalesce({q6("list_sum(CAST(samples AS DOUBLE[]))")}, 0.0) AS sample_sum,
         CAST(64 AS INTEGER) AS n
  FROM filled""")
def g4(spark, sf):
    return g.regularise(irregular_traces(spark, sf)).select(
        "survey_id", "inline", "crossline", "recorded", r6(total(F.col("samples"))).alias("sample_sum"),
        F.size("samples").alias("n"))


@query("g5_short_inline_pad", f"""WITH {_FILLED}
  SELECT survey_id, inline, count(*) AS cells, count(*) FILTER (WHERE NOT recorded) AS padded
  FROM filled GROUP BY survey_id, inline""")
def g5(spark, sf):
    return g.regularise(irregular_traces(spark, sf)).groupBy("survey_id", "inline").agg(
        F.count("*").alias("cells"), F.count_if(~F.col("recorded")).alias("padded"))


@query("g6_sample_mode", f"""WITH {IRREGULAR}
  SELECT survey_id, trace_no, inline FROM traces JOIN geom USING (survey_id)
  WHERE inline <= inline_min + 4 * inline_step""")
def g6(spark, sf):
    t = irregular_traces(spark, sf)
    return g.keep_first_inlines(t, g.infer_geometry(t), 5).select("survey_id", "trace_no", "inline")


@query("g7_fill_report", f"""WITH {_FILLED}
  SELECT f.survey_id, count(*) AS cells, count(*) FILTER (WHERE recorded) AS filled_cells,
         {q6("100.0 * count(*) FILTER (WHERE recorded) / count(*)")} AS percent_cells,
         {q6("100.0 * any_value(p.placed) / any_value(p.total)")} AS percent_fill, any_value(p.placed) AS placed,
         any_value(p.total) AS total
  FROM filled f JOIN (
    SELECT survey_id, count(*) AS total, count(*) FILTER (
      WHERE (inline - inline_min) % inline_step = 0 AND (crossline - crossline_min) % crossline_step = 0) AS placed
    FROM traces JOIN geom USING (survey_id) GROUP BY survey_id) p USING (survey_id)
  GROUP BY f.survey_id""")
def g7(spark, sf):
    t = irregular_traces(spark, sf)
    return g.fill_report(t, g.infer_geometry(t)).select(
        "survey_id", "cells", "filled_cells", *[r6(F.col(c)).alias(c) for c in ("percent_cells", "percent_fill")],
        "placed", "total")


@query("g8_coordinate_scalar", f"""WITH {TRACES}
  SELECT trace_no, {q6("round_even((15.5 * inline + 21.0 * crossline + 482000.0) * 10, 0) / 10.0")} AS x,
         {q6("round_even((20.0 * inline - 6.5 * crossline + 5214000.0) * 10, 0) / 10.0")} AS y
  FROM traces""")
def g8(spark, sf):
    return g.scale_coordinates(traces(spark, sf)).select(
        "trace_no", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("g9_georeference_fit", f"""WITH {IRREGULAR},
  w AS (SELECT survey_id, CAST(inline AS DOUBLE) AS il, CAST(crossline AS DOUBLE) AS xl,
               15.5 * inline + 21.0 * crossline + 482000.0 AS x, 20.0 * inline - 6.5 * crossline + 5214000.0 AS y
        FROM traces),
  c AS (SELECT survey_id, avg(il) AS mi, avg(xl) AS mj, avg(x) AS mx, avg(y) AS my,
               covar_pop(il, il) AS ii, covar_pop(xl, xl) AS jj, covar_pop(il, xl) AS ij,
               covar_pop(il, x) AS ix, covar_pop(xl, x) AS jx, covar_pop(il, y) AS iy, covar_pop(xl, y) AS jy
        FROM w GROUP BY survey_id),
  f AS (SELECT survey_id, mi, mj, mx, my,
               (ix * jj - jx * ij) / (ii * jj - ij * ij) AS xa, (jx * ii - ix * ij) / (ii * jj - ij * ij) AS xb,
               (iy * jj - jy * ij) / (ii * jj - ij * ij) AS ya, (jy * ii - iy * ij) / (ii * jj - ij * ij) AS yb
        FROM c),
  k AS (SELECT survey_id, inline_min AS il, crossline_min AS xl FROM geom
        UNION ALL SELECT survey_id, inline_max, crossline_min FROM geom
        UNION ALL SELECT survey_id, inline_min, crossline_max FROM geom)
  SELECT survey_id, il, xl, {q6("mx + xa * (il - mi) + xb * (xl - mj)", 3)} AS x,
         {q6("my + ya * (il - mi) + yb * (xl - mj)", 3)} AS y
  FROM k JOIN f USING (survey_id)""")
def g9(spark, sf):
    t = irregular_traces(spark, sf)
    fit = g.fit_georeference(t, g.infer_geometry(t))
    return fit.select("survey_id", F.explode("corner_points").alias("p")).select(
        "survey_id", "p.il", "p.xl", r6(F.col("p.x"), 3).alias("x"), r6(F.col("p.y"), 3).alias("y"))


def _transform(spark, sf):
    t = traces(spark, sf)
    return g.three_point_transform(g.fit_georeference(t, g.infer_geometry(t)))


@query("g10_three_point_transform", f"""WITH {TRACES},
  d AS (SELECT 15.5 * (il1 - il0) AS x1, 20.0 * (il1 - il0) AS y1, il1 - il0 AS i1,
               21.0 * (xl1 - xl0) AS x2, -6.5 * (xl1 - xl0) AS y2, xl1 - xl0 AS j2, * FROM geom)
  SELECT 'survey_0' AS survey_id, {q6("15.5 * il0 + 21.0 * xl0 + 482000.0", 3)} AS x0,
         {q6("20.0 * il0 - 6.5 * xl0 + 5214000.0", 3)} AS y0,
         {q6("i1 * y2 / (x1 * y2 - y1 * x2)")} AS il_dx, {q6("-i1 * x2 / (x1 * y2 - y1 * x2)")} AS il_dy,
         {q6("-j2 * y1 / (x1 * y2 - y1 * x2)")} AS xl_dx, {q6("j2 * x1 / (x1 * y2 - y1 * x2)")} AS xl_dy
  FROM d""")
def g10(spark, sf):
    t = _transform(spark, sf)
    return t.select("survey_id", r6(F.col("x0"), 3).alias("x0"), r6(F.col("y0"), 3).alias("y0"),
                    *[r6(F.col(c)).alias(c) for c in ("il_dx", "il_dy", "xl_dx", "xl_dy")])


@query("g11_world_to_grid", """
  SELECT user_id AS stick_id, event_id AS pt_no,
         round(CAST((user_id * 37 + event_id % 11) % 150 + 1001 AS DOUBLE), 3) + 0.0 AS il,
         round(CAST((user_id * 53) % 180 AS DOUBLE) + value % 9.0 + 1900.0, 3) + 0.0 AS xl,
         round(CAST((user_id * 71) % 280 + event_id % 7 AS DOUBLE), 3) + 0.0 AS s
  FROM events""")
def g11(spark, sf):
    return g.world_to_grid(world_sticks(spark, sf), _transform(spark, sf)).select(
        "stick_id", "pt_no", *[r6(F.col(c), 3).alias(c) for c in ("il", "xl", "s")])


@query("g12_number_to_index", f"""WITH {IRREGULAR}
  SELECT survey_id, trace_no,
         CAST(greatest(0, least((inline_max - inline_min) // inline_step, floor((inline - 7 - inline_min) / inline_step))) AS INTEGER) AS il_idx,
         CAST(greatest(0, least((crossline_max - crossline_min) // crossline_step, floor((crossline - crossline_min) / crossline_step))) AS INTEGER) AS xl_idx
  FROM traces JOIN geom USING (survey_id)""")
def g12(spark, sf):
    t = irregular_traces(spark, sf)
    at = lambda axis, off: g.line_to_index(
        F.col(axis) - off, F.col(f"{axis}_min"), F.col(f"{axis}_step"), g.grid_size(axis))
    geo = sized(g.infer_geometry(t).drop("n_samples"))
    return t.join(geo, "survey_id").select(
        "survey_id", "trace_no", at("inline", 7).alias("il_idx"), at("crossline", 0).alias("xl_idx"))


@query("g13_searchsorted", f"""WITH {IRREGULAR}
  SELECT survey_id, CAST(least(count(*) FILTER (WHERE num < 1010), count(*) - 1) AS BIGINT) AS idx,
         coalesce(min(num) FILTER (WHERE num >= 1010), max(num)) AS number
  FROM ils GROUP BY survey_id""")
def g13(spark, sf):
    numbers = irregular_traces(spark, sf).select("survey_id", F.col("inline").alias("number")).distinct()
    return g.insertion_index(numbers, 1010)


@query("g14_survey_bounds", f"""WITH {IRREGULAR}
  SELECT survey_id, inline_min, inline_max, n_inlines, crossline_min, crossline_max, n_crosslines, n_traces
  FROM geom""")
def g14(spark, sf):
    return g.survey_bounds(irregular_traces(spark, sf))
