"""Section and slice queries."""

import uuid

from pyspark.sql import functions as F

from lithoframe.functions.arrays import total
from lithoframe.functions.lineage import checkpoint_dir
from lithoframe.operators import slices as p
from lithoframe.operators.geometry import infer_geometry
from lithoframe.operators.patches import to_index_space
from lithoframe.queries import query
from lithoframe.queries.patches import geometry_of
from lithoframe.queries.tables import (
    IRREGULAR, PICKS, PROBS, TRACES, irregular_traces, picks, probs, q6, r6, traces,
)

from lithoframe.sources import volume

_CELL = ["survey_id", "inline", "crossline"]
_BRICK = (8, 8, 16)
_SQL_SUM = q6("list_sum(CAST(samples AS DOUBLE[]))")


@query("p1_inline_section", f"""WITH {TRACES}
  SELECT inline, crossline, s, {q6("a")} AS amplitude FROM voxels WHERE inline = 1007""")
def p1(spark, sf):
    return p.voxels(p.inline_section(traces(spark, sf), 1007)).select(
        "inline", "crossline", "s", r6(F.col("amplitude").cast("double")).alias("amplitude"))


@query("p2_crossline_section", f"""WITH {TRACES}
  SELECT inline, crossline, s, {q6("a")} AS amplitude FROM voxels WHERE crossline = 1912""")
def p2(spark, sf):
    return p.voxels(p.crossline_section(traces(spark, sf), 1912)).select(
        "inline", "crossline", "s", r6(F.col("amplitude").cast("double")).alias("amplitude"))


def _bricks(spark, sf):
    path = f"{checkpoint_dir(spark)}/bricks-{uuid.uuid4().hex}"
    volume.write_bricks(volume.bricks(to_index_space(traces(spark, sf), geometry_of(spark, sf)), _BRICK), path)
    return spark.read.parquet(path)


@query("p2_crossline_of_bricks", f"""WITH {TRACES}
  SELECT CAST(inline - il0 AS INTEGER) AS il, CAST(crossline - xl0 AS INTEGER) AS xl, s, {q6("a")} AS amplitude
  FROM voxels, geom WHERE crossline = 1912""")
def p2_bricks(spark, sf):
    found = volume.brick_section(_bricks(spark, sf), "xl", 12, _BRICK)
    return found.select("il", "xl", F.posexplode("samples").alias("s", "amplitude")).withColumn(
        "amplitude", r6(F.col("amplitude").cast("double")))


@query("p4_time_slice_of_bricks", f"""WITH {TRACES}
  SELECT CAST(inline - il0 AS INTEGER) AS il, CAST(crossline - xl0 AS INTEGER) AS xl, s, {q6("a")} AS amplitude
  FROM voxels, geom WHERE s = 21""")
def p4_bricks(spark, sf):
    return volume.brick_time_slice(_bricks(spark, sf), 21, _BRICK).select("il", "xl", "s", r6(F.col("amplitude").cast("double")).alias("amplitude"))


@query("p3_clamped_inline", f"""WITH {IRREGULAR},
  hit AS (SELECT survey_id, coalesce(min(num) FILTER (WHERE num >= 1016), max(num)) AS inline FROM ils GROUP BY survey_id)
  SELECT survey_id, inline, crossline, {_SQL_SUM} AS total FROM traces JOIN hit USING (survey_id, inline)""")
def p3(spark, sf):
    return p.clamped_inline_section(irregular_traces(spark, sf), 1016).select(*_CELL, r6(total(F.col("samples"))).alias("total"))


@query("p4_time_slice", f"""WITH {TRACES}
  SELECT inline, crossline, s, {q6("a")} AS amplitude FROM voxels WHERE s = 64 // 3""")
def p4(spark, sf):
    return p.time_slice(traces(spark, sf)).select(
        "inline", "crossline", "s", r6(F.col("amplitude").cast("double")).alias("amplitude"))


@query("p5_middle_sections", f"""WITH {TRACES}
  SELECT 'inline' AS section, inline, crossline, {_SQL_SUM} AS total FROM traces, geom WHERE inline = il0 + n_il // 2
  UNION ALL
  SELECT 'crossline', inline, crossline, {_SQL_SUM} FROM traces, geom WHERE crossline = xl0 + n_xl // 2""")
def p5(spark, sf):
    t = traces(spark, sf)
    return p.middle_sections(t, infer_geometry(t)).select(
        "section", "inline", "crossline", r6(total(F.col("samples"))).alias("total"))


@query("p6_bounded_slab", f"""WITH {TRACES},
  c AS (SELECT least(count(*) FILTER (WHERE inline < 1003), count(*) - 1) AS c, count(*) AS n
        FROM (SELECT DISTINCT inline FROM traces)),
  b AS (SELECT greatest(0, c - 5) AS lo, least(n, c + 6) AS hi, n FROM c),
  w AS (SELECT CASE WHEN hi - lo < 8 THEN greatest(0, least(lo, n - 8)) ELSE lo END AS lo, hi, n FROM b),
  z AS (SELECT lo, CASE WHEN hi - lo < 8 THEN least(n, lo + 8) ELSE hi END AS hi FROM w)
  SELECT inline, count(*) AS traces FROM traces, z WHERE inline - 1001 >= lo AND inline - 1001 < hi GROUP BY inline""")
def p6(spark, sf):
    t = traces(spark, sf)
    bounds = p.slab_bounds(t, infer_geometry(t), 1003, window=3, patch=8)
    return p.slab(t, bounds).groupBy("inline").agg(F.count("*").alias("traces"))


@query("p7_inline_index_range", f"""WITH {TRACES}
  SELECT inline, crossline, {_SQL_SUM} AS total FROM traces WHERE inline - 1001 >= 14""")
def p7(spark, sf):
    t = traces(spark, sf)
    return p.inline_index_range(t, infer_geometry(t), 14, 100_000).select(
        "inline", "crossline", r6(total(F.col("samples"))).alias("total"))


@query("p8_inline_number_range", f"""WITH {TRACES}
  SELECT inline, crossline, {_SQL_SUM} AS total FROM traces WHERE inline BETWEEN 1004 AND 1009""")
def p8(spark, sf):
    return p.inline_number_range(traces(spark, sf), 1004, 1009).select(
        "inline", "crossline", r6(total(F.col("samples"))).alias("total"))


@query("p9_section_overlay", f"""WITH {TRACES}, {PROBS}
  SELECT 'run-survey_0' AS run_id, inline, crossline, s, {q6("a")} AS amplitude, {q6("p")} AS prob,
         CAST(p >= 0.5 AS INTEGER) AS mask FROM probs WHERE inline = 1010""")
def p9(spark, sf):
    rows = p.overlay(traces(spark, sf), probs(spark, sf), 1010)
    return rows.select("run_id", "inline", "crossline", F.posexplode(
        F.arrays_zip("samples", "prob", "mask")).alias("s", "v")).select(
        "run_id", "inline", "crossline", "s", r6(F.col("v.samples").cast("double")).alias("amplitude"),
        r6(F.col("v.prob")).alias("prob"), "v.mask")


@query("p9_positional_overlay", f"""WITH {TRACES}, {PROBS}
  SELECT 'run-survey_0' AS run_id, inline, crossline, s, {q6("a")} AS amplitude, {q6("p")} AS prob,
         CAST(p >= 0.5 AS INTEGER) AS mask FROM probs WHERE inline = (SELECT min(inline) + 9 FROM traces)""")
def p9_positional(spark, sf):
    t = traces(spark, sf)
    grid = infer_geometry(t)
    counted = probs(spark, sf).join(grid.select("survey_id", "inline_min", "crossline_min"), "survey_id").select(
        "run_id", "survey_id", (F.col("inline") - F.col("inline_min")).alias("inline"),
        (F.col("crossline") - F.col("crossline_min")).alias("crossline"), "prob")
    return p.positional_overlay(t, counted, grid, 9).select("run_id", "inline", "crossline", F.posexplode(
        F.arrays_zip("samples", "prob", "mask")).alias("s", "v")).select(
        "run_id", "inline", "crossline", "s", r6(F.col("v.samples").cast("double")).alias("amplitude"),
        r6(F.col("v.prob")).alias("prob"), "v.mask")


@query("p10_sticks_on_section", f"""WITH {PICKS}
  SELECT stick_id, {q6("1900 + xl", 3)} AS crossline, {q6("4.0 * s", 3)} AS twt FROM picks WHERE 1001 + il = 1041""")
def p10(spark, sf):
    absolute = picks(spark, sf).select(
        "stick_id", (F.col("il") + 1001).alias("inline"), (F.col("xl") + 1900).alias("crossline"),
        (F.col("s") * 4.0).alias("twt"))
    return p.stick_crossings(absolute, 1041).select(
        "stick_id", r6(F.col("crossline"), 3).alias("crossline"), r6(F.col("twt"), 3).alias("twt"))


@query("p11_first_inline_samples", f"""WITH {TRACES}
  SELECT inline, crossline, s, {q6("a")} AS amplitude FROM voxels
  WHERE inline = (SELECT min(inline) FROM traces) ORDER BY survey_id, crossline, s LIMIT 100""")
def p11(spark, sf):
    return p.first_inline_samples(traces(spark, sf)).select(
        "inline", "crossline", "s", r6(F.col("amplitude").cast("double")).alias("amplitude"))


@query("p12_long_voxels", f"""WITH {TRACES}
  SELECT inline, crossline, s, s * 4.0 AS twt, {q6("a")} AS amplitude FROM voxels""".replace(
    "s * 4.0", "CAST(s * 4 AS DOUBLE)"))
def p12(spark, sf):
    return p.voxels(traces(spark, sf)).select(
        "inline", "crossline", "s", (F.col("s") * F.lit(4.0)).alias("twt"),
        r6(F.col("amplitude").cast("double")).alias("amplitude"))
