"""Stick to mask queries."""

from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized
from lithoframe.operators import qc, raster
from lithoframe.operators.geometry import fit_georeference, grid_shape, infer_geometry, three_point_transform
from lithoframe.queries import query
from lithoframe.queries.tables import (
    PICKS, SHAPE, TRACES, TRUTH, picks, q6, r6, shapes, table, traces, truth,
    world_sticks,
)

_N = (SHAPE["n_inlines"], SHAPE["n_crosslines"], SHAPE["n_samples"])


def _dense(source: str, out: str, gap: int = 5) -> str:
    return f"""
  srt AS (SELECT *, lead(il) OVER w AS il1, lead(xl) OVER w AS xl1, lead(s) OVER w AS s1 FROM {source}
          WINDOW w AS (PARTITION BY survey_id, stick_id ORDER BY il, pt_no)),
  cnt AS (SELECT *, CASE WHEN il1 - il > 1 AND il1 - il <= {gap} THEN CAST(round_even(il1 - il, 0) AS INTEGER) ELSE 1 END AS m FROM srt),
  {out} AS (SELECT survey_id, stick_id, pt_no, CAST(g.k AS INTEGER) AS step,
            CASE WHEN g.k = 0 THEN il ELSE il + g.k / m * (il1 - il) END AS il,
            CASE WHEN g.k = 0 THEN xl ELSE xl + g.k / m * (xl1 - xl) END AS xl,
            CASE WHEN g.k = 0 THEN s ELSE s + g.k / m * (s1 - s) END AS s
          FROM cnt, unnest(range(m)) AS g(k))"""


def _arc(source: str, order: str) -> str:
    """Positions by an interval join, unlike the arithmetic used in Spark."""
    return f"""
  nx AS (SELECT *, lead(il) OVER w AS ilb, lead(xl) OVER w AS xlb, lead(s) OVER w AS sb,
                row_number() OVER w AS rn, count(*) OVER (PARTITION BY survey_id, stick_id) AS n FROM {source}
         WINDOW w AS (PARTITION BY survey_id, stick_id ORDER BY {order})),
  sg AS (SELECT *, coalesce(sqrt(pow(ilb - il, 2) + pow(xlb - xl, 2) + pow(sb - s, 2)), 0) AS seg FROM nx),
  ac AS (SELECT *, sum(seg) OVER (PARTITION BY survey_id, stick_id ORDER BY rn) - seg AS a0,
                sum(seg) OVER (PARTITION BY survey_id, stick_id ORDER BY rn) AS a1,
                sum(seg) OVER (PARTITION BY survey_id, stick_id) AS total FROM sg),
  tot AS (SELECT survey_id, stick_id, max(a1) AS total, greatest(CAST(trunc(max(a1) * 2) AS INTEGER), max(n)) AS nq
          FROM ac GROUP BY ALL HAVING max(a1) >= 1e-9),
  qs AS (SELECT survey_id, stick_id, CAST(g.k AS INTEGER) AS k, CASE WHEN g.k = nq - 1 THEN total ELSE g.k * (total / (nq - 1)) END AS t
         FROM tot, unnest(range(nq)) AS g(k)),
  hit AS (SELECT qs.survey_id, qs.stick_id, qs.k, qs.t, a.il, a.xl, a.s, a.ilb, a.xlb, a.sb, a.a0, a.seg, a.rn,
                 row_number() OVER (PARTITION BY qs.survey_id, qs.stick_id, qs.k ORDER BY a.rn DESC) AS pick
          FROM qs JOIN ac a ON a.survey_id = qs.survey_id AND a.stick_id = qs.stick_id AND a.seg > 0
               AND qs.t >= a.a0 - 1e-9 AND a.a1 >= qs.t - 1e-9),
  pos AS (SELECT survey_id, stick_id, k, il + f * (ilb - il) AS il, xl + f * (xlb - xl) AS xl, s + f * (sb - s) AS s
          FROM (SELECT *, greatest(0, least(1, (t - a0) / seg)) AS f FROM hit WHERE pick = 1)
          UNION ALL
          SELECT survey_id, stick_id, 0, il, xl, s FROM ac WHERE rn = 1 AND total < 1e-9)"""


def _painted(d: int, out: str = "mask", source: str = "pos") -> str:
    return f"""
  ctr_{out} AS (SELECT DISTINCT survey_id, CAST(round_even(il, 0) AS INTEGER) AS il, CAST(round_even(xl, 0) AS INTEGER) AS xl,
                       CAST(round_even(s, 0) AS INTEGER) AS s FROM {source}),
  {out} AS (SELECT DISTINCT survey_id, CAST(il + a.d AS INTEGER) AS il, CAST(xl + b.d AS INTEGER) AS xl, CAST(s + c.d AS INTEGER) AS s
           FROM ctr_{out}, unnest(range({-d}, {d + 1})) AS a(d), unnest(range({-d}, {d + 1})) AS b(d), unnest(range({-d}, {d + 1})) AS c(d)
           WHERE il + a.d BETWEEN 0 AND {_N[0] - 1} AND xl + b.d BETWEEN 0 AND {_N[1] - 1} AND s + c.d BETWEEN 0 AND {_N[2] - 1})"""


@query("r1_densify", f"""WITH {PICKS}, {_dense("picks", "dense")}
  SELECT stick_id, pt_no, step, {q6("il")} AS il, {q6("xl")} AS xl, {q6("s")} AS s FROM dense""")
def r1(spark, sf):
    return raster.densify(picks(spark, sf), ["pt_no"]).select(
        "stick_id", "pt_no", "step", *[r6(F.col(c)).alias(c) for c in ("il", "xl", "s")])


@query("r2_arc_resample", f"""WITH {PICKS}, {_arc("picks", "pt_no")}
  SELECT stick_id, k, {q6("il", 4)} AS il, {q6("xl", 4)} AS xl, {q6("s", 4)} AS s FROM pos""")
def r2(spark, sf):
    return raster.resample(picks(spark, sf), ["pt_no"]).select(
        "stick_id", "k", *[r6(F.col(c), 4).alias(c) for c in ("il", "xl", "s")])


@query("r3_paint_dilate", f"""WITH {PICKS}, {_painted(2, source="picks")} SELECT survey_id, il, xl, s FROM mask""")
def r3(spark, sf):
    return raster.paint(picks(spark, sf), shapes(spark, sf), dilation=2)


def _geometry(spark, sf):
    t = traces(spark, sf)
    return fit_georeference(t, infer_geometry(t))


# picks stand slightly off the lines, so that no position lies on a rounding boundary
@query("r4_world_sticks_to_mask", f"""WITH {PICKS}, off AS (SELECT * REPLACE (xl + 0.001 AS xl) FROM picks),
  {_arc("off", "pt_no")}, {_painted(1)}
  SELECT survey_id, il, xl, s FROM mask""")
def r4(spark, sf):
    geo = _geometry(spark, sf)
    # grid origin and transform of the survey; the pick volume is larger than the recorded one
    volume = geo.withColumns({k: F.lit(v) for k, v in SHAPE.items()})
    return raster.rasterise_world_sticks(
        world_sticks(spark, sf, 0.001), ["pt_no"], three_point_transform(geo), volume, dilation=1)


@query("r5_index_sticks_to_mask", f"""WITH {PICKS}, {_dense("picks", "dense")}, {_arc("dense", "il, pt_no, step")},
  near AS (SELECT survey_id, round(il, 9) AS il, round(xl, 9) AS xl, round(s, 9) AS s FROM pos), {_painted(1, source="near")}
  SELECT survey_id, il, xl, s FROM mask""")
def r5(spark, sf):
    return raster.rasterise_index_sticks(picks(spark, sf), ["pt_no"], shapes(spark, sf), 1, max_gap=5)


def _absolute(spark, sf):
    return picks(spark, sf).select(
        "survey_id", (F.col("il") + 1001).alias("inline"), (F.col("xl") + 1900).alias("crossline"),
        (F.col("s") * 4.0).alias("twt"))


@query("r6_direct_paint", f"""WITH {PICKS},
  c AS (SELECT survey_id, CAST(round_even((il + 1001 - 1001) / (170.0 / 159), 0) AS INTEGER) AS il,
               CAST(round_even((xl + 1900 - 1900) / 1.0, 0) AS INTEGER) AS xl, CAST(round_even(s * 4.0 / 4.0, 0) AS INTEGER) AS s FROM picks)
  SELECT DISTINCT survey_id, CAST(il + a.d AS INTEGER) AS il, CAST(xl + b.d AS INTEGER) AS xl, s
  FROM c, unnest(range(-1, 2)) AS a(d), unnest(range(-1, 2)) AS b(d)
  WHERE il + a.d BETWEEN 0 AND {_N[0] - 1} AND xl + b.d BETWEEN 0 AND {_N[1] - 1} AND s BETWEEN 0 AND {_N[2] - 1}""")
def r6_direct(spark, sf):
    bounds = shapes(spark, sf).withColumns({
        "inline_min": F.lit(1001), "inline_max": F.lit(1171), "crossline_min": F.lit(1900),
        "crossline_max": F.lit(2099), "twt_min": F.lit(0.0), "sample_rate_ms": F.lit(4.0)})
    return raster.paint_points(_absolute(spark, sf), bounds)


@query("r7_dense_mask", f"""WITH {TRACES}, {TRUTH},
  ext AS (SELECT survey_id, max(inline) - min(inline) + 1 AS n_il, max(crossline) - min(crossline) + 1 AS n_xl,
                 max(len(samples)) AS n_s FROM traces GROUP BY survey_id),
  grid AS (SELECT survey_id, CAST(i.v AS INTEGER) AS il, CAST(x.v AS INTEGER) AS xl, CAST(z.v AS INTEGER) AS s
           FROM ext, unnest(range(n_il)) AS i(v), unnest(range(n_xl)) AS x(v), unnest(range(n_s)) AS z(v))
  SELECT g.survey_id, g.il, g.xl, g.s, CAST(t.s IS NOT NULL AS INTEGER) AS mask
  FROM grid g LEFT JOIN truth t ON t.survey_id = g.survey_id AND t.il = g.il AND t.xl = g.xl AND t.s = g.s""")
def r7(spark, sf):
    shape = sized(grid_shape(infer_geometry(traces(spark, sf))))
    return raster.dense_mask(truth(spark, sf), shape).select(
        "survey_id", "il", "xl", F.posexplode("mask").alias("s", "mask")).withColumn(
        "mask", F.col("mask").cast("int"))


@query("r8_grid_mismatch", """
  WITH l AS (SELECT DISTINCT CAST(1001 + user_id // 25 AS INTEGER) AS inline, CAST(1900 + event_id % 25 AS INTEGER) AS crossline FROM events),
       t AS (SELECT DISTINCT CAST(1001 + vec_id // 25 AS INTEGER) AS inline, CAST(1900 + vec_id % 25 AS INTEGER) AS crossline FROM embeddings)
  SELECT inline, crossline, 'labels' AS only_in FROM (SELECT * FROM l EXCEPT SELECT * FROM t)
  UNION ALL SELECT inline, crossline, 'traces' FROM (SELECT * FROM t EXCEPT SELECT * FROM l)""")
def r8(spark, sf):
    labels = table(spark, sf, "events").select(
        F.concat(F.lit("survey_"), F.floor(F.col("user_id") / 1_000_000)).alias("survey_id"), (F.floor(F.col("user_id") / 25) + 1001).cast("int").alias("inline"),
        (F.col("event_id") % 25 + 1900).cast("int").alias("crossline"))
    return raster.grid_mismatch(labels, traces(spark, sf)).select("inline", "crossline", "only_in")


@query("a16_label_gate", f"""WITH {PICKS}, {_painted(1, "base", "picks")}, {_painted(2, "mask", "picks")},
  c AS (SELECT (SELECT count(*) FROM mask) AS f, (SELECT count(*) FROM base) AS b, {_N[0]} * {_N[1]} * {_N[2]} AS n)
  SELECT 'survey_0' AS survey_id, f AS fault_voxels, b AS baseline_voxels, CAST(n AS BIGINT) AS total_voxels,
         {q6("f / n")} AS fault_fraction, {q6("f / greatest(b, 1)")} AS improvement,
         CASE WHEN f = 0 THEN 'FAIL' WHEN f / n < 0.0001 THEN 'WARN' WHEN f / n < 0.005 THEN 'CAUTION' ELSE 'PASS' END AS verdict
  FROM c""")
def a16(spark, sf):
    p, shape = picks(spark, sf), shapes(spark, sf)
    report = qc.label_report(raster.paint(p, shape, 2), raster.paint(p, shape, 1), shape)
    return report.withColumns({c: r6(F.col(c)) for c in ("fault_fraction", "improvement")})
