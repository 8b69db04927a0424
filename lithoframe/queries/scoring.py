"""Scoring queries with the built-in scorer."""

from pyspark.sql import functions as F

from lithoframe.operators import patches, scoring
from lithoframe.queries import query
from lithoframe.queries.patches import PATCH, geometry_of, shape_of, volume
from lithoframe.queries.tables import FILLED, TRACES, q6, r6

_OVERLAP = 0.25  # strides 6, 6, 12

_STARTS = """
  dims AS (SELECT CAST(max(inline) - 1000 AS INTEGER) AS n_il, 25 AS n_xl, 64 AS n_s FROM traces),
  wi AS (SELECT unnest(range(0, n_il - 8 + 1, 6)) AS v FROM dims UNION SELECT n_il - 8 FROM dims WHERE {tail}),
  wx AS (SELECT unnest(range(0, n_xl - 8 + 1, 6)) AS v FROM dims UNION SELECT n_xl - 8 FROM dims WHERE {tail}),
  ws AS (SELECT unnest(range(0, n_s - 16 + 1, 12)) AS v FROM dims UNION SELECT n_s - 16 FROM dims WHERE {tail}),
"""
_RECORDED = """
  px AS (
    SELECT i.v AS il0, x.v AS xl0, z.v AS s0, inline - 1001 AS il, crossline - 1900 AS xl, s, a
    FROM voxels, wi i, wx x, ws z
    WHERE inline - 1001 >= i.v AND inline - 1001 < i.v + 8 AND crossline - 1900 >= x.v AND crossline - 1900 < x.v + 8
      AND s >= z.v AND s < z.v + 16),"""
# windows that hold a trace, zeros where one is missing; {any} leaves out the others
_PADDED = f"""{FILLED},
  px AS (
    SELECT i.v AS il0, x.v AS xl0, z.v AS s0, il, xl, s, a
    FROM filled, wi i, wx x, ws z
    WHERE il >= i.v AND il < i.v + 8 AND xl >= x.v AND xl < x.v + 8 AND s >= z.v AND s < z.v + 16{{any}}),"""
_ANY_TRACE = " QUALIFY bool_or(held) OVER (PARTITION BY i.v, x.v, z.v)"
_SCORES = """
  sc AS (SELECT *, 1.0 / (1.0 + exp(-(a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8))) AS p FROM px
         WINDOW w AS (PARTITION BY il0, xl0, s0)),
  wt AS (SELECT *, exp(-(pow(il - il0 - 3.5, 2) + pow(xl - xl0 - 3.5, 2) + pow(s - s0 - 7.5, 2)) / 8.0) AS w FROM sc)"""
_WINDOWS = _STARTS + _RECORDED + _SCORES
_TAILED = f"{TRACES}, {_WINDOWS.format(tail='true')}"
_PADDED_TAILED = f"{TRACES}, {(_STARTS + _PADDED + _SCORES).format(tail='true', any=_ANY_TRACE)}"
_PLAIN = f"{TRACES}, {_WINDOWS.format(tail='false')}"


@query("i1_batch_scoring", f"""WITH {_PADDED_TAILED}
  SELECT CAST(il0 AS INTEGER) AS il0, CAST(xl0 AS INTEGER) AS xl0, CAST(s0 AS INTEGER) AS s0,
         CAST((il - il0) * 128 + (xl - xl0) * 16 + s - s0 AS INTEGER) AS pos, {q6("CAST(p AS FLOAT)", 4)} AS p FROM sc""")
def i1(spark, sf):
    cut = patches.cut_patches(volume(spark, sf), shape_of(spark, sf), PATCH,
                              patches.overlap_stride(PATCH, _OVERLAP), tail=True)
    return scoring.score_patches(cut, PATCH).select(
        "il0", "xl0", "s0", F.posexplode("prob").alias("pos", "p")).withColumn(
        "p", r6(F.col("p").cast("double"), 4))


@query("i2_gaussian_weights", f"""WITH {_TAILED}
  SELECT CAST(il AS INTEGER) AS il, CAST(xl AS INTEGER) AS xl, s, {q6("sum(w) / exp(-0.75 / 8.0)")} AS weight
  FROM wt GROUP BY il, xl, s""")
def i2(spark, sf):
    return scoring.window_weight(volume(spark, sf), shape_of(spark, sf), PATCH, _OVERLAP).select(
        "il", "xl", F.posexplode("weight").alias("s", "weight")).withColumn("weight", r6(F.col("weight")))


def _probs(spark, sf, uniform=False):
    return scoring.score_volume(volume(spark, sf), shape_of(spark, sf), PATCH, overlap=_OVERLAP, uniform=uniform)


@query("i3_overlap_blend", f"""WITH {_PADDED_TAILED}
  SELECT CAST(il AS INTEGER) AS il, CAST(xl AS INTEGER) AS xl, s, {q6("CAST(sum(p * w) / sum(w) AS FLOAT)", 4)} AS p FROM wt GROUP BY il, xl, s""")
def i3(spark, sf):
    return _probs(spark, sf).select("il", "xl", F.posexplode("prob").alias("s", "p")).withColumn(
        "p", r6(F.col("p").cast("double"), 4))


@query("t10_uniform_tiling", f"""WITH {_PLAIN},
  m AS (SELECT il, xl, s, avg(1.0 / (1.0 + exp(-a))) AS p FROM px GROUP BY il, xl, s)
  SELECT CAST(inline - 1001 AS INTEGER) AS il, CAST(crossline - 1900 AS INTEGER) AS xl, v.s, {q6("CAST(coalesce(m.p, 0) AS FLOAT)", 4)} AS p
  FROM voxels v LEFT JOIN m ON m.il = v.inline - 1001 AND m.xl = v.crossline - 1900 AND m.s = v.s""")
def t10(spark, sf):
    return _probs(spark, sf, uniform=True).select("il", "xl", F.posexplode("prob").alias("s", "p")).withColumn(
        "p", r6(F.col("p").cast("double"), 4))


@query("i4_threshold_mask", f"""WITH {_PADDED_TAILED}
  SELECT survey_id, CAST(il AS INTEGER) AS il, CAST(xl AS INTEGER) AS xl, s FROM (
    SELECT 'survey_0' AS survey_id, il, xl, s, CAST(sum(p * w) / sum(w) AS FLOAT) AS p FROM wt GROUP BY il, xl, s)
  WHERE p >= 0.75""")
def i4(spark, sf):
    return scoring.threshold_mask(_probs(spark, sf), 0.75)


@query("i5_scoring_run", f"""WITH {_TAILED},
  m AS (SELECT il, xl, s, CAST(sum(p * w) / sum(w) AS FLOAT) AS p FROM wt GROUP BY il, xl, s)
  SELECT 'survey_0' AS survey_id, 'complete' AS status, {q6("avg(CAST(p >= 0.75 AS INTEGER))")} AS fault_voxel_fraction,
         CAST(1001 AS INTEGER) AS first_inline, CAST(1000 + max(n_il) AS INTEGER) AS last_inline,
         CAST(25 AS INTEGER) AS crosslines, CAST(252.0 AS DOUBLE) AS last_twt
  FROM m, dims""")
def i5(spark, sf):
    import uuid

    from lithoframe.functions.lineage import checkpoint_dir
    from lithoframe.plans.evaluation import scoring_run
    from lithoframe.queries.tables import traces
    out = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    row = scoring_run(traces(spark, sf), geometry_of(spark, sf), "run-1", out, PATCH, overlap=_OVERLAP, threshold=0.75)
    return row.select("survey_id", "status", r6(F.col("fault_voxel_fraction")).alias("fault_voxel_fraction"),
                      F.array_min("inline_coords").alias("first_inline"), F.array_max("inline_coords").alias("last_inline"),
                      F.size("crossline_coords").alias("crosslines"), F.array_max("twtt_ms").alias("last_twt"))
