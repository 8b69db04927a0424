"""Patch grid, balance, extraction and sampling queries."""

from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized
from lithoframe.operators import patches as t
from lithoframe.operators import raster
from lithoframe.operators.geometry import grid_shape, infer_geometry
from lithoframe.queries import query
from lithoframe.queries.tables import FILLED, TRACES, TRUTH, q6, r6, traces, truth

PATCH = (8, 8, 16)
STRIDE = (4, 6, 16)

_BASE = f"""{TRACES},
  dims AS (SELECT CAST(max(inline) - 1000 AS INTEGER) AS n_il, 25 AS n_xl, 64 AS n_s FROM traces)"""


def _index_sql(patch=PATCH, stride=STRIDE):
    return f"""
  idx AS (
    SELECT 'survey_0' AS survey_id, CAST(a.v AS INTEGER) AS il0, CAST(b.v AS INTEGER) AS xl0, CAST(c.v AS INTEGER) AS s0,
           CASE WHEN a.v + {patch[0] // 2} < CAST(floor(n_il * 0.7) AS INTEGER) THEN 'train'
                WHEN a.v + {patch[0] // 2} < CAST(floor(n_il * 0.7) AS INTEGER) + CAST(floor(n_il * 0.15) AS INTEGER) THEN 'val'
                ELSE 'test' END AS split
    FROM dims, unnest(range(0, n_il - {patch[0]} + 1, {stride[0]})) AS a(v),
         unnest(range(0, n_xl - {patch[1]} + 1, {stride[1]})) AS b(v),
         unnest(range(0, n_s - {patch[2]} + 1, {stride[2]})) AS c(v)),
  cnt AS (
    SELECT i.*, count(f.s) AS fault_voxels FROM idx i LEFT JOIN truth f
      ON f.il >= i.il0 AND f.il < i.il0 + {patch[0]} AND f.xl >= i.xl0 AND f.xl < i.xl0 + {patch[1]}
     AND f.s >= i.s0 AND f.s < i.s0 + {patch[2]} GROUP BY ALL)"""


def geometry_of(spark, sf):
    return infer_geometry(traces(spark, sf))


def shape_of(spark, sf):
    """Extent of the grid, lines that were never recorded included."""
    return sized(grid_shape(geometry_of(spark, sf)))


def volume(spark, sf):
    return t.to_index_space(traces(spark, sf), geometry_of(spark, sf))


def _counted(spark, sf):
    shape = shape_of(spark, sf)
    return t.with_fault_counts(t.patch_index(shape, PATCH, STRIDE), truth(spark, sf), shape, PATCH, STRIDE)


@query("t1_patch_index", f"WITH {_BASE}, {TRUTH}, {_index_sql()} SELECT survey_id, il0, xl0, s0 FROM idx")
def t1(spark, sf):
    return t.patch_index(shape_of(spark, sf), PATCH, STRIDE).drop("split")


@query("t2_spatial_split", f"WITH {_BASE}, {TRUTH}, {_index_sql()} SELECT il0, xl0, s0, split FROM idx")
def t2(spark, sf):
    return t.patch_index(shape_of(spark, sf), PATCH, STRIDE).select("il0", "xl0", "s0", "split")


@query("t3_contiguous_split", f"""WITH {_BASE}
  SELECT inline - 1001 AS il, crossline - 1900 AS xl,
         CASE WHEN inline - 1001 < CAST(floor(n_il * 0.7) AS INTEGER) THEN 'train'
              WHEN inline - 1001 < CAST(floor(n_il * 0.85) AS INTEGER) THEN 'val'
              ELSE 'test' END AS split FROM traces, dims""")
def t3(spark, sf):
    return t.split_volume(volume(spark, sf), shape_of(spark, sf)).select("il", "xl", "split")


@query("t4_min_fault_fraction", f"""WITH {_BASE}, {TRUTH}, {_index_sql()}
  SELECT il0, xl0, s0, fault_voxels FROM cnt WHERE fault_voxels / {8 * 8 * 16}.0 >= 0.02""")
def t4(spark, sf):
    return t.keep_faulted(_counted(spark, sf), PATCH, 0.02).select("il0", "xl0", "s0", "fault_voxels")


# patches that hold a trace, zeros where one is missing
_VALUES = f"""{FILLED},
  px AS (
    SELECT i.il0, i.xl0, i.s0, v.a, row_number() OVER (PARTITION BY i.il0, i.xl0, i.s0 ORDER BY v.il, v.xl, v.s) - 1 AS pos,
           CAST(v.a > 0.25 AS INTEGER) AS y
    FROM idx i JOIN filled v ON v.il >= i.il0 AND v.il < i.il0 + 8 AND v.xl >= i.xl0
         AND v.xl < i.xl0 + 8 AND v.s >= i.s0 AND v.s < i.s0 + 16
    QUALIFY bool_or(v.held) OVER (PARTITION BY i.il0, i.xl0, i.s0))"""


def _cut(spark, sf, **kw):
    return t.cut_patches(volume(spark, sf), shape_of(spark, sf), PATCH, STRIDE, **kw)


@query("t5_patch_extraction", f"""WITH {_BASE}, {TRUTH}, {_index_sql()}, {_VALUES}
  SELECT il0, xl0, s0, CAST(pos AS INTEGER) AS pos, {q6("a")} AS x, y FROM px""")
def t5(spark, sf):
    shape = shape_of(spark, sf)
    labels = raster.dense_mask(truth(spark, sf), shape)
    both = volume(spark, sf).join(labels, ["survey_id", "il", "xl"])
    cut = t.cut_patches(both, shape, PATCH, STRIDE, label="mask")
    return cut.select("il0", "xl0", "s0", F.posexplode(F.arrays_zip("patch", "label")).alias("pos", "v")).select(
        "il0", "xl0", "s0", "pos", r6(F.col("v.patch").cast("double")).alias("x"), F.col("v.label").cast("int").alias("y"))


# patches of every survey on its own grid, which first lines and steps fix, as infer_geometry() has them
_OWN = f"""{TRACES},
  ils AS (SELECT survey_id, inline AS num, row_number() OVER (PARTITION BY survey_id ORDER BY inline) AS rn
          FROM (SELECT DISTINCT survey_id, inline FROM traces)),
  xls AS (SELECT survey_id, crossline AS num, row_number() OVER (PARTITION BY survey_id ORDER BY crossline) AS rn
          FROM (SELECT DISTINCT survey_id, crossline FROM traces)),
  ila AS (SELECT survey_id, min(num) AS il_min, max(num) AS il_max,
                 coalesce(min(num) FILTER (WHERE rn = 2) - min(num), 1) AS il_step FROM ils GROUP BY survey_id),
  xla AS (SELECT survey_id, min(num) AS xl_min, max(num) AS xl_max,
                 coalesce(min(num) FILTER (WHERE rn = 2) - min(num), 1) AS xl_step FROM xls GROUP BY survey_id),
  own AS (SELECT *, (il_max - il_min) // il_step + 1 AS n_il, (xl_max - xl_min) // xl_step + 1 AS n_xl
          FROM ila JOIN xla USING (survey_id)
          JOIN (SELECT survey_id, max(len(samples)) AS n_s FROM traces GROUP BY survey_id) USING (survey_id)),
  cells AS (
    SELECT survey_id, CAST(a.v AS INTEGER) AS il0, CAST(b.v AS INTEGER) AS xl0, CAST(c.v AS INTEGER) AS s0,
           a.v + i.v AS il, b.v + x.v AS xl, c.v + z.v AS s, (i.v * {PATCH[1]} + x.v) * {PATCH[2]} + z.v AS pos
    FROM own, unnest(range(0, n_il - {PATCH[0]} + 1, {STRIDE[0]})) AS a(v),
         unnest(range(0, n_xl - {PATCH[1]} + 1, {STRIDE[1]})) AS b(v),
         unnest(range(0, n_s - {PATCH[2]} + 1, {STRIDE[2]})) AS c(v),
         unnest(range({PATCH[0]})) AS i(v), unnest(range({PATCH[1]})) AS x(v), unnest(range({PATCH[2]})) AS z(v)),
  placed AS (
    SELECT survey_id, (inline - il_min) // il_step AS il, (crossline - xl_min) // xl_step AS xl, s, a
    FROM voxels JOIN own USING (survey_id)),
  px AS (
    SELECT c.survey_id, c.il0, c.xl0, c.s0, c.pos, coalesce(v.a, 0.0) AS a
    FROM cells c LEFT JOIN placed v ON v.survey_id = c.survey_id AND v.il = c.il AND v.xl = c.xl AND v.s = c.s
    QUALIFY bool_or(v.s IS NOT NULL) OVER (PARTITION BY c.survey_id, c.il0, c.xl0, c.s0))"""


_Z = f"""SELECT il0, xl0, s0, CAST(pos AS INTEGER) AS pos,
         {q6("CAST((a - avg(a) OVER w) / (stddev_pop(a) OVER w + 1e-8) AS FLOAT)", 4)} AS z FROM px WINDOW w AS (PARTITION BY survey_id, il0, xl0, s0)"""


@query("t6_patch_zscore", f"WITH {_OWN} {_Z}")
def t6(spark, sf):
    return _cut(spark, sf, transform=t.zscore).select(
        "il0", "xl0", "s0", F.posexplode("patch").alias("pos", "z")).withColumn(
        "z", r6(F.col("z").cast("double"), 4))


@query("t7_patch_zscore_guarded", f"""WITH {_OWN},
  flat AS (SELECT * REPLACE (CASE WHEN (il0 + xl0) % 4 = 0 THEN 0.25 WHEN xl0 % 4 = 0 THEN a * 1e-7 ELSE a END AS a) FROM px)
  SELECT il0, xl0, s0, CAST(pos AS INTEGER) AS pos,
         {q6("CAST(CASE WHEN stddev_pop(a) OVER w > 1e-8 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE a END AS FLOAT)", 4)} AS z
  FROM flat WINDOW w AS (PARTITION BY survey_id, il0, xl0, s0)""")
def t7(spark, sf):
    """Some patches are made flat, some nearly flat."""
    flat = lambda x: F.transform(x, lambda v: F.when((F.col("il0") + F.col("xl0")) % 4 == 0, F.lit(0.25)).when(
        F.col("xl0") % 4 == 0, v.cast("double") * 1e-7).otherwise(v.cast("double")))
    return _cut(spark, sf, transform=lambda x: t.zscore_unless_flat(flat(x))).select(
        "il0", "xl0", "s0", F.posexplode("patch").alias("pos", "z")).withColumn(
        "z", r6(F.col("z").cast("double"), 4))


@query("t8_covering_windows", f"""WITH {_BASE},
  st AS (SELECT 'il' AS axis, n_il AS n, 8 AS p, 6 AS st FROM dims UNION ALL SELECT 'xl', n_xl, 8, 6 FROM dims
         UNION ALL SELECT 's', n_s, 16, 12 FROM dims)
  SELECT axis, CAST(v AS INTEGER) AS start FROM (
    SELECT axis, g.v AS v FROM st, unnest(range(0, n - p + 1, st)) AS g(v)
    UNION SELECT axis, n - p FROM st)""")
def t8(spark, sf):
    shape = shape_of(spark, sf)
    stride = t.overlap_stride(PATCH, 0.25)
    axis = lambda i: shape.select(F.lit(t.AXES[i][0]).alias("axis"), F.explode(
        t.starts(F.col(t.AXES[i][1]), PATCH[i], stride[i], tail=True)).alias("start"))
    return axis(0).unionByName(axis(1)).unionByName(axis(2))


@query("t9_patch_clamp", f"""WITH {_BASE}
  SELECT least(128, n_il) AS p_il, least(16, n_xl) AS p_xl, least(128, n_s) AS p_s FROM dims""")
def t9(spark, sf):
    shape = shape_of(spark, sf).select([n for _, n in t.AXES]).first()  # the one survey's
    return spark.createDataFrame([t.clamp_patch((128, 16, 128), tuple(shape))], "p_il int, p_xl int, p_s int")


@query("t11_fault_aware_weights", f"""WITH {_BASE}, {TRUTH}, {_index_sql()}
  SELECT il0, xl0, s0, CAST(CASE WHEN fault_voxels > 0 THEN 50 ELSE 1 END AS DOUBLE) AS weight FROM cnt""")
def t11(spark, sf):
    return t.fault_weights(_counted(spark, sf)).select("il0", "xl0", "s0", "weight")


@query("t12_weighted_sampling", f"""WITH {_BASE}, {TRUTH}, {_index_sql()},
  w AS (SELECT *, CAST(CASE WHEN fault_voxels > 0 THEN 50 ELSE 1 END AS DOUBLE) AS weight FROM cnt WHERE split = 'train'),
  e AS (SELECT *, sum(weight) OVER (ORDER BY il0, xl0, s0) AS upto, sum(weight) OVER () AS total, count(*) OVER () AS n FROM w),
  d AS (SELECT draw, CAST(CAST('0x' || substr(md5('7|survey_0|' || draw), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 * total AS point
        FROM (SELECT DISTINCT total, n FROM e), unnest(range(0, least(200, n))) t(draw))
  SELECT CAST(draw AS INTEGER) AS draw, survey_id, il0, xl0, s0, weight FROM d JOIN e ON point >= upto - weight AND point < upto""")
def t12(spark, sf):
    train = _counted(spark, sf).where(F.col("split") == "train")
    return t.sample_weighted(t.fault_weights(train), k=200, seed=7)


@query("t13_split_counts", f"""WITH {_BASE}, {TRUTH}, {_index_sql()}
  SELECT split, count(*) AS patches, count(*) FILTER (WHERE fault_voxels > 0) AS fault_patches FROM cnt GROUP BY split""")
def t13(spark, sf):
    return t.split_counts(_counted(spark, sf)).select("split", "patches", "fault_patches")


@query("t14_transform_hooks", f"""WITH {_OWN}
  SELECT il0, xl0, s0, CAST(pos AS INTEGER) AS pos, {q6("-2.0 * a")} AS x, 1 - 0 AS y FROM px""")
def t14(spark, sf):
    cut = _cut(spark, sf, transform=lambda p: F.transform(p, lambda x: x.cast("double") * -2.0),
               label_transform=lambda y: F.transform(y, lambda v: F.lit(1) - v.cast("int")))
    return cut.select("il0", "xl0", "s0", F.posexplode(F.arrays_zip("patch", "label")).alias("pos", "v")).select(
        "il0", "xl0", "s0", "pos", r6(F.col("v.patch")).alias("x"), F.col("v.label").alias("y"))
