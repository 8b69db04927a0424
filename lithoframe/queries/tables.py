"""The driver tables seen as survey data, in Spark and as SQL fragments.

Every mapping uses all rows of its table. SQL fragments are lists of common table expressions to be
placed after WITH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def _headers(il: Column, xl: Column) -> dict[str, Column]:
    """Positions on a sheared grid, stored tenfold with scalar -10 as trace headers do."""
    return {
        "cdp_x": F.rint((15.5 * il + 21.0 * xl + 482000.0) * 10),
        "cdp_y": F.rint((20.0 * il - 6.5 * xl + 5214000.0) * 10),
        "coord_scalar": F.lit(-10),
        "delay_ms": F.lit(0.0),
        "dt_ms": F.lit(4.0),
        "n_samples": F.size("samples"),
    }


PER_SURVEY = 1_000_000


def _survey(number: Column) -> Column:
    return F.concat(F.lit("survey_"), F.floor(number / PER_SURVEY))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangular surveys of up to a million traces, 25 crosslines per inline."""
    e = table(spark, sf, "embeddings")
    base = e.select(
        _survey(F.col("vec_id")).alias("survey_id"), F.col("vec_id").alias("trace_no"),
        (F.floor(F.col("vec_id") % PER_SURVEY / 25) + 1001).cast("int").alias("inline"),
        (F.col("vec_id") % 25 + 1900).cast("int").alias("crossline"),
        F.col("embedding").alias("samples"))
    return base.withColumns(_headers(F.col("inline"), F.col("crossline")))


TRACES = """
  traces AS (
    SELECT 'survey_' || (vec_id // 1000000) AS survey_id, vec_id AS trace_no,
           CAST(1001 + vec_id % 1000000 // 25 AS INTEGER) AS inline,
           CAST(1900 + vec_id % 25 AS INTEGER) AS crossline, embedding AS samples
    FROM embeddings),
  voxels AS (
    SELECT survey_id, inline, crossline, CAST(t.s AS INTEGER) AS s,
           CAST(samples[t.s + 1] AS DOUBLE) AS a
    FROM traces, unnest(range(len(samples))) AS t(s)),
  geom AS (
    SELECT min(inline) AS il0, max(inline) AS il1, count(DISTINCT inline) AS n_il,
           min(crossline) AS xl0, max(crossline) AS xl1, count(DISTINCT crossline) AS n_xl
    FROM traces)
"""

# Needs dims. Every voxel of the grid, zeros where no trace was recorded; held tells recorded voxels.
FILLED = """
  grid AS (SELECT CAST(i.v AS INTEGER) AS il, CAST(x.v AS INTEGER) AS xl, CAST(z.v AS INTEGER) AS s
           FROM dims, unnest(range(n_il)) AS i(v), unnest(range(n_xl)) AS x(v), unnest(range(n_s)) AS z(v)),
  filled AS (SELECT g.il, g.xl, g.s, coalesce(v.a, 0.0) AS a, v.s IS NOT NULL AS held
             FROM grid g LEFT JOIN voxels v ON v.inline - 1001 = g.il AND v.crossline - 1900 = g.xl AND v.s = g.s)
"""


def irregular_traces(spark: SparkSession, sf: str) -> DataFrame:
    """One survey per label on a coarse grid: cells are missing, and some are recorded twice."""
    e = table(spark, sf, "embeddings")
    base = e.select(
        F.concat(F.lit("label_"), F.col("label")).alias("survey_id"),
        F.col("vec_id").alias("trace_no"),
        (F.floor(F.col("vec_id") / 50) * 2 + 1001).cast("int").alias("inline"),
        (F.floor(F.col("vec_id") % 25 / 5) * 3 + 1900).cast("int").alias("crossline"),
        F.col("embedding").alias("samples"))
    return base.withColumns(_headers(F.col("inline"), F.col("crossline")))


IRREGULAR = """
  traces AS (
    SELECT 'label_' || label AS survey_id, vec_id AS trace_no,
           CAST(1001 + (vec_id // 50) * 2 AS INTEGER) AS inline,
           CAST(1900 + ((vec_id % 25) // 5) * 3 AS INTEGER) AS crossline, embedding AS samples
    FROM embeddings),
  ils AS (SELECT survey_id, inline AS num, row_number() OVER (PARTITION BY survey_id ORDER BY inline) AS rn
          FROM (SELECT DISTINCT survey_id, inline FROM traces)),
  xls AS (SELECT survey_id, crossline AS num, row_number() OVER (PARTITION BY survey_id ORDER BY crossline) AS rn
          FROM (SELECT DISTINCT survey_id, crossline FROM traces)),
  ila AS (SELECT survey_id, min(num) AS inline_min, max(num) AS inline_max,
                 coalesce(min(num) FILTER (WHERE rn = 2) - min(num), 1) AS inline_step, count(*) AS n_inlines
          FROM ils GROUP BY survey_id),
  xla AS (SELECT survey_id, min(num) AS crossline_min, max(num) AS crossline_max,
                 coalesce(min(num) FILTER (WHERE rn = 2) - min(num), 1) AS crossline_step, count(*) AS n_crosslines
          FROM xls GROUP BY survey_id),
  rec AS (SELECT survey_id, count(*) AS n_traces, max(len(samples)) AS n_samples FROM traces GROUP BY survey_id),
  geom AS (SELECT * FROM ila JOIN xla USING (survey_id) JOIN rec USING (survey_id))
"""


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """A probability volume: a logistic of the amplitude."""
    return traces(spark, sf).select(
        F.concat(F.lit("run-"), F.col("survey_id")).alias("run_id"), "survey_id", "inline", "crossline",
        F.transform("samples", lambda a: 1.0 / (1.0 + F.exp(-8.0 * a.cast("double")))).alias("prob"))


PROBS = """
  probs AS (SELECT survey_id, inline, crossline, s, a, 1.0 / (1.0 + exp(-8.0 * a)) AS p FROM voxels)
"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Fault voxels in index space: strong amplitudes of the rectangular survey."""
    return traces(spark, sf).select(
        "survey_id", (F.col("inline") - 1001).alias("il"), (F.col("crossline") - 1900).alias("xl"),
        F.posexplode("samples").alias("s", "a")).where(F.col("a") > 0.25).select(
        "survey_id", "il", "xl", "s")


TRUTH = """
  truth AS (SELECT survey_id, inline - 1001 AS il, crossline - 1900 AS xl, s FROM voxels WHERE a > 0.25)
"""


def predicted(spark: SparkSession, sf: str, threshold: float = 0.85) -> DataFrame:
    """Predicted fault voxels in index space, with their probability."""
    return probs(spark, sf).select(
        "survey_id", (F.col("inline") - 1001).alias("il"), (F.col("crossline") - 1900).alias("xl"),
        F.posexplode("prob").alias("s", "p")).where(F.col("p") >= threshold)


PREDICTED = """
  pred AS (SELECT survey_id, inline - 1001 AS il, crossline - 1900 AS xl, s FROM probs WHERE p >= 0.85)
"""

SHAPE = {"n_inlines": 160, "n_crosslines": 200, "n_samples": 300}


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """Fault picks in index space: one stick per user, points in event order."""
    e = table(spark, sf, "events")
    id_, user = F.col("event_id"), F.col("user_id")
    return e.select(
        _survey(user).alias("survey_id"), user.alias("stick_id"), id_.alias("pt_no"),
        ((user * 37 + id_ % 11) % 150).cast("double").alias("il"),
        ((user * 53) % 180 + F.col("value") % 9.0).alias("xl"),
        ((user * 71) % 280 + id_ % 7).cast("double").alias("s"))


PICKS = """
  picks AS (
    SELECT 'survey_' || (user_id // 1000000) AS survey_id, user_id AS stick_id, event_id AS pt_no,
           CAST((user_id * 37 + event_id % 11) % 150 AS DOUBLE) AS il,
           CAST((user_id * 53) % 180 AS DOUBLE) + value % 9.0 AS xl,
           CAST((user_id * 71) % 280 + event_id % 7 AS DOUBLE) AS s
    FROM events)
"""


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Extent of the index space the picks live in, one row per survey."""
    return picks(spark, sf).select("survey_id").distinct().select(
        "survey_id", *[F.lit(v).alias(k) for k, v in SHAPE.items()])


def world_sticks(spark: SparkSession, sf: str, shift: float = 0.0) -> DataFrame:
    """The same picks in world metres and milliseconds, ``shift`` crosslines to the side."""
    p = picks(spark, sf)
    il, xl = F.col("il") + 1001, F.col("xl") + (1900 + shift)
    return p.select("survey_id", "stick_id", "pt_no",
                    (15.5 * il + 21.0 * xl + 482000.0).alias("x"),
                    (20.0 * il - 6.5 * xl + 5214000.0).alias("y"), (F.col("s") * 4.0).alias("z"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Stick text in the petrel-like layout: one file per event type, a line per event."""
    e = table(spark, sf, "events")
    id_, user = F.col("event_id"), F.col("user_id")
    xyz = F.concat_ws(" ", (user * 10).cast("string"), F.col("value").cast("string"),
                      (id_ % 500).cast("string"))
    name = F.concat(F.lit("F"), F.floor(id_ / 64) % 9)
    kind = id_ % 13
    text = (F.when(kind == 0, F.concat(F.lit("FAULT "), name))
            .when(kind == 1, F.concat(F.lit("# "), F.col("event_type")))
            .when(kind == 2, F.lit("   "))
            .when(kind == 3, F.concat(name, F.lit(" 1.0 x 3")))
            .when(kind < 9, F.concat(name, F.lit("  "), xyz))
            .otherwise(F.concat(F.lit("\t"), xyz)))
    return e.select(F.concat("event_type", F.lit(".dat")).alias("file"),
                    id_.alias("line_no"), text.alias("line"))


LINES = """
  lines AS (
    SELECT event_type || '.dat' AS file, event_id AS line_no,
           CASE WHEN event_id % 13 = 0 THEN 'FAULT ' || nm
                WHEN event_id % 13 = 1 THEN '# ' || event_type
                WHEN event_id % 13 = 2 THEN '   '
                WHEN event_id % 13 = 3 THEN nm || ' 1.0 x 3'
                WHEN event_id % 13 < 9 THEN nm || '  ' || xyz
                ELSE chr(9) || xyz END AS line
    FROM (SELECT *, 'F' || ((event_id // 64) % 9) AS nm,
                 (user_id * 10) || ' ' || value || ' ' || (event_id % 500) AS xyz FROM events))
"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Interpretation runs: one per order."""
    o = table(spark, sf, "orders")
    run_id = F.md5(F.col("o_orderkey").cast("string"))
    status = (F.when(F.col("o_orderstatus") == "F", "complete")
              .when(F.col("o_orderstatus") == "O", "running")
              .when(F.col("o_totalprice") < 100000, "failed").otherwise("pending"))
    done = status == "complete"
    fraction = F.col("o_totalprice") / 999983.0
    return o.select(
        run_id.alias("run_id"), F.concat(F.lit("survey-"), F.col("o_custkey")).alias("survey_id"),
        status.alias("status"),
        F.when(done, F.concat(F.lit("results/"), run_id, F.lit("/prob"))).alias("prob_zarr_path"),
        F.when(done, F.concat(F.lit("results/"), run_id, F.lit("/mask"))).alias("mask_zarr_path"),
        F.when(done, fraction).alias("fault_voxel_fraction"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(done, F.col("o_orderdate")).alias("completed_at"),
        F.when(status == "failed", F.lit("out of memory")).alias("error"))


RUNS = """
  runs AS (
    SELECT run_id, survey_id, status,
           CASE WHEN status = 'complete' THEN 'results/' || run_id || '/prob' END AS prob_zarr_path,
           CASE WHEN status = 'complete' THEN 'results/' || run_id || '/mask' END AS mask_zarr_path,
           CASE WHEN status = 'complete' THEN o_totalprice / 999983.0 END AS fault_voxel_fraction,
           o_orderdate AS updated_at,
           CASE WHEN status = 'complete' THEN o_orderdate END AS completed_at,
           CASE WHEN status = 'failed' THEN 'out of memory' END AS error
    FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS run_id, 'survey-' || o_custkey AS survey_id,
                 CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'running'
                      WHEN o_totalprice < 100000 THEN 'failed' ELSE 'pending' END AS status
          FROM orders))
"""


def wells(spark: SparkSession, sf: str) -> DataFrame:
    """Wells from suppliers; formation tops from the line items they delivered."""
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    depth = F.col("l_extendedprice") / 10.0
    tvdss = F.when(F.col("l_tax") == 0, F.lit(0.0)).when(
        F.col("l_tax") > 0.04, F.col("l_extendedprice") / 11.0)
    # the shallowest top of a formation stands for it, so a well holds at most one top per formation
    tops = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_suppkey", "p_type").agg(
        F.min(F.struct(depth.alias("depth_m"), F.col("l_orderkey"), F.col("l_linenumber"),
                       tvdss.alias("tvdss_m"))).alias("t"))
    nested = tops.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("p_type").alias("formation"), F.col("t.depth_m").alias("depth_m"),
        F.col("t.tvdss_m").alias("tvdss_m")))).alias("formation_tops"))
    s = table(spark, sf, "supplier")
    return s.join(nested, s.s_suppkey == nested.l_suppkey, "left").select(
        F.concat(F.lit("15/9-"), F.col("s_suppkey")).alias("well_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("survey-"), F.col("s_nationkey")).alias("survey_id"),
        F.when(F.col("s_acctbal") < 0, "exploration").otherwise("production").alias("well_type"),
        F.coalesce("formation_tops", F.array().cast(nested.schema["formation_tops"].dataType))
        .alias("formation_tops"))


WELLS = """
  tops AS (
    SELECT '15/9-' || l_suppkey AS well_id, p_type AS formation, t.d AS depth_m, t.v AS tvdss_m
    FROM (SELECT l_suppkey, p_type,
                 min({'d': l_extendedprice / 10.0, 'o': l_orderkey, 'n': l_linenumber,
                      'v': CASE WHEN l_tax = 0 THEN 0.0
                                WHEN l_tax > 0.04 THEN l_extendedprice / 11.0 END}) AS t
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)),
  wells AS (
    SELECT '15/9-' || s_suppkey AS well_id, s_name AS name, 'survey-' || s_nationkey AS survey_id,
           CASE WHEN s_acctbal < 0 THEN 'exploration' ELSE 'production' END AS well_type
    FROM supplier)
"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """A file registry: one row per document."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("component"), F.col("source").alias("survey"),
        F.concat_ws("/", F.lit("raw"), "source", F.col("doc_id").cast("string")).alias("file_path"),
        F.col("n_chars").alias("file_size_bytes"))


REGISTRY = """
  registry AS (
    SELECT lang AS component, source AS survey, 'raw/' || source || '/' || doc_id AS file_path,
           n_chars AS file_size_bytes FROM documents)
"""


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """An object store listing: one object per page."""
    path = F.regexp_replace(F.col("url"), "^https?://", "")
    return table(spark, sf, "pages").select(
        F.lit("raw").alias("container"), path.alias("path"), F.length("html").cast("long").alias("size"))


OBJECTS = """
  objects AS (
    SELECT 'raw' AS container, regexp_replace(url, '^https?://', '') AS path,
           CAST(length(html) AS BIGINT) AS size FROM pages)
"""


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Batch results of training runs: a run per supplier, an epoch per order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("epoch"),
        F.when(F.col("l_returnflag") == "R", "val").otherwise("train").alias("phase"),
        (F.col("l_tax") * 10).alias("loss"),
        F.col("l_quantity").alias("tp"), (F.col("l_discount") * 100).alias("fp"),
        (F.col("l_tax") * 100).alias("fn"))


EPOCHS = """
  batches AS (
    SELECT l_suppkey AS run_id, l_orderkey AS epoch,
           CASE WHEN l_returnflag = 'R' THEN 'val' ELSE 'train' END AS phase,
           l_tax * 10 AS loss, l_quantity AS tp, l_discount * 100 AS fp, l_tax * 100 AS fn
    FROM lineitem)
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages: assistant turns make calls, a user turn after the first answers call 0 of the turn before."""
    c = table(spark, sf, "conversations")
    answers = (F.col("role") == "user") & (F.col("turn") > 0)
    call = lambda turn, k: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"), k.cast("string"))
    n = F.when(F.col("role") == "assistant", F.length("text") % 3).otherwise(0).cast("int")
    none = F.array().cast("array<int>")
    calls = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none),
                        lambda k: F.struct(call(F.col("turn"), k).alias("id"), F.lit("tool").alias("name")))
    return c.select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"),
        F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        calls.alias("tool_calls"), F.when(answers, call(F.col("turn") - 1, F.lit(0))).alias("tool_call_id"))


def well_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log runs: the line items of a supplier as readings, 256 order numbers to a run."""
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax")
    grouped = line.groupBy("l_suppkey", F.floor(F.col("l_orderkey") / 256).alias("log_run")).agg(F.sort_array(F.collect_list(order)).alias("r"))
    curve = lambda name, unit, values: F.struct(
        F.lit(name).alias("mnemonic"), F.lit(unit).alias("unit"), F.lit("").alias("description"), values.alias("values"))
    return grouped.select(
        F.concat(F.lit("15/9-"), "l_suppkey").alias("well_id"), F.lit("m").alias("depth_unit"),
        F.transform("r", lambda x: x["l_extendedprice"]).alias("depth_values"),
        F.array(curve("GR", "api", F.transform("r", lambda x: x["l_quantity"])),
                curve("RT", "ohm", F.transform("r", lambda x: F.nullif(x["l_tax"], F.lit(0.0))))).alias("curves"))
