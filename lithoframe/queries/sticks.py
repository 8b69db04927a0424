"""Stick parsing queries."""

from pyspark.sql import functions as F

from lithoframe.operators import sticks as k
from lithoframe.queries import query
from lithoframe.queries.tables import LINES, lines, q6, r6, table

_BLOCK = 1000  # small line blocks, so the block-to-block hand-over takes part in the check

_NUM = "TRY_CAST({} AS DOUBLE)"
_TOKENS = f"""{LINES},
  tk AS (SELECT file, line_no, trim(line, ' ' || chr(9)) AS text,
                regexp_split_to_array(trim(line, ' ' || chr(9)), '\\s+') AS tok FROM lines),
  rows AS (SELECT *, len(tok) AS n FROM tk WHERE text <> '')"""
_PETREL = f"""{_TOKENS},
  ev AS (
    SELECT file, line_no, regexp_matches(text, '(?i)^FAULT\\s+\\S+$') AS header,
           CASE WHEN regexp_matches(text, '(?i)^FAULT\\s+\\S+$') THEN tok[2] WHEN n = 4 THEN tok[1] END AS name,
           {_NUM.format("tok[CASE WHEN n = 4 THEN 2 ELSE 1 END]")} AS x,
           {_NUM.format("tok[CASE WHEN n = 4 THEN 3 ELSE 2 END]")} AS y,
           {_NUM.format("tok[CASE WHEN n = 4 THEN 4 ELSE 3 END]")} AS z, n
    FROM rows WHERE substr(text, 1, 1) NOT IN ('#', '!', '/')),
  ok AS (SELECT * FROM ev WHERE header OR (n IN (3, 4) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)),
  prev AS (
    SELECT *, last_value(name IGNORE NULLS) OVER w AS before, count(*) OVER w AS seen FROM ok
    WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  opened AS (SELECT *, coalesce(before, CASE WHEN seen > 0 THEN 'UNKNOWN' END) AS open_name FROM prev),
  numbered AS (
    SELECT *, CAST(sum(CASE WHEN header OR open_name IS NULL OR name <> open_name THEN 1 ELSE 0 END)
              OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS stick_no,
           coalesce(name, open_name, 'UNKNOWN') AS fault_name FROM opened),
  kept AS (SELECT *, count(*) OVER (PARTITION BY file, stick_no) AS m FROM numbered WHERE NOT header)"""


@query("s8_text_lines", f"WITH {LINES} SELECT file, line_no, line FROM lines")
def s8(spark, sf):
    return lines(spark, sf)


@query("k1_petrel_sticks", f"""WITH {_PETREL}
  SELECT file, fault_name, stick_no, line_no, {q6("x")} AS x, {q6("y")} AS y, {q6("z")} AS z FROM kept WHERE m >= 2""")
def k1(spark, sf):
    p = k.parse_petrel(lines(spark, sf), _BLOCK)
    return p.select("file", "fault_name", "stick_no", "line_no", *[r6(F.col(c)).alias(c) for c in "xyz"])


_HEADED = """
  lines AS (
    SELECT event_type || '.txt' AS file, event_id AS line_no,
           CASE WHEN event_id % 17 = 0 THEN 'Fault : ' || props
                WHEN event_id % 17 = 1 THEN '# note'
                WHEN event_id % 17 = 2 THEN user_id || ' ' || value
                ELSE user_id || '  ' || value || ' ' || event_id || ' 7 8' END AS line
    FROM events)"""


def _headed(spark, sf):
    kind = F.col("event_id") % 17
    text = (F.when(kind == 0, F.concat(F.lit("Fault : "), "props")).when(kind == 1, F.lit("# note"))
            .when(kind == 2, F.concat_ws(" ", F.col("user_id").cast("string"), F.col("value").cast("string")))
            .otherwise(F.concat(F.col("user_id"), F.lit("  "), F.col("value"), F.lit(" "), F.col("event_id"),
                                F.lit(" 7 8"))))
    return table(spark, sf, "events").select(
        F.concat("event_type", F.lit(".txt")).alias("file"), F.col("event_id").alias("line_no"),
        text.alias("line"))


_OPENDTECT = _PETREL.replace(LINES, _HEADED).replace("(?i)^FAULT\\s+\\S+$", "(?i)^Fault\\s*:").replace(
    "THEN tok[2] WHEN n = 4 THEN tok[1] END", "THEN trim(substr(text, strpos(text, ':') + 1)) END").replace(
    "CASE WHEN n = 4 THEN 2 ELSE 1 END", "1").replace("CASE WHEN n = 4 THEN 3 ELSE 2 END", "2").replace(
    "CASE WHEN n = 4 THEN 4 ELSE 3 END", "3").replace("n IN (3, 4)", "n >= 3").replace(
    "NOT IN ('#', '!', '/')", "<> '#'")


@query("k2_opendtect_sticks", f"""WITH {_OPENDTECT}
  SELECT file, fault_name, stick_no, line_no, {q6("x")} AS x, {q6("y")} AS y, {q6("z")} AS z FROM kept WHERE m >= 2""")
def k2(spark, sf):
    p = k.parse_opendtect(_headed(spark, sf), _BLOCK)
    return p.select("file", "fault_name", "stick_no", "line_no", *[r6(F.col(c)).alias(c) for c in "xyz"])


def _five(spark, sf):
    c = lambda name: F.col(name).cast("string")
    return table(spark, sf, "events").select(
        F.concat(F.lit("dir/"), "event_type", F.lit(".txt")).alias("file"), F.col("event_id").alias("line_no"),
        F.concat_ws(" ", c("value"), c("user_id"), c("event_id"), F.concat(c("user_id"), F.lit(".7")),
                    ((F.col("event_id") * 7919) % 1000).cast("string")).alias("line"))


_FIVE = """
  lines AS (SELECT event_type AS stem, event_id AS line_no, value AS x, CAST(user_id AS DOUBLE) AS y,
                   CAST(event_id AS DOUBLE) AS z, user_id AS stick_no, (event_id * 7919) % 1000 AS point_id FROM events),
  kept AS (SELECT *, count(*) OVER (PARTITION BY stem, stick_no) AS m FROM lines)"""


@query("k3_five_column_sticks", f"""WITH {_FIVE}
  SELECT stem || '_stick' || stick_no AS fault_name, stick_no, point_id, line_no,
         {q6("x")} AS x, {q6("y")} AS y, {q6("z")} AS z FROM kept WHERE m >= 2""")
def k3(spark, sf):
    return k.parse_five_column(_five(spark, sf)).select(
        "fault_name", "stick_no", "point_id", "line_no", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query("k4_index_dat_sticks", f"""WITH {_TOKENS},
  v AS (SELECT file, line_no, {_NUM.format("tok[1]")} AS il, {_NUM.format("tok[2]")} AS xl, {_NUM.format("tok[n]")} AS s
        FROM rows WHERE n >= 3 AND NOT starts_with(text, '#') AND NOT starts_with(text, 'FAULT'))
  SELECT file, line_no, {q6("il")} AS il, {q6("xl")} AS xl, {q6("s")} AS s FROM v
  WHERE il IS NOT NULL AND xl IS NOT NULL AND s IS NOT NULL""")
def k4(spark, sf):
    return k.parse_index_dat(lines(spark, sf)).select(
        "file", "line_no", *[r6(F.col(c)).alias(c) for c in ("il", "xl", "s")])


@query("k5_viewer_dat_sticks", """
  SELECT event_type AS file, event_id AS line_no, CAST(user_id + 1001 AS DOUBLE) AS inline,
         CAST(event_id % 700 + 1900 AS DOUBLE) AS crossline, CAST((event_id * 31) % 850 * 4 AS DOUBLE) AS twt
  FROM events WHERE event_type <> 'error'""")
def k5(spark, sf):
    c = lambda e: e.cast("string")
    text = F.concat_ws(" ", c(F.col("user_id")), c(F.col("event_id") % 700), c(F.col("event_id") * 31 % 850))
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("file"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("# "), text)).otherwise(text).alias("line"))
    return k.parse_viewer_dat(rows)


@query("k6_format_dispatch", f"""WITH {_PETREL}, five AS (
    SELECT count(*) AS points, count(DISTINCT (stem, stick_no)) AS sticks FROM (
      SELECT event_type AS stem, user_id AS stick_no, count(*) OVER (PARTITION BY event_type, user_id) AS m FROM events) WHERE m >= 2)
  SELECT 'petrel' AS format, count(*) AS points, count(DISTINCT (file, stick_no)) AS sticks FROM kept WHERE m >= 2
  UNION ALL SELECT 'f3', points, sticks FROM five""")
def k6(spark, sf):
    def tally(fmt, rows):
        per_stick = k.parse_sticks(rows, fmt).groupBy("file", "stick_no").count()
        return per_stick.agg(F.sum("count").alias("points"), F.count("*").alias("sticks")).select(
            F.lit(fmt).alias("format"), "points", "sticks")
    return tally("petrel", lines(spark, sf)).unionByName(tally("f3", _five(spark, sf)))


@query("k7_numeric_parse", """
  SELECT event_id, CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 2 THEN NULL
                        WHEN event_id % 5 = 3 THEN CAST(user_id AS DOUBLE) * 1000
                        ELSE CAST(user_id AS DOUBLE) END AS v FROM events""")
def k7(spark, sf):
    from lithoframe.functions.numeric import parse_number
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    text = (F.when(kind == 1, F.concat(user, F.lit("d"))).when(kind == 2, F.concat(user, F.lit("x")))
            .when(kind == 3, F.concat(user, F.lit("e3"))).when(kind == 4, F.concat(user, F.lit(".")))
            .otherwise(F.concat(F.lit("+"), user)))
    return table(spark, sf, "events").select("event_id", parse_number(text).alias("v"))
