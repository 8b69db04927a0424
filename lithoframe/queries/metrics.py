"""Validation metric queries."""

from pyspark.sql import functions as F

from lithoframe.operators import metrics as v
from lithoframe.operators.geometry import infer_geometry
from lithoframe.queries import query
from lithoframe.queries.patches import PATCH
from lithoframe.queries.tables import (
    EPOCHS, PREDICTED, PROBS, TRACES, TRUTH, epochs, predicted, probs, q6, r6, traces, truth,
)

_RATIOS = ("iou", "dice", "precision", "recall")

# truth shifted by two voxels in time, so that prediction and truth differ in place
_SHIFTED = f"""{TRACES}, {PROBS}, {PREDICTED}, {TRUTH.replace("xl, s FROM", "xl, CAST(s + 2 AS INTEGER) AS s FROM")}"""


def _truth(spark, sf):
    return truth(spark, sf).withColumn("s", F.col("s") + 2)


_CONF = """
  u AS (SELECT coalesce(p.survey_id, t.survey_id) AS survey_id, p.s IS NOT NULL AS p, t.s IS NOT NULL AS t
        FROM pred p FULL JOIN truth t ON p.survey_id = t.survey_id AND p.il = t.il AND p.xl = t.xl AND p.s = t.s),
  conf AS (SELECT survey_id, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
                  count(*) FILTER (WHERE t AND NOT p) AS fn FROM u GROUP BY survey_id)"""


def _ratio_sql(smooth: str = "") -> str:
    return f"""{q6(f"tp / (tp + fp + fn{smooth})")} AS iou, {q6(f"2 * tp / (2 * tp + fp + fn{smooth})")} AS dice,
         {q6(f"CASE WHEN tp + fp{smooth} = 0 THEN 0 ELSE tp / (tp + fp{smooth}) END")} AS precision,
         {q6(f"CASE WHEN tp + fn{smooth} = 0 THEN 0 ELSE tp / (tp + fn{smooth}) END")} AS recall"""


@query("v1_binary_metrics", f"WITH {_SHIFTED}, {_CONF} SELECT survey_id, tp, fp, fn, {_ratio_sql()} FROM conf")
def v1(spark, sf):
    return v.binary_metrics(predicted(spark, sf), _truth(spark, sf)).select(
        "survey_id", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in _RATIOS])


def _scored(spark, sf):
    zipped = probs(spark, sf).join(
        traces(spark, sf).select("inline", "crossline", "samples"), ["inline", "crossline"])
    return zipped.select("inline", F.explode(F.arrays_zip("prob", "samples")).alias("x")).select(
        "inline", F.col("x.prob").alias("p"), (F.col("x.samples") > 0.25).cast("int").alias("target"))


_SWEEP = """
  scored AS (SELECT inline, p, a > 0.25 AS t FROM probs),
  grid AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold),
  counts AS (SELECT inline, threshold, count(*) FILTER (WHERE p > threshold AND t) AS tp,
                    count(*) FILTER (WHERE p > threshold AND NOT t) AS fp, count(*) FILTER (WHERE p <= threshold AND t) AS fn
             FROM scored, grid GROUP BY inline, threshold),
  rated AS (SELECT *, tp / (tp + fp + fn + 1e-8) AS iou, 2 * tp / (2 * tp + fp + fn + 1e-8) AS dice,
                   tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM counts)"""


@query("v2_threshold_counts", f"""WITH {TRACES}, {PROBS}, {_SWEEP}
  SELECT inline, threshold, tp, fp, fn, {", ".join(f"{q6(c)} AS {c}" for c in _RATIOS)} FROM rated""")
def v2(spark, sf):
    counts = v.threshold_counts(_scored(spark, sf), ["inline"])
    return v.overlap_ratios(counts, v.SMOOTH).withColumns({c: r6(F.col(c)) for c in _RATIOS})


@query("v3_threshold_sweep", f"""WITH {TRACES}, {PROBS}, {_SWEEP},
  best AS (SELECT *, row_number() OVER (PARTITION BY inline ORDER BY iou DESC, threshold) AS rn FROM rated)
  SELECT inline, threshold AS best_threshold, tp, fp, fn, {", ".join(f"{q6(c)} AS {c}" for c in _RATIOS)} FROM best WHERE rn = 1""")
def v3(spark, sf):
    best = v.best_threshold(v.threshold_counts(_scored(spark, sf), ["inline"]), ["inline"])
    return best.withColumns({c: r6(F.col(c)) for c in _RATIOS})


@query("v4_average_precision", f"""WITH {TRACES}, {PROBS}, {_SWEEP},
  c AS (SELECT inline, recall AS r, max(precision) AS p FROM rated GROUP BY inline, recall),
  g AS (SELECT inline, (r - coalesce(lag(r) OVER (PARTITION BY inline ORDER BY r), 0)) * p AS gain FROM c)
  SELECT inline, {q6("sum(gain)")} AS ap FROM g GROUP BY inline""")
def v4(spark, sf):
    return v.average_precision(v.threshold_counts(_scored(spark, sf), ["inline"]), ["inline"]).withColumn(
        "ap", r6(F.col("ap")))


def _tolerant_sql(n: int) -> str:
    near = lambda a, b: f"""(SELECT avg(CAST(EXISTS (SELECT 1 FROM {b} o WHERE abs(o.il - x.il) <= {n} AND abs(o.xl - x.xl) <= {n}
        AND abs(o.s - x.s) <= {n}) AS INTEGER)) FROM {a} x)"""
    return f"{q6(near('pred', 'truth'))} AS precision_{n}, {q6(near('truth', 'pred'))} AS recall_{n}"


@query("v5_tolerant_metrics", f"WITH {_SHIFTED} SELECT 'survey_0' AS survey_id, {_tolerant_sql(1)}, {_tolerant_sql(3)}")
def v5(spark, sf):
    p, t = predicted(spark, sf), _truth(spark, sf)
    both = v.tolerant_metrics(p, t, 1, 3)
    return both.select("survey_id", *[r6(F.col(c)).alias(c) for c in both.columns if c != "survey_id"])


_NEAREST = """(SELECT avg(d) FROM (SELECT sqrt(min(pow(x.il - o.il, 2) + pow(x.xl - o.xl, 2) + pow(x.s - o.s, 2))) AS d
     FROM {a} x, {b} o GROUP BY x.il, x.xl, x.s))"""
_ASSD = f"({_NEAREST.format(a='pred', b='truth')} + {_NEAREST.format(a='truth', b='pred')}) / 2"


@query("v6_surface_distance", f"WITH {_SHIFTED} SELECT 'survey_0' AS survey_id, {q6(_ASSD)} AS assd")
def v6(spark, sf):
    return v.surface_distance(predicted(spark, sf), _truth(spark, sf)).withColumn("assd", r6(F.col("assd")))


_EVAL = f"""SELECT survey_id, tp, fp, fn, {_ratio_sql()}, {q6("2 * tp / (2 * tp + fp + fn)")} AS f1,
    {_tolerant_sql(3)}, {_tolerant_sql(5)}, {q6(_ASSD)} AS assd, tp + fp AS predicted_voxels, tp + fn AS truth_voxels,
    CAST(0.0 AS DOUBLE) AS fault_continuity, CAST(0.0 AS DOUBLE) AS throw_error FROM conf"""


def _eval_columns(row):
    exact = ["survey_id", "tp", "fp", "fn", "predicted_voxels", "truth_voxels", "fault_continuity", "throw_error"]
    rounded = [*_RATIOS, "f1", "precision_3", "recall_3", "precision_5", "recall_5", "assd"]
    return row.select(*exact, *[r6(F.col(c)).alias(c) for c in rounded])


@query("v7_evaluation_row", f"WITH {_SHIFTED}, {_CONF} {_EVAL}")
def v7(spark, sf):
    shape = infer_geometry(traces(spark, sf))
    return _eval_columns(v.evaluation_row(predicted(spark, sf), _truth(spark, sf), shape))


def _held_out_sql() -> str:
    from lithoframe.queries.scoring import _PADDED, _SCORES, _STARTS
    cut = TRACES.replace("FROM embeddings)", "FROM embeddings WHERE vec_id // 25 >= 8)", 1)
    windows = (_STARTS + _PADDED + _SCORES).format(tail="true", any="").replace("inline - 1001", "inline - 1009").replace(
        "max(inline) - 1000", "max(inline) - 1008")
    return f"""WITH {cut}, {windows},
  pred AS (SELECT 'survey_0' AS survey_id, il, xl, s FROM (
      SELECT il, xl, s, CAST(sum(p * w) / sum(w) AS FLOAT) AS p FROM wt GROUP BY il, xl, s) WHERE p >= 0.8),
  {TRUTH.replace("inline - 1001", "inline - 1009")}, {_CONF} {_EVAL}"""


@query("v8_held_out_evaluation", _held_out_sql())
def v8(spark, sf):
    from lithoframe.plans.evaluation import held_out_evaluation
    t = traces(spark, sf)
    row = held_out_evaluation(t, truth(spark, sf), infer_geometry(t), PATCH, 8, 1_000_000, threshold=0.8)
    return _eval_columns(v.for_json(row))


_ROLLED = """
  ep AS (SELECT run_id, epoch, phase, avg(loss) AS loss, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM batches GROUP BY ALL),
  rated AS (SELECT *, round(tp / (tp + fp + fn + 1e-8), 6) AS iou, 2 * tp / (2 * tp + fp + fn + 1e-8) AS dice,
                   tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM ep)"""


@query("v9_best_epoch", f"""WITH {EPOCHS}, {_ROLLED},
  h AS (SELECT run_id, epoch, iou, round(loss, 6) AS loss,
               max(iou) OVER w AS top, min(round(loss, 6)) OVER w AS low FROM rated WHERE phase = 'val'
        WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, CASE WHEN iou > coalesce(top, 0) THEN 'iou'
                       WHEN iou >= coalesce(top, 0) AND loss < coalesce(low, 1e300) THEN 'loss' END AS selected_by FROM h)
  SELECT run_id, epoch, {q6("iou")} AS iou, {q6("loss")} AS loss, selected_by FROM s WHERE selected_by IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1""")
def v9(spark, sf):
    history = v.epoch_rollup(epochs(spark, sf)).where(F.col("phase") == "val").select(
        "run_id", "epoch", r6(F.col("iou")).alias("iou"), r6(F.col("loss")).alias("loss"))
    return v.best_epoch(history)


@query("v10_epoch_rollup", f"""WITH {EPOCHS}, {_ROLLED}
  SELECT run_id, epoch, phase, {q6("loss")} AS loss, {q6("tp")} AS tp, {q6("fp")} AS fp, {q6("fn")} AS fn,
         {", ".join(f"{q6(c)} AS {c}" for c in _RATIOS)} FROM rated""")
def v10(spark, sf):
    return v.epoch_rollup(epochs(spark, sf)).withColumns(
        {c: r6(F.col(c)) for c in ("loss", "tp", "fp", "fn", *_RATIOS)})


@query("v11_acceptance_gate", f"""WITH {TRACES}, {PROBS}, {_SWEEP}
  SELECT inline, threshold, CASE WHEN iou > 0.3 THEN 'PASS' ELSE 'WARN' END AS gate FROM rated""")
def v11(spark, sf):
    counts = v.threshold_counts(_scored(spark, sf), ["inline"])
    return v.overlap_ratios(counts, v.SMOOTH).select("inline", "threshold", v.acceptance(F.col("iou")).alias("gate"))
