import math
import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import metrics as m


def vox(spark, points, survey="s"):
    return spark.createDataFrame([(survey, *map(int, p)) for p in points], "survey_id string, il int, xl int, s int")


def plane(x, n=12):
    return [(i, x, s) for i in range(n) for s in range(n)]


def test_confusion_621(spark):
    truth, pred = vox(spark, [(0, 0, i) for i in range(7)]), vox(spark, [(0, 0, i) for i in (0, 1, 2, 3, 4, 5, 7, 8)])
    r = m.binary_metrics(pred, truth).first()
    assert (r["tp"], r["fp"], r["fn"]) == (6, 2, 1)
    assert (r["iou"], r["dice"], r["f1"]) == pytest.approx((6 / 9, 12 / 15, 12 / 15))
    assert (r["precision"], r["recall"]) == pytest.approx((6 / 8, 6 / 7))


def test_empty_prediction(spark):
    none, truth = vox(spark, [(9, 9, 9)]).limit(0), vox(spark, plane(3))
    shape = spark.createDataFrame([("s", 12, 12, 12)], "survey_id string, n_inlines int, n_crosslines int, n_samples int")
    r = m.evaluation_row(none, truth, shape).first()
    assert (r["tp"], r["iou"], r["precision"], r["recall_3"], r["precision_3"]) == (0, 0, 0, 0, 0)
    assert r["assd"] == float("inf")
    assert m.for_json(m.evaluation_row(none, truth, shape)).first()["assd"] is None


def test_tolerance(spark):
    near = m.tolerant_metrics(vox(spark, plane(5)), vox(spark, plane(7)), 3).first()
    assert (near["precision_3"], near["recall_3"]) == (1, 1)
    far = m.tolerant_metrics(vox(spark, plane(0)), vox(spark, plane(10)), 3).first()
    assert (far["precision_3"], far["recall_3"]) == (0, 0)


def test_zero_tolerance_is_plain_precision(spark):
    p, t = vox(spark, plane(3) + plane(4)), vox(spark, plane(4) + plane(9))
    a, b = m.tolerant_metrics(p, t, 0).first(), m.binary_metrics(p, t).first()
    assert (a["precision_0"], a["recall_0"]) == (b["precision"], b["recall"])


def brute(a, b):
    near = lambda p, q: sum(min(math.dist(x, y) for y in q) for x in p) / len(p)
    return (near(a, b) + near(b, a)) / 2


def test_surface_distance(spark):
    assert m.surface_distance(vox(spark, plane(2)), vox(spark, plane(5))).first()["assd"] == pytest.approx(3)
    rng = random.Random(2)
    spread = lambda n, k: list({tuple(rng.randint(0, n) for _ in range(3)) for _ in range(k)})
    a, b = spread(25, 60), spread(12, 40)
    assert m.surface_distance(vox(spark, a), vox(spark, b)).first()["assd"] == pytest.approx(brute(a, b))


def test_surface_distance_far_apart(spark):
    rng = random.Random(4)
    a = list({tuple(rng.randint(0, 90) for _ in range(3)) for _ in range(12)})
    b = [(300, 200, 100), (290, 10, 60)]
    assert m.surface_distance(vox(spark, a), vox(spark, b)).first()["assd"] == pytest.approx(brute(a, b))


def scored(spark, pairs):
    return spark.createDataFrame([("r", p, t) for p, t in pairs], "k string, p double, target int")


def test_low_threshold_wins(spark):
    counts = m.threshold_counts(scored(spark, [(0.40, 1), (0.35, 1), (0.01, 0), (0.02, 0)]), ["k"])
    best = m.best_threshold(counts, ["k"]).first()
    assert best["best_threshold"] == 0.05 and best["iou"] == pytest.approx(1)


def test_strict_comparison(spark):
    counts = {r["threshold"]: r for r in m.threshold_counts(scored(spark, [(0.5, 1), (0.5, 0)]), ["k"]).collect()}
    assert (counts[0.5]["tp"], counts[0.5]["fp"], counts[0.5]["fn"]) == (0, 0, 1)
    assert (counts[0.45]["tp"], counts[0.45]["fp"], counts[0.45]["fn"]) == (1, 1, 0)


def test_average_precision(spark):
    ap = lambda pairs: m.average_precision(m.threshold_counts(scored(spark, pairs), ["k"]), ["k"]).first()["ap"]
    assert ap([(0.99, 1), (0.98, 1), (0.01, 0)]) == pytest.approx(1)
    assert ap([(0.0, 1), (0.0, 0)]) == 0


def test_counts_523(spark):
    df = spark.createDataFrame([(5, 2, 3)], "tp int, fp int, fn int")
    r = m.overlap_ratios(df).first()
    assert (r["iou"], r["dice"], r["precision"], r["recall"]) == pytest.approx((0.5, 10 / 15, 5 / 7, 5 / 8))


def saved(rows):
    top, low, out = 0.0, math.inf, []
    for e, iou, loss in rows:
        if iou > top:
            top = iou
            out.append((e, "iou"))
        elif iou >= top and loss < low:
            out.append((e, "loss"))
        low = min(low, loss)
    return out


def test_best_epoch_cases(spark):
    rng = random.Random(0)
    cases = {"zero": [(1, 0.0, 0.9), (2, 0.0, 0.5), (3, 0.0, 0.7)], "first": [(1, 0.4, 0.9), (2, 0.3, 0.1)],
             "tie": [(1, 0.4, 0.9), (2, 0.4, 0.8), (3, 0.4, 0.85)], "rise": [(1, 0.1, 0.2), (2, 0.5, 0.9)],
             "random": [(i, rng.choice([0.0, 0.1, 0.2]), rng.choice([0.1, 0.2, 0.3])) for i in range(200)]}
    df = spark.createDataFrame([(k, *r) for k, v in cases.items() for r in v], "run_id string, epoch int, iou double, loss double")
    got = {}
    for r in m.saved_epochs(df).collect():
        got.setdefault(r["run_id"], []).append((r["epoch"], r["selected_by"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: saved(v) for k, v in cases.items()}
    best = {r["run_id"]: r["epoch"] for r in m.best_epoch(df).collect()}
    assert best == {k: saved(v)[-1][0] for k, v in cases.items()}


def test_scan_over_blocks(spark):
    from pyspark.sql import functions as F

    from lithoframe.functions.scans import OrderedScan
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", i, rng.randint(0, 99), rng.choice([None, "x", "y", "z"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long, n string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many blocks as partitions
    try:
        scans = OrderedScan.on_dense_order(df, ["k"], "i", 37), OrderedScan.on_any_order(df, ["k"], ["i"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for scan in scans:
        assert scan.df.select("_blk").distinct().count() > 4
        scan.running({"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "name": ("last", F.col("n"))}, through=-1)
        scan.whole({"all": ("sum", F.col("v"))}).next_row("nxt", ["i"])
        got = {r["i"]: r for r in scan.result().collect()}
        for key in "ab":
            mine = [r for r in rows if r[0] == key]
            for j, r in enumerate(mine):
                g, before = got[r[1]], mine[:j]
                assert g["total"] == (sum(b[2] for b in before) if before else None)
                assert g["low"] == (min(b[2] for b in before) if before else None)
                assert g["name"] == next((b[3] for b in reversed(before) if b[3]), None)
                assert g["all"] == sum(b[2] for b in mine)
                assert (g["nxt"]["i"] if g["nxt"] else None) == (mine[j + 1][1] if j + 1 < len(mine) else None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_voxels_are_not_broadcast(spark):
    a, b = (vox(spark, plane(x)).withColumn("side", F.lit("pred")) for x in (1, 3))
    made = plan_of(m._within_cells(a, b, 4))
    assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made


def test_tolerant_cells_are_not_broadcast(spark):
    made = plan_of(m.tolerant_metrics(vox(spark, plane(5)), vox(spark, plane(7)), 3, 5))
    assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made
