import random

import numpy as np
import pytest

from lithoframe.operators import raster


def picks(spark, points, stick=1):
    rows = [("s", stick, i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "survey_id string, stick_id long, pt_no long, il double, xl double, s double")


def shape(spark, n=(100, 200, 500)):
    return spark.createDataFrame([("s", *n)], "survey_id string, n_inlines int, n_crosslines int, n_samples int")


def points(df):
    return sorted((r["il"], r["xl"], r["s"]) for r in df.collect())


@pytest.mark.parametrize("given,want", [
    ([(0, 10, 200), (4, 14, 204)], 5), ([(0, 0, 0), (5, 5, 5)], 6), ([(0, 0, 0), (10, 0, 0)], 2),
    ([(0, 0, 0), (3, 0, 0), (15, 0, 0)], 5), ([(1, 1, 1)], 1)])
def test_densify_counts(spark, given, want):
    assert raster.densify(picks(spark, given), ["pt_no"]).count() == want


def test_densify_midpoint(spark):
    got = points(raster.densify(picks(spark, [(4, 14, 204), (0, 10, 200)]), ["pt_no"]))
    assert [p[0] for p in got] == [0, 1, 2, 3, 4] and got[2] == (2, 12, 202)


def resampled(points):
    arr = np.array(points, float)
    arc = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(arr, axis=0), axis=1))])
    t = np.linspace(0, arc[-1], max(int(arc[-1] * 2), len(points)))
    return np.stack([np.interp(t, arc, arr[:, c]) for c in range(3)], 1)


@pytest.mark.parametrize("seed", [4, 1000])
def test_resample_equals_interpolation(spark, seed):
    rng = random.Random(seed)
    pts = [(rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(25)]
    pts.insert(7, pts[6])  # a segment of no length
    rows = raster.resample(picks(spark, pts), ["pt_no"]).orderBy("k").collect()
    got = np.array([(r["il"], r["xl"], r["s"]) for r in rows])
    want = resampled(pts)
    assert got.shape == want.shape
    assert np.abs(got - want).max() < 1e-9


def test_resample_degenerate(spark):
    assert points(raster.resample(picks(spark, [(1, 2, 3)]), ["pt_no"])) == [(1, 2, 3)]
    assert points(raster.resample(picks(spark, [(1, 2, 3)] * 4), ["pt_no"])) == [(1, 2, 3)]


def test_a_stick_over_many_tasks(spark):
    rng = random.Random(5)
    many = [(rng.randint(0, 60), rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks of about 40 points
    try:
        a = points(raster.densify(picks(spark, many), ["pt_no"]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert np.allclose(a, points(raster.densify(picks(spark, many), ["pt_no"])))


def test_known_voxel_and_dilation(spark):
    line = picks(spark, [(10, 20, 50), (11, 21, 51)])
    bare = set(points(raster.rasterise_index_sticks(line, ["pt_no"], shape(spark), 0)))
    assert (10, 20, 50) in bare
    one = set(points(raster.rasterise_index_sticks(line, ["pt_no"], shape(spark), 1)))
    two = set(points(raster.rasterise_index_sticks(line, ["pt_no"], shape(spark), 2)))
    assert bare < one < two
    cube = {(i + a, x + b, s + c) for i, x, s in bare for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
    assert one == cube


def test_clip_keeps_growth_from_outside(spark):
    got = points(raster.paint(picks(spark, [(-1, 0, 0)]), shape(spark, (3, 3, 3)), 1))
    assert got == [(0, a, b) for a in (0, 1) for b in (0, 1)]


def test_half_even_rounding(spark):
    got = points(raster.paint(picks(spark, [(0.5, 1.5, 2.5)]), shape(spark), 0))
    assert got == [(0, 2, 2)]


def test_direct_paint(spark):
    pts = spark.createDataFrame([("s", 50.0, 100.0, 200.0)], "survey_id string, inline double, crossline double, twt double")
    bounds = spark.createDataFrame([("s", 1, 100, 1, 200, 0.0, 4.0, 100, 200, 500)],
                                   "survey_id string, inline_min int, inline_max int, crossline_min int, crossline_max int,"
                                   "twt_min double, sample_rate_ms double, n_inlines int, n_crosslines int, n_samples int")
    got = points(raster.paint_points(pts, bounds))
    assert got == [(i, x, 50) for i in (48, 49, 50) for x in (98, 99, 100)]


def test_dense_mask(spark):
    mask = spark.createDataFrame([("s", 0, 1, 2)], "survey_id string, il int, xl int, s int")
    rows = {(r["il"], r["xl"]): list(r["mask"]) for r in raster.dense_mask(mask, shape(spark, (2, 2, 3))).collect()}
    assert len(rows) == 4 and rows[(0, 1)] == [0, 0, 1] and rows[(1, 1)] == [0, 0, 0]


def test_label_job(spark):
    from lithoframe.plans.labels import label_volume
    text = spark.createDataFrame([("a.dat", i, t) for i, t in enumerate(["10 20 50", "14 24 54"])],
                                 "file string, line_no long, line string")
    mask, report = label_volume(text, "volve", shape(spark), "s", dilation=1, max_gap=5)
    row = report.first()
    assert row["fault_voxels"] == mask.count() > 0 and row["verdict"] in ("WARN", "CAUTION")


@pytest.mark.parametrize("blocks", [3, 7, 1000])
def test_stretches_meet_across_blocks(spark, blocks):
    from pyspark.sql import functions as F

    from lithoframe.functions.scans import OrderedScan
    rng = random.Random(blocks)
    held = {("a", i): rng.random() for i in range(200)} | {("b", i): 0.0 for i in range(5)} | {("c", 0): 0.5}
    df = spark.createDataFrame([(k, i, None if i == {"a": 199, "b": 4, "c": 0}[k] else x) for (k, i), x in held.items()],
                               "k string, i int, x double").repartition(5)
    got = OrderedScan.on_dense_order(df, ["k"], "i", blocks).stretches(
        F.col("x"), "start", "end", "total", "nth", "n").result().orderBy("k", "i").collect()
    for k in "abc":
        rows, at = [r for r in got if r.k == k], 0.0
        for a, b in zip(rows, [*rows[1:], None]):
            assert a.start == pytest.approx(at) and a.nth == a.i and a.n == len(rows) and a.total == rows[-1].start
            assert a.end == (b.start if b else None)      # to the bit
            at += a.x or 0.0


def test_resample_writes_twice(spark, monkeypatch):
    from lithoframe.functions import lineage, scans
    seen = []
    monkeypatch.setattr(scans, "cut", lambda df: (seen.append(1), lineage.cut(df))[1])
    monkeypatch.setattr(scans, "sized", lambda df: df if getattr(df, "_is_cut", False) else scans.cut(df))
    assert raster.resample(picks(spark, [(0, 0, 0), (3, 4, 0), (3, 4, 5)]), ["pt_no"]).count() == 20
    assert len(seen) == 2
