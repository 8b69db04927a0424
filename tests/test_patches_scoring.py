import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import patches as t
from lithoframe.operators import scoring as sc

N = (13, 11, 20)


def shape(spark, n=N):
    return spark.createDataFrame([("s", *n)], "survey_id string, n_inlines int, n_crosslines int, n_samples int")


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).normal(size=N).astype("f4")


def volume(spark, data):
    rows = [("s", i, x, data[i, x].tolist()) for i in range(data.shape[0]) for x in range(data.shape[1])]
    return spark.createDataFrame(rows, "survey_id string, il int, xl int, samples array<float>")


def test_index_and_split(spark):
    rows = t.patch_index(shape(spark), (4, 4, 8), (3, 4, 6)).collect()
    assert {(r["il0"], r["xl0"], r["s0"]) for r in rows} == {
        (i, x, s) for i in range(0, 10, 3) for x in range(0, 8, 4) for s in range(0, 13, 6)}
    side = {r["il0"]: r["split"] for r in rows}
    assert side == {0: "train", 3: "train", 6: "train", 9: "test"}  # centre 8 < 9; 11 is past 9 + 1
    with pytest.raises(Exception, match="larger than the volume"):
        t.patch_index(shape(spark), (14, 4, 4)).collect()
    with pytest.raises(ValueError):
        t.patch_index(shape(spark), (4, 4, 4), shares=(0.5, 0.2, 0.2))


@pytest.mark.parametrize("tail", [False, True])
def test_covering_lists_every_window(spark, tail):
    for n, p, st in ((13, 4, 3), (11, 4, 4), (20, 8, 5), (4, 4, 2)):
        wanted = list(range(0, n - p + 1, st))
        if tail and wanted[-1] + p < n:
            wanted.append(n - p)
        row = spark.range(n).select("id", t.covering(F.col("id"), F.lit(n), p, st, tail).alias("c"),
                                    t.starts(F.lit(n), p, st, tail).alias("all"))
        for r in row.collect():
            assert r["c"] == [w for w in wanted if w <= r["id"] < w + p]
            assert r["all"] == wanted


def test_cut_patches_hold_the_cube(spark, cube):
    out = t.cut_patches(volume(spark, cube), shape(spark), (4, 4, 8), (3, 4, 6)).collect()
    assert len(out) == 4 * 2 * 3
    for r in out:
        i, x, s = r["il0"], r["xl0"], r["s0"]
        assert np.array_equal(np.float32(r["patch"]), cube[i:i + 4, x:x + 4, s:s + 8].ravel())
        assert not any(r["label"])


def test_zscores(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 5.0],)], "patch array<float>")
    z = [r[0] for r in df.select(t.zscore("patch")).collect()]
    assert np.allclose(z[0], [-1.2247448, 0, 1.2247448], atol=1e-5) and z[1] == [0, 0, 0]
    assert [r[0] for r in df.select(t.zscore_unless_flat("patch")).collect()][1] == [5, 5, 5]


def test_counts_and_weights(spark):
    mask = spark.createDataFrame([("s", 3, 3, 7), ("s", 3, 3, 0), ("s", 12, 10, 19)], "survey_id string, il int, xl int, s int")
    sh = shape(spark)
    counted = t.with_fault_counts(t.patch_index(sh, (4, 4, 8), (3, 4, 6)), mask, sh, (4, 4, 8), (3, 4, 6))
    got = {(r["il0"], r["xl0"], r["s0"]): r["fault_voxels"] for r in counted.collect()}
    assert {k for k, v in got.items() if v} == {(0, 0, 0), (3, 0, 0), (0, 0, 6), (3, 0, 6)}
    assert got[(0, 0, 0)] == 2 and got[(0, 0, 6)] == 1
    assert t.keep_faulted(counted, (4, 4, 8), 2 / 128).count() == 2
    assert t.keep_faulted(counted, (4, 4, 8), 0).count() == len(got)
    assert t.fault_weights(counted).agg(F.sum("weight")).first()[0] == 50 * 4 + 20


def test_weighted_draws_follow_weights(spark):
    rows = [("s", i, 0, 0, 9.0 if i < 10 else 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "survey_id string, il0 int, xl0 int, s0 int, weight double")
    drawn = t.sample_weighted(df, k=900, seed=3).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(900))
    heavy = sum(r["il0"] < 10 for r in drawn) / 900  # expected 90 / 1080
    assert abs(heavy - 90 / 1080) < 0.03
    again = t.sample_weighted(df.repartition(3), k=900, seed=3).collect()
    assert {(r["draw"], r["il0"]) for r in drawn} == {(r["draw"], r["il0"]) for r in again}


def test_gaussian_peak_and_edges():
    wi, wx, ws = sc.gaussian_weights((8, 8, 16))
    assert max(wi) == max(ws) == 1.0 and wi[0] == pytest.approx(np.exp(-12.25 / 8) / np.exp(-0.25 / 8))


def test_blend_of_a_constant_is_that_constant(spark, cube):
    out = sc.score_volume(volume(spark, cube), shape(spark), (4, 4, 8), predict=lambda b: np.full(b.shape, 0.3),
                          overlap=0.5, batch=3).collect()
    assert len(out) == N[0] * N[1]
    want = 1 / (1 + np.exp(-0.3))
    assert np.allclose([r["prob"] for r in out], want, atol=1e-6)


def test_scores_do_not_depend_on_partitioning(spark, cube):
    run = lambda v: {(r["il"], r["xl"]): r["prob"] for r in sc.score_volume(v, shape(spark), (4, 4, 8)).collect()}
    a, b = run(volume(spark, cube)), run(volume(spark, cube).repartition(7))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_uniform_tiling_leaves_uncovered_positions_at_zero(spark, cube):
    out = sc.score_volume(volume(spark, cube), shape(spark), (4, 4, 8), predict=np.zeros_like, overlap=0.0, uniform=True)
    for r in out.collect():
        inside = r["il"] < 12 and r["xl"] < 8
        assert r["prob"] == ([0.5] * 16 + [0.0] * 4 if inside else [0.0] * 20)


def test_overlap_bounds():
    with pytest.raises(ValueError):
        t.overlap_stride((4, 4, 4), 1.0)
    assert t.overlap_stride((4, 4, 5), 0.5) == (2, 2, 2)
    assert t.clamp_patch((64, 8, 8), (10, 20, 4)) == (10, 8, 4)


def test_scoring_run_commits_last(spark, volume_of, tmp_path):
    from lithoframe.operators.geometry import infer_geometry
    from lithoframe.plans.evaluation import scoring_run
    rng = np.random.default_rng(0)
    tr = volume_of([((il, xl), rng.normal(size=16)) for il in range(100, 120) for xl in range(10)])
    row = scoring_run(tr, infer_geometry(tr), "r1", str(tmp_path), (4, 4, 8), inline_center=110, window=3).first()
    assert row["inline_coords"] == list(range(107, 114)) and row["status"] == "complete"
    probs = spark.read.parquet(f"{tmp_path}/r1/fault_probability")
    assert probs.count() == 70
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        scoring_run(tr, infer_geometry(tr), "r1", str(tmp_path), (4, 4, 8))


def test_volume_split_ends_at_85_percent(spark):
    rows = [("s", i, 0, [0.0]) for i in range(25)]
    v = spark.createDataFrame(rows, "survey_id string, il int, xl int, samples array<float>")
    got = t.split_volume(v, shape(spark, (25, 1, 1))).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 17, "val": 4, "test": 4}


def test_flat_and_nearly_flat_patches(spark):
    rows = [([0.25] * 4,), ([0.0, 4e-8, 0.0, 4e-8],), ([1.0, 3.0],), ([],)]
    df = spark.createDataFrame(rows, "x array<double>")
    got = [list(r[0]) for r in df.select(t.zscore_unless_flat("x")).collect()]
    assert got[0] == [0.25] * 4 and np.allclose(got[1], [-1, 1, -1, 1]) and got[2] == [-1, 1] and got[3] == []


def test_patches_have_zeros_for_missing_traces(spark, cube):
    v = volume(spark, cube).where("not (il = 1 and xl = 2) and il != 3")
    whole = cube.copy()
    whole[1, 2], whole[3] = 0, 0
    got = {(r["il0"], r["xl0"], r["s0"]): r["patch"] for r in t.cut_patches(v, shape(spark), (4, 4, 8)).collect()}
    assert len(got) == 3 * 2 * 2
    for (i, x, s), patch in got.items():
        assert np.array_equal(np.float32(patch).reshape(4, 4, 8), whole[i:i + 4, x:x + 4, s:s + 8])


def test_runs_with_gaps_and_of_one_survey(spark, volume_of, tmp_path):
    from lithoframe.operators.geometry import infer_geometry
    from lithoframe.plans.evaluation import scoring_run
    from tests.test_geometry import gapped
    one = gapped(volume_of)
    done = scoring_run(one, infer_geometry(one), "r", str(tmp_path / "a"), (2, 2, 4)).first()
    assert list(done["inline_coords"]) == list(range(1, 13))
    probs = spark.read.parquet(f"{tmp_path}/a/r/fault_probability")
    assert probs.count() == 48 and probs.where("size(prob) != 8").count() == 0
    blank = probs.where("inline between 6 and 7").select(F.explode("prob")).distinct().collect()
    assert [r[0] for r in blank] == [0.5]
    part = scoring_run(one, infer_geometry(one), "p", str(tmp_path / "b"), (2, 2, 4), inline_center=10, window=1).first()
    assert list(part["inline_coords"]) == list(range(4, 13))  # two existing lines on either side, and the gap between
    both = one.unionByName(gapped(volume_of, "t"))
    with pytest.raises(ValueError, match="one survey"):
        scoring_run(both, infer_geometry(both), "r2", str(tmp_path / "c"), (2, 2, 4))
