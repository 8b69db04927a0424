import pytest
from pyspark.sql import functions as F

from lithoframe.operators import geometry as g
from lithoframe.operators import slices as p

MISSING = {(101, 302), (102, 305), (103, 301), (101, 308)}


def irregular(volume_of):
    cells = [((il, xl), [il * 1000 + xl] * 20) for il in range(100, 105) for xl in range(300, 310)
             if (il, xl) not in MISSING]
    return volume_of(cells)


def test_irregular_geometry_and_zero_fill(volume_of):
    t = irregular(volume_of)
    geo = g.flag_irregular(g.infer_geometry(t)).first()
    assert (geo["inline_min"], geo["inline_max"], geo["inline_step"], geo["n_inlines"]) == (100, 104, 1, 5)
    assert (geo["crossline_min"], geo["n_crosslines"], geo["n_traces"]) == (300, 10, 46)
    assert geo["irregular"]
    rows = {(r["inline"], r["crossline"]): r["samples"] for r in g.regularise(t).collect()}
    assert len(rows) == 50
    for cell, samples in rows.items():
        want = 0.0 if cell in MISSING else float(cell[0] * 1000 + cell[1])
        assert samples == [want] * 20


def test_last_duplicate_wins_and_off_step_drops(volume_of):
    t = volume_of([((10, 1), [1, 1]), ((12, 1), [2, 2]), ((10, 1), [3, 3]), ((13, 1), [4, 4])])
    rows = {r["inline"]: r["samples"] for r in g.regularise(t).collect()}
    assert rows == {10: [3, 3], 12: [2, 2]}
    report = g.fill_report(t, g.infer_geometry(t)).first()
    assert (report["placed"], report["total"], report["cells"]) == (3, 4, 2)


def test_single_line_has_step_one(volume_of):
    geo = g.infer_geometry(volume_of([((7, 3), [0, 1])])).first()
    assert (geo["inline_step"], geo["crossline_step"]) == (1, 1)


def affine(il, xl):
    return (round((15.5 * il + 21 * xl + 482000) * 10), round((20 * il - 6.5 * xl + 5214000) * 10))


def test_corner_is_evaluated_even_where_its_trace_is_missing(volume_of):
    gone = {(45, 70), (46, 70), (46, 71), (46, 72)}
    t = volume_of([((il, xl), [0] * 8) for il in range(40, 47) for xl in range(70, 78) if (il, xl) not in gone],
                  scalar=-10, xy=affine)
    fit = g.fit_georeference(t, g.infer_geometry(t))
    corners = fit.first()["corner_points"]
    assert [(c["il"], c["xl"]) for c in corners] == [(40, 70), (46, 70), (40, 77)]
    for c in corners:
        assert c["x"] == pytest.approx(15.5 * c["il"] + 21 * c["xl"] + 482000, abs=0.1)
        assert c["y"] == pytest.approx(20 * c["il"] - 6.5 * c["xl"] + 5214000, abs=0.1)
    moved = g.world_to_grid(t.select("survey_id", (F.col("cdp_x") / 10).alias("x"), (F.col("cdp_y") / 10).alias("y"),
                                     F.lit(8.0).alias("z"), "inline", "crossline"), g.three_point_transform(fit))
    for r in moved.collect():
        assert (r["il"], r["xl"], r["s"]) == pytest.approx((r["inline"], r["crossline"], 2.0), abs=0.05)


def test_no_fit_without_positions_or_with_a_poor_one(volume_of):
    cells = [((il, xl), [0]) for il in range(4) for xl in range(4)]
    for t in (volume_of(cells), volume_of(cells, xy=lambda il, xl: (il * xl * 5000 + 1, xl * xl * 4000)),
              volume_of(cells[:2], xy=affine)):
        fit = g.fit_georeference(t, g.infer_geometry(t))
        assert fit.first()["corner_points"] is None
    with pytest.raises(Exception, match="three tie points"):
        g.three_point_transform(fit).collect()


def test_index_clamps_and_floors(spark):
    idx = lambda v: spark.range(1).select(g.line_to_index(F.lit(v), F.lit(100), F.lit(2), F.lit(5))).first()[0]
    assert [idx(v) for v in (90, 99, 100, 103, 109, 200)] == [0, 0, 0, 1, 4, 4]


def test_insertion_index_takes_the_next_line(spark):
    lines = spark.createDataFrame([("s", n) for n in (10, 20, 30)], "survey_id string, number int")
    got = lambda t: tuple(g.insertion_index(lines, t).first()[1:])
    assert [got(t) for t in (5, 10, 11, 30, 99)] == [(0, 10), (0, 10), (1, 20), (2, 30), (2, 30)]


def test_sections(volume_of):
    t = irregular(volume_of)
    assert p.inline_section(t, 101).count() == 8
    assert p.crossline_section(t, 302).count() == 4
    with pytest.raises(LookupError):
        p.require_rows(p.inline_section(t, 99), "inline 99")
    geo = g.infer_geometry(t)
    kinds = {(r["section"], r["inline"], r["crossline"]) for r in p.middle_sections(t, geo).collect()}
    assert {k[1] for k in kinds if k[0] == "inline"} == {102}
    assert {k[2] for k in kinds if k[0] == "crossline"} == {305}
    assert p.time_slice(t).select("s").distinct().first()[0] == 6
    bounds = p.slab_bounds(t, geo, 104, window=1, patch=4).first()
    assert (bounds["lo"], bounds["hi"]) == (1, 5)
    assert g.keep_first_inlines(t, geo, 2).select("inline").distinct().count() == 2


def test_run_window_is_named(spark):
    runs = spark.createDataFrame([("r", [5, 6, 7])], "run_id string, inline_coords array<int>")
    p.require_in_run(runs, "r", 6)
    with pytest.raises(LookupError, match=r"\[5, 7\]"):
        p.require_in_run(runs, "r", 9)
    with pytest.raises(LookupError):
        p.require_in_run(runs, "x", 6)


def gapped(volume_of, survey="s"):
    return volume_of([((il, xl), [il * 10.0 + xl] * 8) for il in (1, 2, 3, 4, 9, 10, 11, 12) for xl in range(1, 5)
                      if (il, xl) not in ((2, 2), (11, 4))], survey=survey)


def test_lines_with_a_gap(volume_of):
    t = gapped(volume_of)
    geo = g.infer_geometry(t)
    assert g.grid_shape(geo).first()[1:] == (12, 4, 8)
    at = t.join(geo.drop("n_samples"), "survey_id").select("inline", g.line_to_index(
        F.col("inline"), F.col("inline_min"), F.col("inline_step"), g.grid_size("inline")).alias("i")).distinct().collect()
    assert {r["inline"]: r["i"] for r in at} == {n: n - 1 for n in (1, 2, 3, 4, 9, 10, 11, 12)}
    lines = lambda df: sorted(r[0] for r in df.select("inline").distinct().collect())
    assert lines(p.slab(t, p.slab_bounds(t, geo, 10, window=2, patch=1))) == [4, 9, 10, 11, 12][-5:]
    assert lines(p.inline_index_range(t, geo, 2, 10)) == [3, 4, 9, 10]
    fill = g.fill_report(t, geo).first()
    assert fill["percent_fill"] == 100 and fill["percent_cells"] == pytest.approx(100 * 30 / 48)


def test_written_volumes_are_read_in_part(spark, volume_of, tmp_path):
    from lithoframe.sources.volume import read_volume, write_volume
    t = volume_of([((il, xl), [float(il)] * 4) for il in range(0, 300, 10) for xl in range(3)])
    write_volume(t, str(tmp_path / "v"))
    v, geo = read_volume(spark, str(tmp_path / "v")), g.infer_geometry(t)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pruned = lambda df: [x for x in plan(df).splitlines() if "PartitionFilters" in x and "il_block" in x.split("PartitionFilters")[1].split("]")[0]]
    assert pruned(p.inline_section(v, 100))
    assert "dynamicpruning" in plan(p.clamped_inline_section(v, 95)) or pruned(p.clamped_inline_section(v, 95))
    assert p.inline_section(v, 100).count() == 3 and p.clamped_inline_section(v, 95).first()["inline"] == 100
    slab = p.slab(v, p.slab_bounds(v, geo, 100, window=2, patch=1))
    assert sorted(r[0] for r in slab.select("inline").distinct().collect()) == [80, 90, 100, 110, 120] and slab.count() == 15
    opened = plan(p.first_inline_samples(v, 5))
    assert opened.count("Generate") == 1 and [r["s"] for r in p.first_inline_samples(v, 5).collect()] == [0, 1, 2, 3, 0]


def test_clamped_section_of_probabilities(spark):
    probs = spark.createDataFrame([("r", "s", 10, 1, [0.1]), ("r", "s", 20, 1, [0.9])],
                                  "run_id string, survey_id string, inline int, crossline int, prob array<double>")
    assert [tuple(r) for r in p.clamped_inline_section(probs, 11).collect()] == [("r", "s", 20, 1, [0.9])]
    assert p.clamped_inline_section(probs.limit(0), 11).count() == 0
