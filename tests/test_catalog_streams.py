import datetime as dt

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import catalog as c
from lithoframe.operators import slices
from lithoframe.streaming import run_status


def test_resolve_run_ids(spark):
    ids = spark.createDataFrame([("abcdef12-1",), ("abcdef12-2",), ("0123456789",), ("0123",)], "run_id string")
    ask = ["abcdef12-1", "abcdef12", "01234", "0123", "zz", "abcdef12-1x", ""]
    got = {r["request"]: (r["state"], r["run_id"]) for r in c.resolve_run_ids(
        spark.createDataFrame([(a,) for a in ask], "request string"), ids).collect()}
    assert got["abcdef12-1"] == ("resolved", "abcdef12-1")
    assert got["abcdef12"] == ("ambiguous", None)
    assert got["01234"] == ("resolved", "0123456789")
    assert got["0123"] == ("resolved", "0123")
    assert got["zz"] == ("not_found", None) and got["abcdef12-1x"] == ("not_found", None)


def test_append_twice(spark):
    index = spark.createDataFrame([("a",)], "run_id string")
    entries = spark.createDataFrame([("a",), ("b",), ("b",)], "run_id string")
    once = index.union(c.append_new(index, entries))
    assert sorted(r[0] for r in once.collect()) == ["a", "b"]
    assert c.append_new(once, entries).count() == 0


def test_correlation(spark):
    tops = "well_id string, name string, formation_tops array<struct<formation:string,depth_m:double,tvdss_m:double>>"
    wells = spark.createDataFrame([
        ("w1", "one", [("Draupne", 100.0, 90.0), ("Hugin Fm", 200.0, 190.0), ("Hugin 2", 300.0, 290.0)]),
        ("w2", "two", [("HUGIN", 210.0, 0.0)]), ("w3", "three", [("Hugin", 205.25, None)]), ("w4", "four", [])], tops)
    ask = spark.createDataFrame([(w,) for w in ("w1", "w2", "w3", "w4", "w9")], "well_id string")
    got = c.correlate_wells(ask, wells, "hugin")
    assert {r["well_id"]: (r["top_m_tvdss"], r["status"]) for r in got.collect()} == {
        "w1": (190.0, "confirmed"), "w2": (210.0, "confirmed"), "w3": (205.25, "confirmed"),
        "w4": (None, "not_found"), "w9": (None, "fetch_error")}
    s = c.correlation_summary(got).first()
    assert (s["shallowest_m"], s["deepest_m"], s["depth_variation_m"], s["fetch_errors"]) == (190, 210, 20, 1)
    lone = c.correlation_summary(got.where("well_id = 'w1'")).first()
    assert lone["depth_variation_m"] == 0


def test_browse(spark):
    objs = spark.createDataFrame([("raw", "a/b/c.sgy", 5), ("raw", "a/d.txt", 7), ("raw", "e", 9), ("raw", "a/b/x", 1)],
                                 "container string, path string, size long")
    root = {(r["name"], r["type"], r["size"]) for r in c.browse(objs, "raw").collect()}
    assert root == {("a", "folder", None), ("e", "file", 9)}
    deep = {(r["name"], r["path"], r["type"]) for r in c.browse(objs, "raw", "a/").collect()}
    assert deep == {("b", "a/b/", "folder"), ("d.txt", "a/d.txt", "file")}
    with pytest.raises(LookupError):
        c.browse(objs, "nope")


def test_size_labels(spark):
    sizes = [0, 1024, 1025, 1280, 1 << 20, (1 << 20) + 1, 5 << 20]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long").orderBy("i")
    got = [r[0] for r in df.select(c.size_label(F.col("s"))).collect()]
    assert got == ["0 B", "1024 B", "1.0 KB", "1.2 KB", "1024.0 KB", "1.0 MB", "5.0 MB"]


def test_file_check(spark):
    e = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "name string, size long")
    a = spark.createDataFrame([("a", 104), ("b", 90)], "name string, size long")
    assert {r["name"]: r["mark"] for r in c.verify_files(e, a).collect()} == {"a": "OK", "b": "size off 10%", "c": "MISSING"}


def test_dangling_calls(spark):
    sch = ("thread_id string, seq int, role string, content string, "
           "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string")
    call = lambda *ids: [(i, "t", "{}") for i in ids]
    rows = [("a", 1, "assistant", "", call("x1"), None), ("a", 2, "user", "", None, None),
            ("a", 3, "assistant", "", call("y1", "y2"), None), ("a", 4, "tool", "", None, "y1"),
            ("b", 1, "tool", "", None, "z"), ("b", 2, "assistant", "", call("z"), None),
            ("c", 1, "assistant", "", call("q"), None), ("c", 2, "tool", "", None, "q")]
    got = {(r["thread_id"], r["call_id"]) for r in c.dangling_calls(spark.createDataFrame(rows, sch)).collect()}
    assert got == {("a", "y2"), ("b", "z")}


def test_intents(spark):
    texts = ["What is the RUN doing", "well tops 15/9", "Analyze it end-to-end", "hello", "job at the well"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(c.intent(F.col("t"))).collect()] == ["status", "wells", "interpret", "default", "status"]


def test_status_precedence(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    sch = "run_id string, survey_id string, status string, updated_at timestamp, seq long"
    live = spark.createDataFrame([("a", "s", "pending", t(1), 1), ("a", "s", "running", t(2), 2)], sch)
    kept = spark.createDataFrame([("a", "s", "complete", t(9), 0), ("b", "s", None, t(1), 0)], sch)
    got = {r["run_id"]: r["status"] for r in c.latest_status(live, kept).collect()}
    assert got == {"a": "running", "b": "complete"}


def test_reports(spark):
    sch = ("run_id string, survey_id string, status string, prob_zarr_path string, mask_zarr_path string,"
           "fault_voxel_fraction double, completed_at timestamp, error string")
    runs = spark.createDataFrame([("r1", "s", "complete", "p", "m", 0.03, dt.datetime(2024, 1, 1), None),
                                  ("r2", "s", "failed", None, None, None, None, "boom"),
                                  ("r3", "s", "running", None, None, None, None, None)], sch)
    q = {r["run_id"]: r for r in c.qc_reports(runs).collect()}
    assert {k: v["overall_status"] for k, v in q.items()} == {"r1": "pass", "r2": "fail", "r3": "pending"}
    assert len(q["r1"]["sections"]) == 2 and "boom" in q["r2"]["sections"][0]["details"]
    s = c.run_summary(runs).collect()
    assert [r["run_id"] for r in s] == ["r1"] and "0.0300" in s[0]["summary"]
    assert s[0]["qc_stats"]["mask_zarr_path"] == "m" and s[0]["qc_stats"]["fault_voxel_fraction"] == 0.03 and len(s[0]["key_findings"]) == 3
    linked = c.run_summary(runs.selectExpr("*", "'u' AS download_url")).first()
    assert linked["key_findings"][3] == "download from u"
    x = c.export_packages(runs, runs, overlays=False).first()
    assert x["export_id"] == "export-r1" and len(x["included_artifacts"]) == 3
    assert {r["run_id"]: r["state"] for r in c.run_results(runs).collect()}["r3"] == "conflict"


def test_status_stream_keeps_late_events(spark, tmp_path):
    sch = "run_id string, survey_id string, status string, updated_at timestamp, seq long"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    feeds = [[("a", "s", "pending", at(1), 1), ("b", "s", "pending", at(1), 1)],
             [("a", "s", "running", at(8), 2)], [("b", "s", "failed", at(2), 2), ("a", "s", "complete", at(9), 3)]]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for rows in feeds:
        spark.createDataFrame(rows, sch).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(sch).parquet(str(src))
        run_status.feed(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {r["run_id"]: r["status"] for r in run_status.current(spark.read.parquet(out)).collect()}
    assert got == {"a": "complete", "b": "failed"}  # hours late, and still the last event of b


def test_status_log_is_folded(spark, tmp_path):
    """50 batches leave a bounded log; repeated batches, folded or not, and a broken fold change nothing."""
    out, schema = str(tmp_path / "log"), run_status.EVENT
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batch = lambda n: spark.createDataFrame(
        [(f"r{n % 7}", "s", f"state-{n}", day(n), n), ("late", "s", f"state-{n}", day(-n), n)], schema).coalesce(1)
    assert run_status.current(run_status.changes(spark, out)).count() == 0
    for n in range(50):
        run_status.add_batch(batch(n), n, out, fold_every=10)
        if n in (3, 25, 49):
            run_status.add_batch(batch(n), n, out, fold_every=10)
            run_status.add_batch(batch(n // 2), n // 2, out, fold_every=10)
    read = run_status.changes(spark, out)
    got = {r["run_id"]: r["status"] for r in run_status.current(read).collect()}
    want = {f"r{n % 7}": f"state-{n}" for n in range(50)} | {"late": "state-0"}
    assert got == want and len(read.inputFiles()) <= 9      # of one table: 8 rows in at most 8 files
    held = sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("batch="))
    assert held == [f"batch={n}" for n in range(40, 50)]
    assert sorted(p.name for p in (tmp_path / "log" / "_base").iterdir()) == ["upto=39", "upto=49"]
    (tmp_path / "log" / "_base" / "upto=49" / "_SUCCESS").unlink()     # a fold that did not end
    assert {r["run_id"]: r["status"] for r in run_status.current(run_status.changes(spark, out)).collect()} == want


def test_well_detail(spark):
    wells = spark.createDataFrame([("w1", "One"), ("w2", "Two")], "well_id string, name string")
    assert c.well_detail(wells, "w2").first()["name"] == "Two"
    with pytest.raises(LookupError, match="w9"):
        c.well_detail(wells, "w9")


def test_prefixes_of_any_length(spark):
    ids = spark.createDataFrame([("a" * 80 + "x",), ("a" * 80 + "y",), ("b",), ("bc",)], "run_id string")
    asked = ["a" * 70, "a" * 80 + "x", "a" * 81, "b", "bc", "c", "", "a" * 80 + "y"]
    req = spark.createDataFrame([(r,) for r in asked * 2], "request string")
    got = {r["request"]: (r["state"], r["run_id"]) for r in c.resolve_run_ids(req, ids).collect()}
    assert got == {"a" * 70: ("ambiguous", None), "a" * 80 + "x": ("resolved", "a" * 80 + "x"), "a" * 81: ("not_found", None),
                   "b": ("resolved", "b"), "bc": ("resolved", "bc"), "c": ("not_found", None), "": ("ambiguous", None),
                   "a" * 80 + "y": ("resolved", "a" * 80 + "y")}
    alone = c.resolve_run_ids(spark.createDataFrame([("",)], "request string"), ids.limit(1)).first()
    assert alone["state"] == "resolved"


def test_runs_without_line_numbers(spark):
    """Their rows count from 0; the overlay gives them the numbers of the grid, and positions beyond it are refused."""
    traces = spark.createDataFrame([("a", 100 + 5 * i, 7 + 2 * x, [float(i), float(x)]) for i in range(3) for x in range(2)],
                                   "survey_id string, inline int, crossline int, samples array<float>")
    probs = spark.createDataFrame([("r", "a", i, x, [0.2 * i, 0.5]) for i in range(3) for x in range(2)],
                                  "run_id string, survey_id string, inline int, crossline int, prob array<double>")
    grid = spark.createDataFrame([("a", 100, 110, 5, 3, 7, 9, 2, 2)], "survey_id string, inline_min int, inline_max int, inline_step int,"
                                 "n_inlines int, crossline_min int, crossline_max int, crossline_step int, n_crosslines int")
    rows = slices.positional_overlay(traces, probs, grid, 2).orderBy("crossline").collect()
    assert [(r["inline"], r["crossline"], list(r["samples"]), list(r["mask"])) for r in rows] == [
        (110, 7, [2.0, 0.0], [0, 1]), (110, 9, [2.0, 1.0], [0, 1])]
    assert slices.positional_overlay(traces, probs, grid, 3).count() == 0
    runs = spark.createDataFrame([("r", None)], "run_id string, inline_coords array<int>")
    slices.require_in_run(runs, "r", 2, n_inlines=3)
    with pytest.raises(LookupError, match="position 3"):
        slices.require_in_run(runs, "r", 3, n_inlines=3)


def test_blocks_of_a_scan_follow_the_rows(spark):
    from lithoframe.functions.scans import OrderedScan

    df = spark.range(1000).selectExpr("0 AS k", "id AS o", "1 AS v")
    scan = OrderedScan.on_any_order(df, ["k"], ["o"], rows=1000, rows_per_block=50)
    sizes = [r["count"] for r in scan.df.groupBy("_blk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150
    got = scan.running({"n": ("sum", F.col("v")), "last": ("last", F.when(F.col("o") % 100 == 7, F.col("o")))}).result()
    assert got.rdd.getNumPartitions() == 20
    assert sorted((r["o"], r["n"], r["last"]) for r in got.collect()) == [
        (o, o + 1, o - (o - 7) % 100 if o >= 7 else None) for o in range(1000)]
