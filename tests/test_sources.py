import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe import schema
from lithoframe.sources import catalogs, listing, segy, sidecars, tables, volume
from lithoframe.sources.text import text_lines


def ibm(value):
    """A float as an IBM word."""
    if value == 0:
        return 0
    sign, size, power = (1 if value < 0 else 0), abs(value), 64
    while size >= 1:
        size, power = size / 16, power + 1
    while size < 1 / 16:
        size, power = size * 16, power - 1
    return sign << 31 | power << 24 | int(size * (1 << 24))


def make_segy(path, cells, n, dt=4000, encoding=segy.IEEE_FLOAT, scalar=-10):
    head = bytearray(3600)
    for at, v in ((3216, dt), (3220, n), (3224, encoding)):
        struct.pack_into(">h", head, at, v)
    body = b""
    for (il, xl), samples in cells:
        th = bytearray(240)
        struct.pack_into(">h", th, 70, scalar)
        struct.pack_into(">h", th, 108, 100)
        for at, v in ((180, il * 100), (184, xl * 100), (188, il), (192, xl)):
            struct.pack_into(">i", th, at, v)
        if encoding == segy.IEEE_FLOAT:
            body += bytes(th) + np.asarray(samples, ">f4").tobytes()
        else:
            body += bytes(th) + b"".join(struct.pack(">I", ibm(v)) for v in samples)
    path.write_bytes(bytes(head) + body)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(5)
    return [((il, xl), rng.normal(size=100).astype("f4")) for il in range(1, 6) for xl in range(1, 6)]


def test_split_read(spark, tmp_path, cells):
    make_segy(tmp_path / "tiny.sgy", cells, 100, dt=2000)
    df = segy.read_segy(spark, str(tmp_path), partition_bytes=2000)
    assert df.rdd.getNumPartitions() > 5
    rows = df.orderBy("trace_no").collect()
    assert [(r["inline"], r["crossline"]) for r in rows] == [c for c, _ in cells]
    assert all(np.array_equal(np.float32(r["samples"]), v) for r, (_, v) in zip(rows, cells))
    r = rows[7]
    assert (r["survey_id"], r["dt_ms"], r["delay_ms"], r["coord_scalar"], r["n_samples"]) == ("tiny", 2.0, 100.0, -10, 100)
    assert (r["cdp_x"], r["cdp_y"]) == (r["inline"] * 100, r["crossline"] * 100)


class CountingFile:
    """A file that adds up the bytes asked for."""

    def __init__(self, f, seen):
        self.f, self.seen = f, seen

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read_at(self, n, at):
        self.seen.append(n)
        return self.f.read_at(n, at)


def counted(monkeypatch):
    seen, plain = [], segy._open

    class System:
        def __init__(self, system):
            self.get_file_info = system.get_file_info
            self.open_input_file = lambda name: CountingFile(system.open_input_file(name), seen)

    monkeypatch.setattr(segy, "_open", lambda path: (lambda s, n: (System(s), n))(*plain(path)))
    return seen


def test_headers_only_skips_samples(spark, tmp_path, monkeypatch):
    n = 1000
    make_segy(tmp_path / "h.sgy", [((il, xl), np.zeros(n, "f4")) for il in range(1, 6) for xl in range(1, 6)], n)
    whole = segy.read_segy(spark, str(tmp_path)).drop("samples").collect()
    heads = segy.read_segy(spark, str(tmp_path), headers_only=True, partition_bytes=9000)
    assert "samples" not in heads.columns and sorted(heads.collect()) == sorted(whole)
    assert [r["inline"] for r in heads.where("inline = 3").collect()] == [3] * 5
    seen = counted(monkeypatch)
    reader = segy.SegyReader({"path": str(tmp_path), "headers_only": "true"})
    parts = reader.partitions()
    assert seen == []      # nothing is opened to plan the read
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 25
    assert sum(seen) == 3600 + 25 * 240
    seen.clear()
    monkeypatch.setattr(segy, "SKIP_BYTES", 1 << 20)     # samples that are too few to skip are read through
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 25
    assert sum(seen) == 3600 + 25 * 4240


@pytest.mark.parametrize("size", [1, 17, 239, 640, 641, 3599, 3600, 3601, 4240, 1 << 20])
def test_ranges_of_any_size_hold_each_record_once(tmp_path, cells, size):
    make_segy(tmp_path / "t.sgy", cells[:7], 100)
    make_segy(tmp_path / "u.sgy", cells[7:9], 100)
    make_segy(tmp_path / "v.sgy", [], 100)      # file headers without a trace
    reader = segy.SegyReader({"path": str(tmp_path), "partition_bytes": str(size)})
    got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("trace_no").to_pylist()]
    assert got == [*range(7), segy.FILE_STRIDE, segy.FILE_STRIDE + 1]


def test_broken_headers(spark, tmp_path):
    for name, content in (("empty.sgy", b""), ("short.sgy", bytes(3000))):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match="shorter than its file headers"):
            segy.read_segy(spark, str(tmp_path / name)).count()


def test_ibm_floats(spark, tmp_path):
    values = [0.0, 1.0, -1.0, 118.625, -118.625, 0.1, 3.5e-5, -7.25e6]
    make_segy(tmp_path / "i.sgy", [((1, 1), values)], 8, encoding=segy.IBM_FLOAT)
    assert segy.read_segy(spark, str(tmp_path / "i.sgy")).first()["samples"] == pytest.approx(values, rel=1e-6)


def test_filters_reach_the_source(spark, tmp_path, cells):
    make_segy(tmp_path / "t.sgy", cells, 100)
    df = segy.read_segy(spark, str(tmp_path / "t.sgy")).where("inline >= 3 and crossline = 2")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ">= 3" not in plan and "= 2)" not in plan  # nothing is left for Spark but null checks


def test_bytes_and_errors(spark, tmp_path, cells):
    make_segy(tmp_path / "t.sgy", cells, 100)
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.sgy"))
    assert segy.from_bytes(files).count() == 25
    (tmp_path / "bad.sgy").write_bytes((tmp_path / "t.sgy").read_bytes()[:-10])
    with pytest.raises(Exception, match="whole trace records"):
        segy.read_segy(spark, str(tmp_path / "bad.sgy")).count()
    make_segy(tmp_path / "odd.sgy", cells, 100)
    raw = bytearray((tmp_path / "odd.sgy").read_bytes())
    struct.pack_into(">h", raw, 3224, 8)
    (tmp_path / "odd.sgy").write_bytes(raw)
    with pytest.raises(Exception, match="unsupported sample encoding 8"):
        segy.read_segy(spark, str(tmp_path / "odd.sgy")).count()
    with pytest.raises(Exception):
        segy.read_segy(spark, str(tmp_path / "missing.sgy")).count()


def test_volume_round_trip(spark, tmp_path, volume_of):
    t = volume_of([((il, xl), [il, xl]) for il in range(60, 70) for xl in range(4)])
    path = str(tmp_path / "v")
    volume.write_volume(t, path)
    with pytest.raises(Exception, match="exists"):
        volume.write_volume(t, path)
    volume.write_volume(t, path, overwrite=True)
    back = volume.read_volume(spark, path)
    part = volume.inline_range(back, 64, 66)
    assert part.count() == 12
    assert "PartitionFilters: [isnotnull(il_block" in part._jdf.queryExecution().executedPlan().toString()


def test_text_lines_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes(b"one\n\xff\xfe\nthree\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith("a.txt"))
    assert a == list(enumerate(lines))
    b = sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith("b.txt"))
    assert [x[0] for x in b] == [0, 1, 2] and b[2][1] == "three"


def test_amplitude_tables(spark):
    wide = spark.createDataFrame([(1, 2, 0.5, 0.25, 9.0)], "IL int, xl int, amp_10 double, amp_2 double, other double")
    t = tables.wide_to_traces(tables.recognise(wide), "s").first()
    assert (t["inline"], t["crossline"], t["samples"]) == (1, 2, [0.25, 0.5])
    with pytest.warns(UserWarning):
        assert tables.recognise(spark.range(1)) is None
    long = spark.createDataFrame([(1, 2, 8.0, 3.0), (1, 2, 0.0, 1.0), (1, 2, 4.0, 2.0)],
                                 "inline int, crossline int, twtt_ms double, amplitude double")
    assert tables.long_to_traces(long, "s").first()["samples"] == [1, 2, 3]


def test_sidecars(spark, tmp_path):
    for sid, text in (("a", json.dumps({"survey_id": "other", "source_file": "f", "geometry": {"n_inlines": 3}})), ("b", "{broken")):
        (tmp_path / "surveys" / sid).mkdir(parents=True)
        (tmp_path / "surveys" / sid / "metadata.json").write_text(text)
    where = f"{tmp_path}/surveys/*/metadata.json"
    rows = sidecars.read_sidecars(spark, where, schema.SURVEYS, "surveys", "survey_id").collect()
    assert [(r["survey_id"], r["source_file"], r["geometry"]["n_inlines"]) for r in rows] == [("a", "f", 3)]
    with pytest.raises(Exception):
        sidecars.read_sidecars(spark, where, schema.SURVEYS, "surveys", "survey_id", strict=True).collect()


def test_report_nulls(spark, tmp_path):
    sidecars.write_report(spark.createDataFrame([(float("inf"), 1.0), (2.0, float("nan"))], "a double, b double"), str(tmp_path / "r"))
    rows = spark.read.json(str(tmp_path / "r")).collect()
    assert sorted((r["a"] is None, r["b"] is None) for r in rows) == [(False, True), (True, False)]


def test_fingerprints(spark):
    import hashlib
    small, big = b"abc", bytes(range(256)) * (5 << 12)
    files = spark.createDataFrame([("s", bytearray(small)), ("b", bytearray(big))], "path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ends = sha(big[:listing.EDGE] + big[-listing.EDGE:])
    assert {r["path"]: r["sha256"] for r in listing.fingerprint(files).collect()} == {"s": sha(small * 2), "b": ends}
    once = {r["path"]: r["sha256"] for r in listing.fingerprint(files, small_file_once=True).collect()}
    assert once == {"s": sha(small), "b": ends}


def test_discovery(spark):
    spark.range(1).createOrReplaceTempView("one_column")
    found = {(r["table"], r["n_columns"]) for r in catalogs.discover(spark).collect()}
    assert ("one_column", 1) in found
    assert catalogs.discover(spark, ("nothing-like-it",)).count() == 0
    spark.catalog.dropTempView("one_column")


def test_ingest_rows(spark, volume_of):
    from lithoframe.operators.qc import ingest_summary
    from lithoframe.plans.ingest import survey_rows
    t = volume_of([((il, xl), np.full(100, il)) for il in range(20) for xl in range(30)])
    rows = survey_rows(t, "x.sgy", True)
    r = ingest_summary(rows).first()
    assert (r["n_inlines_loaded"], r["n_samples"], r["synthetic_proxy"]) == (20, 100, True)
    assert rows.first()["amplitude_stats"]["nonzero_fraction"] == pytest.approx(0.95)
    assert rows.select(F.col("geometry.corner_points")).first()[0] is None


def test_fingerprint_reads_the_ends(spark, tmp_path):
    import hashlib
    from lithoframe.sources import listing
    data = {"empty": b"", "small": b"abc", "edge": bytes(range(64)), "large": bytes(range(256)) * 9}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in data], "path string")
    for once in (False, True):
        got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in listing.fingerprint_files(files, 64, once).collect()}
        for name, content in data.items():
            part = content if once and len(content) <= 64 else content[:64] + content[-64:]
            assert got[name] == (len(content), hashlib.sha256(part).hexdigest())


def test_arrivals_match_in_any_case(spark, tmp_path, cells):
    from lithoframe.streaming.ingest import ingest_arrivals
    raw = tmp_path / "raw"
    raw.mkdir()
    for name in ("x.sgy", "Y.SGY", "z.SegY"):
        make_segy(raw / name, cells, 100)
    (raw / "note.txt").write_text("no traces")
    ingest_arrivals(spark, str(raw), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = {r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out/status").collect()}
    assert done == {"x.sgy", "Y.SGY", "z.SegY"}


def test_ingest_job(spark, tmp_path, volume_of):
    from lithoframe.plans.ingest import ingest
    t = volume_of([((il, xl), [il + 0.5, xl, 1.0]) for il in range(1, 60) for xl in range(3)])
    rows = ingest(t, str(tmp_path / "a"), "x.sgy", sample_mode=True).collect()
    assert rows[0]["n_inlines_loaded"] == 50 and rows[0]["zarr_path"].endswith("/volume")
    assert spark.read.parquet(f"{tmp_path}/a/volume").count() == 150
    assert list(spark.read.parquet(f"{tmp_path}/a/axes").first()["inlines"]) == list(range(1, 51))
    assert spark.read.json(f"{tmp_path}/a/sidecar").first()["geometry"]["inline_max"] == 50
    with pytest.raises(Exception, match="exists"):
        ingest(t, str(tmp_path / "a"), "x.sgy")


def test_a_broken_file_is_failed(spark, tmp_path, cells):
    from lithoframe.streaming.ingest import ingest_arrivals
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    make_segy(raw / "a.sgy", cells, 100)
    make_segy(raw / "c.sgy", cells, 100)
    (raw / "b.sgy").write_bytes(b"no survey")

    def arrive():
        ingest_arrivals(spark, str(raw), str(out), str(tmp_path / "cp")).awaitTermination()
        return {r["path"].rsplit("/", 1)[1]: (r["status"], bool(r["error"])) for r in spark.read.parquet(f"{out}/status").collect()}

    one = {"a.sgy": ("complete", False), "b.sgy": ("failed", True), "c.sgy": ("complete", False)}
    assert arrive() == one
    stored = spark.read.parquet(f"{out}/traces").count()
    make_segy(raw / "d.sgy", cells, 100)     # the stream goes on, and so it does after a batch of nothing but a broken file
    assert arrive() == one | {"d.sgy": ("complete", False)}
    (raw / "e.sgy").write_bytes(b"x" * 5000)
    assert arrive()["e.sgy"] == ("failed", True)
    assert 2 * spark.read.parquet(f"{out}/traces").count() == 3 * stored


def test_sections_of_bricks(spark, tmp_path):
    from lithoframe.sources import volume
    rows = [("v", il, xl, [100.0 * il + 10.0 * xl + s for s in range(5)]) for il in range(5) for xl in range(5) if (il, xl) != (3, 4)]
    cube = spark.createDataFrame(rows, "survey_id string, il int, xl int, samples array<double>")
    size = (2, 2, 2)
    volume.write_bricks(volume.bricks(cube, size), str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    whole = {(r.il, r.xl): list(r.samples) for r in volume.brick_traces(stored).collect()}
    assert whole == {(il, xl): v for _, il, xl, v in rows}
    section = volume.brick_section(stored, "xl", 4, size)
    assert {(r.il, r.xl): list(r.samples) for r in section.collect()} == {k: v for k, v in whole.items() if k[1] == 4}
    assert {(r.il, r.xl) for r in volume.brick_section(stored, "il", 3, size).collect()} == {k for k in whole if k[0] == 3}
    deep = volume.brick_time_slice(stored, 3, size)
    assert {(r.il, r.xl): r.amplitude for r in deep.collect()} == {k: v[3] for k, v in whole.items()}
    assert volume.brick_time_slice(stored, 5, size).count() == volume.brick_section(stored, "xl", 9, size).count() == 0
    blocks = lambda df: {tuple(p.rsplit("/", 5)[1:5]) for p in (r[0] for r in df.select("_metadata.file_path").distinct().collect())}
    read = stored.where("xb = 2 and xl = 4")
    assert {b[2] for b in blocks(read)} == {"xb=2"}
    for df, key in ((section, "xb"), (deep, "sb")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert key in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_small_files_share_a_partition(tmp_path, cells):
    for i in range(10):
        make_segy(tmp_path / f"f{i}.sgy", cells[:2], 100)
    size = (tmp_path / "f0.sgy").stat().st_size
    parts = lambda limit: segy.SegyReader({"path": str(tmp_path), "partition_bytes": str(limit)}).partitions()
    assert [len(p.ranges) for p in parts(4 * size)] == [4, 4, 2]
    assert len(parts(segy.PARTITION_BYTES)) == 1 and len(parts(size)) == 10


def test_batch_writes_its_status_at_once(spark, tmp_path, cells):
    from lithoframe.streaming.ingest import ingest_arrivals

    (tmp_path / "raw").mkdir()
    for i in range(5):
        make_segy(tmp_path / "raw" / f"f{i}.sgy", cells[:2], 100)
    ingest_arrivals(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert len(list((tmp_path / "out/status").rglob("*.parquet"))) == 1
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out/status")).collect()] == ["complete"] * 5


def test_files_are_made_a_few_at_a_time(spark):
    import pyarrow as pa

    from lithoframe.queries import sources

    kind = pa.struct([("trace_no", pa.int64()), *[(n, pa.float64()) for n in segy.TRACE_FIELDS], ("samples", pa.list_(pa.float32()))])
    trace = lambda i: {"trace_no": i, **{n: float(7 * i + k) for k, n in enumerate(segy.TRACE_FIELDS)}, "samples": [i + 0.5, -i]}
    rows = pa.RecordBatch.from_arrays([
        pa.array([5, 6, 7], pa.int32()), pa.array([2, 2, 2], pa.int32()),
        pa.array([[trace(1)], [trace(2), trace(3)], [trace(4)]], pa.list_(kind))], ["inline", "n_samples", "traces"])
    made = sources._segy_files(rows.slice(1, 2))
    assert made.column("path").to_pylist() == ["il00000006.sgy", "il00000007.sgy"]
    first, second = (c.as_buffer().to_pybytes() for c in made.column("content"))
    got = segy.decode(first[3600:], segy.Layout.parse(first), "s", 0).to_pylist()
    assert [(r["inline"], r["cdp_x"], r["samples"]) for r in got] == [(18.0, 16.0, [2.5, -2.0]), (25.0, 23.0, [3.5, -3.0])]
    assert len(second) == 3600 + 248 and sources.FILES_AT_ONCE <= 64
