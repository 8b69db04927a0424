"""Reader, writer and stream queries. Files are made by Spark from the driver tables."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.functions.arrays import total
from lithoframe.functions.lineage import checkpoint_dir
from lithoframe.operators.geometry import infer_geometry
from lithoframe.operators.patches import to_index_space
from lithoframe.queries import query
from lithoframe.queries.geometry import GEOMETRY_COLUMNS, GEOMETRY_SQL
from lithoframe.queries.patches import geometry_of
from lithoframe.queries.tables import (
    RUNS, TRACES, TRUTH, q6, r6, runs, table, traces, truth,
)
from lithoframe.sources import listing, segy, sidecars, volume
from lithoframe.sources import tables as tables_source
from lithoframe.sources.text import text_lines
from lithoframe.streaming import ingest, run_status


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


FILES_AT_ONCE = 16  # files a task holds while it makes them


def _segy_files(inlines: pa.RecordBatch) -> pa.RecordBatch:
    """(path, content) from rows (inline, n_samples, traces), all records of a file as one array."""
    inline, n_samples, lists = (inlines.column(k) for k in range(3))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    traces = lists.flatten()
    field = dict(zip([f.name for f in traces.type], traces.flatten()))
    starts = field["samples"].offsets.to_numpy() - field["samples"].offsets[0].as_py()
    samples = field["samples"].flatten().to_numpy(zero_copy_only=False)
    out = []
    for n, i, j in zip(n_samples.to_pylist(), ends[:-1], ends[1:]):
        head = bytearray(segy.TEXT_HEADER + segy.BINARY_HEADER)
        for at, value in ((segy.DT_AT, 4000), (segy.SAMPLES_AT, n), (segy.FORMAT_AT, segy.IEEE_FLOAT)):
            struct.pack_into(">h", head, segy.TEXT_HEADER + at, value)
        layout = segy.Layout.parse(bytes(head))
        records = np.zeros(j - i, layout.dtype())
        for name in segy.TRACE_FIELDS:
            records[name] = field[name][i:j].to_numpy(zero_copy_only=False).astype("i8")
        records["raw"] = samples[starts[i]:starts[j]].astype("f4").view("u4").reshape(j - i, n)
        out.append(bytes(head) + records.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([f"il{k:08d}.sgy" for k in inline.to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])


def segy_bytes(spark, sf):
    """(path, content): the traces of each inline as a SEG-Y file with IEEE samples."""
    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                yield _segy_files(batch.slice(at, FILES_AT_ONCE))

    one = F.struct("trace_no", "crossline", "inline", "cdp_x", "cdp_y", "coord_scalar", "delay_ms", "samples")
    return traces(spark, sf).groupBy("inline", "n_samples").agg(
        F.sort_array(F.collect_list(one)).alias("traces")).mapInArrow(encode, "path string, content binary")


def segy_folder(spark, sf) -> str:
    """Write those files, each by the task that holds it."""
    folder = scratch(spark, "segy")

    def write(batches):
        system, base = segy._open(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content.as_buffer())
            yield batch.select([0])

    segy_bytes(spark, sf).mapInArrow(write, "path string").count()
    return folder


_TRACE_SQL = f"""WITH {TRACES}
  SELECT inline, crossline, {q6("(15.5 * inline + 21.0 * crossline + 482000.0) * 10", 0)} AS cdp_x,
         CAST(4.0 AS DOUBLE) AS dt_ms, {q6("list_sum(CAST(samples AS DOUBLE[]))")} AS total FROM traces"""


def _shown(df):
    return df.select("inline", "crossline", r6(F.col("cdp_x"), 0).alias("cdp_x"), "dt_ms", r6(total(F.col("samples"))).alias("total"))


@query("s1_segy_source", _TRACE_SQL)
def s1(spark, sf):
    return _shown(segy.read_segy(spark, segy_folder(spark, sf), partition_bytes=65536))


@query("s1_segy_headers", f"""WITH {TRACES}
  SELECT survey_id, inline, crossline, {q6("(15.5 * inline + 21.0 * crossline + 482000.0) * 10", 0)} AS cdp_x,
         CAST(4.0 AS DOUBLE) AS dt_ms, CAST(len(samples) AS INTEGER) AS n_samples FROM traces""")
def s1_headers(spark, sf):
    read = segy.read_segy(spark, segy_folder(spark, sf), survey_id="survey_0", headers_only=True, partition_bytes=65536)
    return read.select("survey_id", "inline", "crossline", r6(F.col("cdp_x"), 0).alias("cdp_x"), "dt_ms", "n_samples")


@query("g1_geometry_headers", GEOMETRY_SQL)
def g1_headers(spark, sf):
    read = segy.read_segy(spark, segy_folder(spark, sf), survey_id="survey_0", headers_only=True)
    return infer_geometry(read).select(*GEOMETRY_COLUMNS, "n_samples", "sample_rate_ms")


@query("s1_segy_pushdown", _TRACE_SQL + " WHERE inline >= 1005 AND crossline = 1911")
def s1_pushdown(spark, sf):
    read = segy.read_segy(spark, segy_folder(spark, sf))
    return _shown(read.where((F.col("inline") >= 1005) & (F.col("crossline") == 1911)))


@query("s2_segy_bytes", _TRACE_SQL)
def s2(spark, sf):
    return _shown(segy.from_bytes(segy_bytes(spark, sf)))


@query("s3_volume_sink", f"""WITH {TRACES}
  SELECT 'trace' AS part, survey_id, inline AS a, crossline AS b, {q6("list_sum(CAST(samples AS DOUBLE[]))")} AS v FROM traces
  UNION ALL SELECT DISTINCT 'inline', survey_id, inline, CAST(inline - 1001 AS INTEGER), CAST(0 AS DOUBLE) FROM traces
  UNION ALL SELECT DISTINCT 'crossline', survey_id, crossline, CAST(crossline - 1900 AS INTEGER), CAST(0 AS DOUBLE) FROM traces
  UNION ALL SELECT DISTINCT 'twtt', survey_id, CAST(0 AS INTEGER), CAST(k AS INTEGER), CAST(4 * k AS DOUBLE) FROM traces, unnest(range(64)) t(k)
  UNION ALL SELECT 'sidecar', 'survey_0', CAST(count(DISTINCT inline) AS INTEGER), CAST(count(DISTINCT crossline) AS INTEGER),
                   {q6("quantile_cont(a, 0.99)")} FROM voxels""")
def s3(spark, sf):
    from lithoframe.plans.ingest import ingest
    out, none = scratch(spark, "ingest"), F.lit(0.0)
    ingest(traces(spark, sf), out, "tables")
    stored, axes = volume.read_volume(spark, f"{out}/volume"), spark.read.parquet(f"{out}/axes")
    side = spark.read.json(f"{out}/sidecar")
    lines = lambda part, c: axes.select(F.lit(part).alias("part"), "survey_id", F.posexplode(c).alias("b", "a")).select(
        "part", "survey_id", F.col("a").cast("int").alias("a"), "b", none.alias("v"))
    twtt = axes.select(F.lit("twtt").alias("part"), "survey_id", F.lit(0).alias("a"), F.posexplode("twtt_ms").alias("b", "v"))
    return (stored.select(F.lit("trace").alias("part"), "survey_id", F.col("inline").alias("a"), F.col("crossline").alias("b"),
                          r6(total(F.col("samples"))).alias("v"))
            .unionByName(lines("inline", "inlines")).unionByName(lines("crossline", "crosslines")).unionByName(twtt)
            .unionByName(side.select(F.lit("sidecar").alias("part"), "survey_id", F.col("geometry.n_inlines").cast("int").alias("a"),
                                     F.col("geometry.n_crosslines").cast("int").alias("b"),
                                     r6(F.col("amplitude_stats.p99")).alias("v"))))


@query("s4_brick_layout", f"""WITH {TRACES}
  SELECT CAST((inline - 1001) // 8 AS INTEGER) AS ib, CAST((crossline - 1900) // 8 AS INTEGER) AS xb, CAST(s // 16 AS INTEGER) AS sb,
         count(*) AS voxels, {q6("sum(a)")} AS total FROM voxels GROUP BY ALL""")
def s4(spark, sf):
    path = scratch(spark, "bricks")
    volume.write_bricks(volume.bricks(to_index_space(traces(spark, sf), geometry_of(spark, sf)), (8, 8, 16)), path)
    return spark.read.parquet(path).groupBy("ib", "xb", "sb").agg(
        F.sum(F.size("samples")).alias("voxels"), r6(F.sum(total(F.col("samples")))).alias("total"))


@query("s5_mask_sink", f"WITH {TRACES}, {TRUTH} SELECT survey_id, il, xl, s FROM truth")
def s5(spark, sf):
    path = scratch(spark, "mask")
    volume.write_mask(truth(spark, sf), path)
    return spark.read.parquet(path)


def _long(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 40).cast("int").alias("il"), (F.col("event_id") % 30).cast("int").alias("xl"),
                    (F.col("event_id") % 16 * 4.0).alias("twtt_ms"), F.col("value").alias("amplitude"), "event_id")


_LONG = """long AS (SELECT CAST(user_id % 40 AS INTEGER) AS inline, CAST(event_id % 30 AS INTEGER) AS crossline,
                    CAST(event_id % 16 * 4 AS DOUBLE) AS twtt_ms, value, event_id FROM events)"""


@query("s6_column_aliases", f"WITH {_LONG} SELECT inline, crossline, twtt_ms, {q6('value')} AS amplitude FROM long")
def s6(spark, sf):
    return tables_source.recognise(_long(spark, sf)).select(
        "inline", "crossline", "twtt_ms", r6(F.col("amplitude")).alias("amplitude"))


@query("s7_rows_to_traces", f"""WITH {_LONG},
  u AS (SELECT inline, crossline, twtt_ms, arg_max(value, event_id) AS a FROM long GROUP BY ALL)
  SELECT inline, crossline, twtt_ms, {q6("CAST(a AS FLOAT)", 4)} AS amplitude FROM u""")
def s7(spark, sf):
    t = tables_source.long_to_traces(tables_source.recognise(_long(spark, sf)), "main", order="event_id")
    return t.select("inline", "crossline", F.explode(F.arrays_zip("twtt_ms", "samples")).alias("v")).select(
        "inline", "crossline", F.col("v.twtt_ms").alias("twtt_ms"), r6(F.col("v.samples").cast("double"), 4).alias("amplitude"))


@query("s7_wide_rows_to_traces", """
  SELECT CAST(o_orderkey AS INTEGER) AS inline, CAST(o_custkey AS INTEGER) AS crossline,
         round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) + 0.0 AS first, round(CAST(CAST(o_custkey AS FLOAT) AS DOUBLE), 2) + 0.0 AS last FROM orders""")
def s7_wide(spark, sf):
    wide = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("inline"), F.col("o_custkey").cast("int").alias("xl"),
        F.col("o_custkey").cast("double").alias("amp_10"), F.col("o_totalprice").alias("amp_2"))
    t = tables_source.wide_to_traces(tables_source.recognise(wide), "main")
    return t.select("inline", "crossline", r6(F.col("samples")[0].cast("double"), 2).alias("first"),
                    r6(F.col("samples")[1].cast("double"), 2).alias("last"))


@query("s8_text_files", """
  SELECT event_type, count(*) AS lines, CAST(sum(event_id) AS BIGINT) AS checksum FROM events GROUP BY event_type""")
def s8_files(spark, sf):
    """A folder of text per event type; every line is read back with a number of its own."""
    path = scratch(spark, "text")
    table(spark, sf, "events").select("event_type", F.col("event_id").cast("string").alias("value")).write.partitionBy(
        "event_type").text(path)
    read = text_lines(spark, f"{path}/*").dropDuplicates(["file", "line_no"])
    return read.select(F.regexp_extract("file", "event_type=([a-z]+)", 1).alias("event_type"),
                       F.col("line").cast("long").alias("event_id")).groupBy("event_type").agg(
        F.count("*").alias("lines"), F.sum("event_id").alias("checksum"))


_RUN_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("survey_id", T.StringType()),
                            T.StructField("status", T.StringType()), T.StructField("fault_voxel_fraction", T.DoubleType())])


@query("s9_json_sidecars", f"""WITH {RUNS}
  SELECT status AS run_id, survey_id, {q6("fault_voxel_fraction")} AS fault_voxel_fraction FROM runs""")
def s9(spark, sf):
    path = scratch(spark, "json")
    rows = runs(spark, sf).select("status", F.lit("ignored").alias("run_id"), "survey_id", "fault_voxel_fraction")
    for state in ("pending", "running", "complete", "failed"):
        rows.where(F.col("status") == state).drop("status").write.json(f"{path}/interpretation/{state}")
    read = sidecars.read_sidecars(spark, f"{path}/interpretation/*", _RUN_SCHEMA, "interpretation", "run_id", one_per_file=False)
    return read.select("run_id", "survey_id", r6(F.col("fault_voxel_fraction")).alias("fault_voxel_fraction"))


@query("s10_report_sink", """
  SELECT l_suppkey AS run_id, CASE WHEN min(l_tax) = 0 AND max(l_tax) > 0.07 THEN NULL ELSE max(l_tax) END AS assd
  FROM lineitem GROUP BY l_suppkey""")
def s10(spark, sf):
    path = scratch(spark, "report")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(
        F.when((F.min("l_tax") == 0) & (F.max("l_tax") > 0.07), float("inf")).otherwise(F.max("l_tax")).alias("assd"))
    sidecars.write_report(rows, path)
    return spark.read.schema("run_id long, assd double").json(path)


@query("s11_object_listing", f"""WITH {TRACES}
  SELECT 'il' || lpad(CAST(inline AS VARCHAR), 8, '0') || '.sgy' AS name, CAST(3600 + count(*) * (240 + 256) AS BIGINT) AS size
  FROM traces GROUP BY inline""")
def s11(spark, sf):
    found = listing.list_objects(spark, segy_folder(spark, sf), "raw")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "size")


@query("s12_fingerprint", """
  SELECT page_id AS path, octet_length(encode(html)) AS size, sha256(html || html) AS sha256 FROM pages""")
def s12(spark, sf):
    files = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode("html", "utf-8").alias("content"))
    return listing.fingerprint(files)


@query("s12_fingerprint_once", """
  SELECT page_id AS path, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages""")
def s12_once(spark, sf):
    files = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode("html", "utf-8").alias("content"))
    return listing.fingerprint(files, small_file_once=True)


@query("st1_arrival_ingest", _TRACE_SQL)
def st1(spark, sf):
    out = scratch(spark, "arrivals")
    stream = ingest.ingest_arrivals(spark, segy_folder(spark, sf), out, f"{out}/checkpoint", files_per_batch=40)
    stream.awaitTermination()
    return _shown(spark.read.parquet(f"{out}/traces"))


@query("st2_run_status_feed", """
  SELECT 'run-' || o_custkey AS run_id, 'survey-' || o_orderpriority AS survey_id,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
         o_orderdate AS updated_at
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def st2(spark, sf):
    out = scratch(spark, "status")
    source = table(spark, sf, "orders")
    orders = spark.readStream.schema(source.schema).parquet(f"{sf}/orders.parque*")
    status = (F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running")
              .otherwise("pending"))
    events = orders.select(
        F.concat(F.lit("run-"), "o_custkey").alias("run_id"), F.concat(F.lit("survey-"), "o_orderpriority").alias("survey_id"),
        status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderkey").alias("seq"))
    run_status.feed(events, out, f"{out}-checkpoint").awaitTermination()
    kind = source.schema["o_orderdate"].dataType
    return run_status.current(run_status.changes(spark, out)).withColumn("updated_at", F.col("updated_at").cast(kind))
