"""Survey, well, run, file and message queries."""

from pyspark.sql import functions as F

from lithoframe.operators import catalog as c
from lithoframe.operators.geometry import infer_geometry
from lithoframe.queries import query
from lithoframe.queries.tables import (
    IRREGULAR, OBJECTS, REGISTRY, RUNS, WELLS, irregular_traces, messages, objects, q6, r6, registry, runs,
    table, well_logs, wells,
)

_SIDECARS = """
  side AS (
    SELECT 'surveys/' || c_mktsegment || '-' || c_nationkey || '/' ||
           CASE WHEN c_custkey % 3 = 0 THEN 'metadata.json' WHEN c_custkey % 3 = 1 THEN c_custkey || '/metadata.json'
                ELSE c_custkey || '.txt' END AS path,
           c_name AS source_file, CAST(c_custkey % 700 AS INTEGER) AS n_inlines,
           CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 90 AS INTEGER) END AS n_inlines_loaded FROM customer),
  listed AS (
    SELECT split_part(path, '/', 2) AS survey_id, min(path) AS path, arg_min(source_file, (path, source_file)) AS source_file
    FROM side WHERE len(string_split(path, '/')) >= 3 AND path LIKE '%/metadata.json' GROUP BY 1)"""


def _sidecars(spark, sf):
    key, seg = F.col("c_custkey"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    leaf = (F.when(key % 3 == 0, "metadata.json").when(key % 3 == 1, F.concat(key, F.lit("/metadata.json")))
            .otherwise(F.concat(key, F.lit(".txt"))))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("surveys/"), seg, F.lit("/"), leaf).alias("path"), F.col("c_name").alias("source_file"),
        F.struct((key % 700).cast("int").alias("n_inlines")).alias("geometry"),
        F.when(key % 4 > 0, (key % 90).cast("int")).alias("n_inlines_loaded"))


@query("c1_survey_list", f"WITH {_SIDECARS} SELECT survey_id, path FROM listed")
def c1(spark, sf):
    return c.survey_list(_sidecars(spark, sf)).select("survey_id", "path")


@query("c2_survey_detail", f"""WITH {_SIDECARS}
  SELECT source_file AS survey_id, coalesce(n_inlines_loaded, n_inlines) AS n_inlines_loaded, false AS sample_mode FROM side""")
def c2(spark, sf):
    rows = _sidecars(spark, sf).withColumns({
        "survey_id": F.col("source_file"), "sample_mode": F.lit(None).cast("boolean")})
    return c.survey_detail(rows).select("survey_id", "n_inlines_loaded", "sample_mode")


@query("c3_survey_search", """
  SELECT c_name AS survey_id, c_mktsegment AS source_file FROM customer
  WHERE contains(lower(c_name || c_mktsegment), '7automobile') OR contains(lower(c_name || c_mktsegment), '00123')""")
def c3(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_name").alias("survey_id"), F.col("c_mktsegment").alias("source_file"))
    return c.survey_search(rows, "7AUTOmobile").unionByName(c.survey_search(rows, "00123")).distinct()


@query("c4_well_list", f"""WITH {WELLS}
  SELECT w.well_id, name, survey_id, well_type, CAST(count(t.formation) AS INTEGER) AS n_tops
  FROM wells w LEFT JOIN tops t USING (well_id) GROUP BY ALL""")
def c4(spark, sf):
    return c.well_list(wells(spark, sf))


@query("c5_well_filter", f"""WITH {WELLS}
  SELECT well_id, name, survey_id, well_type FROM wells
  WHERE (contains(lower(well_id), '9-1') OR contains(lower(name), '9-1')) AND well_type = 'production'""")
def c5(spark, sf):
    return c.well_filter(wells(spark, sf), "9-1", well_type="production").drop("formation_tops")


@query("c6_formation_tops", f"WITH {WELLS} SELECT well_id, formation, depth_m, tvdss_m FROM tops WHERE contains(lower(formation), 'o')")
def c6(spark, sf):
    return c.formation_tops(wells(spark, sf), "O")


def _requested(spark, sf):
    asked = table(spark, sf, "customer").select((F.col("c_custkey") % 1200).alias("k")).distinct()
    return asked.select(F.concat(F.lit("15/9-"), "k").alias("well_id"))


_CORRELATED = f"""{WELLS},
  req AS (SELECT DISTINCT '15/9-' || (c_custkey % 1200) AS well_id FROM customer),
  hit AS (SELECT well_id, arg_min(coalesce(nullif(tvdss_m, 0), depth_m), formation) AS top_m_tvdss FROM tops
          WHERE contains(lower(formation), 'm') GROUP BY well_id),
  cor AS (SELECT r.well_id, w.name AS well_name, h.top_m_tvdss,
                 CASE WHEN w.well_id IS NULL THEN 'fetch_error' WHEN h.well_id IS NULL THEN 'not_found' ELSE 'confirmed' END AS status
          FROM req r LEFT JOIN wells w USING (well_id) LEFT JOIN hit h USING (well_id))"""


@query("c7_correlate_wells", f"WITH {_CORRELATED} SELECT * FROM cor")
def c7(spark, sf):
    return c.correlate_wells(_requested(spark, sf), wells(spark, sf), "M")


@query("c7_correlation_summary", f"""WITH {_CORRELATED}
  SELECT count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'fetch_error') AS fetch_errors,
         min(top_m_tvdss) AS shallowest_m, max(top_m_tvdss) AS deepest_m,
         CASE WHEN count(top_m_tvdss) > 1 THEN round_even(max(top_m_tvdss) - min(top_m_tvdss), 1) ELSE 0.0 END AS depth_variation_m
  FROM cor""")
def c7_summary(spark, sf):
    return c.correlation_summary(c7(spark, sf))


@query("c8_long_logs", """
  SELECT '15/9-' || l_suppkey AS well_id, 'GR' AS mnemonic, l_extendedprice AS depth, l_quantity AS value FROM lineitem
  UNION ALL SELECT '15/9-' || l_suppkey, 'RT', l_extendedprice, nullif(l_tax, 0) FROM lineitem""")
def c8(spark, sf):
    return c.long_logs(well_logs(spark, sf))


@query("c8_log_curves", """
  SELECT '15/9-' || l_suppkey AS well_id, m AS mnemonic, CASE WHEN m = 'GR' THEN 'api' ELSE 'ohm' END AS unit,
         count(*) AS n_values FROM lineitem, (VALUES ('GR'), ('RT')) t(m) GROUP BY l_suppkey, m""")
def c8_curves(spark, sf):
    return c.log_curves(well_logs(spark, sf)).groupBy("well_id", "mnemonic", "unit").agg(
        F.sum("n_values").alias("n_values"))


@query("c9_latest_status", """
  WITH live AS (
    SELECT 'run-' || o_custkey AS run_id, 'survey-' || o_orderpriority AS survey_id,
           CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
           o_orderdate AS updated_at, o_orderkey AS seq FROM orders),
  best AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) = 1)
  SELECT run_id, survey_id, status, updated_at FROM best
  UNION ALL SELECT 'run-' || c_custkey, 'survey-' || c_mktsegment, 'complete', TIMESTAMP '2001-01-01' FROM customer
  WHERE 'run-' || c_custkey NOT IN (SELECT run_id FROM best)""")
def c9(spark, sf):
    status = (F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running")
              .otherwise("pending"))
    live = table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), "o_custkey").alias("run_id"), F.concat(F.lit("survey-"), "o_orderpriority").alias("survey_id"),
        status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("seq"))
    kept = table(spark, sf, "customer").select(
        F.concat(F.lit("run-"), "c_custkey").alias("run_id"), F.concat(F.lit("survey-"), "c_mktsegment").alias("survey_id"),
        F.lit(None).cast("string").alias("status"), F.lit("2001-01-01").cast("timestamp_ntz").alias("updated_at"),
        F.lit(0).cast("long").alias("seq"))
    kept = kept.withColumn("updated_at", F.col("updated_at").cast(live.schema["updated_at"].dataType))
    return c.latest_status(live, kept)


@query("c10_run_results", f"""WITH {RUNS}
  SELECT run_id, survey_id, status, CASE WHEN status = 'complete' THEN 'ok' ELSE 'conflict' END AS state,
         prob_zarr_path, mask_zarr_path, {q6("fault_voxel_fraction")} AS fault_voxel_fraction, completed_at FROM runs""")
def c10(spark, sf):
    return c.run_results(runs(spark, sf)).withColumn("fault_voxel_fraction", r6(F.col("fault_voxel_fraction")))


@query("c11_resolve_run_ids", """
  WITH ids AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS run_id FROM orders),
  req AS (SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN 'zz' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6)
                               WHEN o_custkey % 5 = 2 AND o_custkey % 11 = 0 THEN ''
                               WHEN o_custkey % 5 = 1 THEN md5(CAST(o_orderkey AS VARCHAR))
                               ELSE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2 + CAST(o_custkey % 7 AS INTEGER)) END AS request FROM orders),
  pre AS (SELECT substr(run_id, 1, n) AS request, count(*) AS m, min(run_id) AS sole FROM ids, unnest(range(0, 33)) t(n) GROUP BY 1)
  SELECT request, CASE WHEN coalesce(m, 0) = 0 THEN 'not_found' WHEN m = 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
         CASE WHEN m = 1 THEN sole END AS run_id FROM req LEFT JOIN pre USING (request)""")
def c11(spark, sf):
    o = table(spark, sf, "orders")
    run_id, kind = F.md5(F.col("o_orderkey").cast("string")), F.col("o_custkey") % 5
    request = (F.when(kind == 0, F.concat(F.lit("zz"), F.substr(run_id, F.lit(1), F.lit(6)))).when(
        (kind == 2) & (F.col("o_custkey") % 11 == 0), "").when(kind == 1, run_id)
               .otherwise(F.substr(run_id, F.lit(1), (F.col("o_custkey") % 7 + 2).cast("int"))))
    return c.resolve_run_ids(o.select(request.alias("request")), o.select(run_id.alias("run_id")))


@query("c12_index_append", """
  SELECT DISTINCT 'run-' || k AS run_id FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders)
  WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def c12(spark, sf):
    run = lambda column: F.concat(F.lit("run-"), F.col(column)).alias("run_id")
    orders = table(spark, sf, "orders")
    return c.append_new(table(spark, sf, "customer").select(run("c_custkey")),
                        orders.select(run("o_custkey")).unionByName(orders.select(run("o_orderkey"))))


@query("c13_run_submission", """
  SELECT md5(CAST(o_orderkey AS VARCHAR)) AS run_id, 'survey-' || o_custkey AS survey_id, 'pending' AS status,
         o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""")
def c13(spark, sf):
    return c.pending_runs(runs(spark, sf).withColumn("requested_at", F.col("updated_at")))


_BROWSE = """
  rel AS (SELECT substr(path, {n} + 1) AS rel, size FROM objects WHERE starts_with(path, '{p}') AND length(path) > {n}),
  lvl AS (SELECT split_part(rel, '/', 1) AS name, contains(rel, '/') AS deeper, max(size) AS size FROM rel GROUP BY ALL),
  items AS (SELECT name, '{p}' || name || CASE WHEN deeper THEN '/' ELSE '' END AS path,
                   CASE WHEN deeper THEN 'folder' ELSE 'file' END AS type, CASE WHEN NOT deeper THEN size END AS size FROM lvl)"""


@query("c14_browse_root", f"WITH {OBJECTS}, {_BROWSE.format(p='', n=0)} SELECT name, path, type, size FROM items")
def c14(spark, sf):
    return c.browse(objects(spark, sf), "raw")


_HOST = "blog."


@query("c14_browse_prefix", f"WITH {OBJECTS}, {_BROWSE.format(p=_HOST, n=len(_HOST))} SELECT name, path, type, size FROM items")
def c14_prefix(spark, sf):
    return c.browse(objects(spark, sf), "raw", _HOST)


@query("c15_listing_labels", f"""WITH {OBJECTS}
  SELECT 'file' AS type, path AS name, path, CASE WHEN size > 1048576 THEN printf('%.1f MB', size / 1048576)
         WHEN size > 1024 THEN printf('%.1f KB', size / 1024) ELSE size || ' B' END AS size_label
  FROM objects WHERE contains(lower(path), '.net')""")
def c15(spark, sf):
    items = objects(spark, sf).select(F.lit("file").alias("type"), F.col("path").alias("name"), "path", "size")
    return c.listing(items, ".NET")


@query("c16_registry_lookup", f"""WITH {REGISTRY}
  SELECT component, survey, file_path, file_size_bytes, {q6("file_size_bytes / 1e9", 9)} AS size_gb FROM registry
  WHERE lower(component) = 'en' ORDER BY file_size_bytes DESC, file_path LIMIT 5""")
def c16(spark, sf):
    return c.registry_lookup(registry(spark, sf), "EN").withColumn("size_gb", r6(F.col("size_gb"), 9))


@query("c17_survey_inventory", f"""WITH {IRREGULAR}
  SELECT survey_id AS survey_name, CAST(n_inlines AS INTEGER) AS n_inlines, CAST(n_crosslines AS INTEGER) AS n_crosslines,
         CAST(n_samples AS INTEGER) AS n_samples, inline_min, inline_max, crossline_min, crossline_max FROM geom ORDER BY 1""")
def c17(spark, sf):
    return c.survey_inventory(infer_geometry(irregular_traces(spark, sf)))


@query("c18_registry_like", f"WITH {REGISTRY} SELECT * FROM registry WHERE file_path ILIKE '%SRC1%' ORDER BY component, file_path")
def c18(spark, sf):
    return c.registry_like(registry(spark, sf), "SRC1")


@query("c19_verify_files", """
  WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS name, n_chars AS expected_size FROM documents),
  a AS (SELECT CAST(d.doc_id AS VARCHAR) AS name, n_chars + n_chars * (d.doc_id % 13) // 100 AS actual_size
        FROM documents d JOIN labels USING (doc_id)),
  j AS (SELECT name, expected_size, actual_size, abs(actual_size - expected_size) / expected_size * 100 AS off FROM e LEFT JOIN a USING (name))
  SELECT name, expected_size, actual_size, CASE WHEN actual_size IS NULL THEN 'MISSING' WHEN off < 5 THEN 'OK'
         ELSE 'size off ' || CAST(round_even(off, 0) AS BIGINT) || '%' END AS mark FROM j""")
def c19(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    name = F.col("doc_id").cast("string").alias("name")
    present = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    size = F.col("n_chars") + F.floor(F.col("n_chars") * (F.col("doc_id") % 13) / 100)
    return c.verify_files(docs.select(name, F.col("n_chars").alias("size")), present.select(name, size.alias("size")))


_ISO = "strftime(completed_at, '%Y-%m-%dT%H:%M:%S')"


@query("c20_run_summary", f"""WITH {RUNS}
  SELECT run_id, survey_id AS dataset_id, status,
         'Run ' || run_id || ' scored ' || survey_id || ' and marked a share of ' || printf('%.4f', fault_voxel_fraction) ||
         ' of its samples as fault; finished ' || {_ISO} || '.' AS summary,
         'probabilities in ' || prob_zarr_path || '|mask in ' || mask_zarr_path ||
         '|share of fault samples ' || printf('%.4f', fault_voxel_fraction) ||
         CASE WHEN fault_voxel_fraction > 0.02 THEN '|download from store/' || run_id ELSE '' END AS findings, 2 AS n_caveats,
         {q6("fault_voxel_fraction")} AS stats_fraction, prob_zarr_path AS stats_prob, mask_zarr_path AS stats_mask
  FROM runs WHERE status = 'complete'""")
def c20(spark, sf):
    held = F.when(F.col("fault_voxel_fraction") > 0.02, F.concat(F.lit("store/"), "run_id"))
    return c.run_summary(runs(spark, sf).withColumn("download_url", held)).select(
        "run_id", "dataset_id", "status", "summary", F.array_join("key_findings", "|").alias("findings"),
        F.size("caveats").alias("n_caveats"), r6(F.col("qc_stats.fault_voxel_fraction")).alias("stats_fraction"),
        F.col("qc_stats.prob_zarr_path").alias("stats_prob"), F.col("qc_stats.mask_zarr_path").alias("stats_mask"))


@query("c21_export_packages", f"""WITH {RUNS}
  SELECT 'export-' || run_id AS export_id, survey_id, status, prob_zarr_path AS package_path,
         'probability: ' || prob_zarr_path || '|mask: ' || mask_zarr_path ||
         '|state: complete|overlay of any inline of ' || run_id AS artifacts
  FROM runs WHERE status = 'complete'""")
def c21(spark, sf):
    r = runs(spark, sf)
    return c.export_packages(r.select("run_id", "status"), r).select(
        "export_id", "survey_id", "status", "package_path", F.array_join("included_artifacts", "|").alias("artifacts"))


@query("c22_qc_reports", f"""WITH {RUNS}
  SELECT 'qc-report-' || run_id AS report_id, survey_id AS dataset_id,
         CASE WHEN status = 'complete' THEN 'pass' WHEN error IS NOT NULL THEN 'fail' ELSE 'pending' END AS overall_status,
         CAST(CASE WHEN status = 'complete' THEN 2 ELSE 1 END AS INTEGER) AS n_sections,
         'Run ' || run_id || ' of ' || survey_id || ' is ' || status || coalesce(' after the error: ' || error, '') AS first_details,
         CASE WHEN status = 'complete' THEN 'Lay the overlays of run ' || run_id || ' over its inlines and hold them against the well tops.'
              ELSE 'Come back later: the run is ' || status || '.' END AS recommended_action,
         CAST(CASE WHEN status = 'complete' THEN 100 WHEN error IS NOT NULL THEN 0 ELSE 50 END AS INTEGER) AS progress
  FROM runs""")
def c22(spark, sf):
    return c.qc_reports(runs(spark, sf)).select(
        "report_id", "dataset_id", "overall_status", F.size("sections").alias("n_sections"),
        F.col("sections")[0]["details"].alias("first_details"), "recommended_action", "progress")


@query("c23_dangling_calls", """
  WITH asks AS (SELECT conv_id, turn, length(text) % 3 AS n FROM conversations WHERE role = 'assistant' AND length(text) % 3 > 0),
  last AS (SELECT conv_id, max(turn) AS turn, CAST(arg_max(n, turn) AS INTEGER) AS n FROM asks GROUP BY conv_id),
  calls AS (SELECT conv_id, turn, conv_id || '-' || turn || '-' || k AS call_id FROM last, unnest(range(n)) t(k)),
  replies AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) || '-0' AS call_id FROM conversations WHERE role = 'user' AND turn > 0)
  SELECT conv_id AS thread_id, call_id, turn AS seq FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM replies r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id AND r.turn > c.turn)""")
def c23(spark, sf):
    return c.dangling_calls(messages(spark, sf))


def _has(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("c24_intent_tally", f"""
  SELECT CASE WHEN {_has(c.INTENT_WORDS['status'])} THEN 'status' WHEN {_has(c.INTENT_WORDS['wells'])} THEN 'wells'
              WHEN {_has(c.INTENT_WORDS['interpret'])} THEN 'interpret' ELSE 'default' END AS intent, count(*) AS messages
  FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents) GROUP BY 1""")
def c24(spark, sf):
    text = F.col("text").alias("content")
    both = table(spark, sf, "conversations").select(text).unionByName(table(spark, sf, "documents").select(text))
    return c.intent_tally(both)
