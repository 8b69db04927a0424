"""Survey, well, run, file and message tables: lookups, joins and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut
from lithoframe.functions.scans import OrderedScan

# --- surveys ---------------------------------------------------------------------------------


def survey_list(sidecars: DataFrame) -> DataFrame:
    """One row per survey from (path, ...) sidecar rows named ``surveys/<id>/.../metadata.json``.

    The id comes from the path; of several sidecars of a survey the first path counts.
    """
    part = F.split("path", "/")
    rows = sidecars.where((F.size(part) >= 3) & (F.element_at(part, -1) == "metadata.json")).withColumn(
        "survey_id", F.get(part, F.lit(1)))
    rest = [c for c in sidecars.columns if c != "survey_id"]
    first = rows.groupBy("survey_id").agg(F.min_by(F.struct(*rest), "path").alias("r"))
    return first.select("survey_id", "r.*")


def survey_detail(surveys: DataFrame, survey_id: str | None = None) -> DataFrame:
    """Survey rows with defaults: lines loaded falls back to the line count of the geometry."""
    rows = surveys if survey_id is None else surveys.where(F.col("survey_id") == survey_id)
    return rows.withColumns({
        "source_file": F.coalesce("source_file", F.lit("")),
        "sample_mode": F.coalesce("sample_mode", F.lit(False)),
        "n_inlines_loaded": F.coalesce("n_inlines_loaded", F.col("geometry.n_inlines"), F.lit(0))})


def survey_search(surveys: DataFrame, text: str | None = None, fmt: str = "any") -> DataFrame:
    """Case-insensitive text in id or source file; optional membership of ``formats``."""
    rows = surveys
    if text:
        named = F.concat(F.coalesce("survey_id", F.lit("")), F.coalesce("source_file", F.lit("")))
        rows = rows.where(F.contains(F.lower(named), F.lit(text.lower())))
    if fmt != "any":
        rows = rows.where(F.array_contains("formats", fmt))
    return rows


# --- wells -----------------------------------------------------------------------------------


def well_list(wells: DataFrame) -> DataFrame:
    return wells.select("well_id", "name", "survey_id", "well_type",
                        F.size("formation_tops").alias("n_tops"))


def well_detail(wells: DataFrame, well_id: str) -> DataFrame:
    """The record of one well, formation tops and all; LookupError for an unknown id."""
    found = wells.where(F.col("well_id") == well_id)
    if found.isEmpty():
        raise LookupError(f"well {well_id!r} not found")
    return found


def well_filter(wells: DataFrame, text: str | None = None, survey_id: str | None = None,
                well_type: str | None = None) -> DataFrame:
    rows = wells
    if text:
        low = F.lit(text.lower())
        rows = rows.where(F.contains(F.lower("well_id"), low) | F.contains(F.lower("name"), low))
    if survey_id:
        rows = rows.where(F.col("survey_id") == survey_id)
    if well_type:
        rows = rows.where(F.col("well_type") == well_type)
    return rows


def _names(top: Column, formation: str) -> Column:
    return F.contains(F.lower(top["formation"]), F.lit(formation.lower()))


def formation_tops(wells: DataFrame, formation: str | None = None) -> DataFrame:
    """One row per top, optionally only those whose name holds the text."""
    tops = F.col("formation_tops")
    if formation:
        tops = F.filter(tops, lambda t: _names(t, formation))
    return wells.select("well_id", F.explode(tops).alias("t")).select("well_id", "t.*")


def correlate_wells(requested: DataFrame, wells: DataFrame, formation: str) -> DataFrame:
    """The first matching top of each requested well.

    Depth is the vertical depth, or the measured one where that is missing or 0. Unknown wells stay
    in the result as fetch errors.
    """
    known = wells.withColumn("top", F.get(
        F.filter("formation_tops", lambda t: _names(t, formation)), F.lit(0)))
    depth = F.coalesce(F.nullif(F.col("top.tvdss_m"), F.lit(0.0)), F.col("top.depth_m"))
    status = (F.when(F.col("known").isNull(), "fetch_error")
              .when(F.col("top").isNotNull(), "confirmed").otherwise("not_found"))
    return requested.join(
        known.select("well_id", F.col("name").alias("well_name"), "top", F.lit(True).alias("known")),
        "well_id", "left").select("well_id", "well_name", depth.alias("top_m_tvdss"), status.alias("status"))


def correlation_summary(correlated: DataFrame) -> DataFrame:
    """Depth range over the wells that have the formation; variation needs two."""
    d = F.col("top_m_tvdss")
    return correlated.agg(
        F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("status") == "fetch_error").alias("fetch_errors"),
        F.min(d).alias("shallowest_m"), F.max(d).alias("deepest_m"),
        F.when(F.count(d) > 1, F.bround(F.max(d) - F.min(d), 1)).otherwise(0.0).alias("depth_variation_m"))


def log_curves(logs: DataFrame) -> DataFrame:
    """Curves of each well."""
    return logs.select("well_id", F.explode("curves").alias("c")).select(
        "well_id", "c.mnemonic", "c.unit", F.size("c.values").alias("n_values"))


def long_logs(logs: DataFrame) -> DataFrame:
    """(well_id, mnemonic, depth, value) with missing readings as null."""
    curves = logs.select("well_id", "depth_values", F.explode("curves").alias("c"))
    return curves.select("well_id", "c.mnemonic", F.explode(
        F.arrays_zip(F.col("depth_values").alias("depth"), F.col("c.values").alias("value"))).alias("p")).select(
        "well_id", "mnemonic", F.col("p.depth").alias("depth"), F.col("p.value").alias("value"))


# --- runs ------------------------------------------------------------------------------------


def latest_status(live: DataFrame, persisted: DataFrame) -> DataFrame:
    """Current state per run: the latest live event, else the persisted manifest.

    Both are (run_id, survey_id, status, updated_at, seq); ``seq`` settles equal times. A manifest
    without status is complete.
    """
    cols = ["run_id", "survey_id", "status", "updated_at", "seq"]
    rows = live.select(*cols, F.lit(1).alias("is_live")).unionByName(
        persisted.select(*cols, F.lit(0).alias("is_live")))
    return rows.groupBy("run_id").agg(F.max_by(
        F.struct("survey_id", F.coalesce("status", F.lit("complete")).alias("status"), "updated_at"),
        F.struct("is_live", "updated_at", "seq")).alias("r")).select("run_id", "r.*")


def run_results(runs: DataFrame) -> DataFrame:
    """Result paths of complete runs; any other run is a conflict without paths."""
    done = F.col("status") == "complete"
    shown = ("prob_zarr_path", "mask_zarr_path", "fault_voxel_fraction", "completed_at")
    return runs.select("run_id", "survey_id", "status",
                       F.when(done, "ok").otherwise("conflict").alias("state"),
                       *[F.when(done, F.col(c)).alias(c) for c in shown])


def resolve_run_ids(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """Each request as an exact id, else as a prefix of exactly one id; an empty one is a prefix of all.

    Ids and the two ends of every prefix range are put in one order. The ids counted between the ends match, and the
    last id before the far end is the only match where there is one. Prefixes may be of any length.
    """
    asked = cut(requests.select("request").distinct())
    known = cut(ids.select("run_id").distinct())
    row = lambda at, kind, request, run_id: (F.lit(0).alias("all"), at.alias("at"), F.lit(kind).alias("kind"),
                                             request.alias("request"), run_id.alias("run_id"))
    none = F.lit(None).cast("string")
    request, far = F.col("request"), F.concat("request", F.lit("\U0010ffff"))
    line = (known.select(*row(F.col("run_id"), 1, none, F.col("run_id")))
            .unionByName(asked.select(*row(request, 0, request, none)))
            .unionByName(asked.select(*row(far, 2, request, none))))
    rows = known.count() + 2 * asked.count()
    scan = OrderedScan.on_any_order(line, ["all"], ["at", "kind", "request"], rows).running({
        "n": ("sum", F.when(F.col("kind") == 1, 1).otherwise(0)), "last_id": ("last", F.col("run_id"))})
    tally = scan.result().where(F.col("kind") != 1).groupBy("request").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(-F.col("n"))).alias("matches"),
        F.max(F.when(F.col("kind") == 2, F.col("last_id"))).alias("only"))
    exact = known.select(F.col("run_id").alias("request"), F.lit(True).alias("exact"))
    found = tally.join(exact, "request", "left")
    n = F.col("matches")
    state = (F.when(F.col("exact") | (n == 1), "resolved").when(n > 1, "ambiguous").otherwise("not_found"))
    return found.select("request", state.alias("state"), F.when(F.col("exact"), F.col("request")).when(
        n == 1, F.col("only")).alias("run_id"))


def append_new(index: DataFrame, entries: DataFrame, key: str = "run_id") -> DataFrame:
    """Entries not yet in the index, once each; appending them twice changes nothing."""
    return entries.dropDuplicates([key]).join(index.select(key), key, "left_anti")


def pending_runs(requests: DataFrame) -> DataFrame:
    """Submission rows from (run_id, survey_id, requested_at)."""
    return requests.select("run_id", "survey_id", F.lit("pending").alias("status"),
                           F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _or(c: Column | str, missing: str) -> Column:
    return F.coalesce(c, F.lit(missing))


def _fraction() -> Column:
    return F.format_string("%.4f", F.coalesce("fault_voxel_fraction", F.lit(0.0)))


# The wording of reports.
CAVEATS = ("Scores come from a model; the geology may differ.",
           "An interpreter has to look at them before they are used.")


def run_summary(runs: DataFrame, caveats: bool = True) -> DataFrame:
    """Findings of complete runs as text and list, and the figures behind them as ``qc_stats``.

    A column ``download_url`` of the runs adds a finding where it is not null or empty.
    """
    url = F.col("download_url") if "download_url" in runs.columns else F.lit(None).cast("string")
    rows = runs.where(F.col("status") == "complete").withColumn("_url", url)
    findings = F.array_compact(F.array(
        F.concat(F.lit("probabilities in "), _or("prob_zarr_path", "no file")),
        F.concat(F.lit("mask in "), _or("mask_zarr_path", "no file")),
        F.concat(F.lit("share of fault samples "), _fraction()),
        F.when(F.col("_url") != "", F.concat(F.lit("download from "), "_url"))))
    stats = F.struct(F.coalesce("fault_voxel_fraction", F.lit(0.0)).alias("fault_voxel_fraction"), "prob_zarr_path",
                     "mask_zarr_path", "completed_at")
    text = F.concat(
        F.lit("Run "), "run_id", F.lit(" scored "), _or("survey_id", "an unnamed survey"), F.lit(" and marked a share of "),
        _fraction(), F.lit(" of its samples as fault; finished "), _or(_iso("completed_at"), "at an unknown time"), F.lit("."))
    out = rows.select("run_id", F.col("survey_id").alias("dataset_id"), "status", text.alias("summary"),
                      findings.alias("key_findings"), "fault_voxel_fraction", stats.alias("qc_stats"))
    return out.withColumn("caveats", F.array(*map(F.lit, CAVEATS))) if caveats else out


def export_packages(statuses: DataFrame, runs: DataFrame, overlays: bool = True, fmt: str = "json") -> DataFrame:
    """Export entries of complete runs with the artifacts they hold."""
    results = run_results(runs).where(F.col("state") == "ok")
    state = statuses.select("run_id", F.col("status").alias("job_status"))
    at = F.coalesce("prob_zarr_path", F.concat(F.lit("results/interpretation/"), "run_id", F.lit("/")))
    sections = F.concat(F.lit("overlay of any inline of "), "run_id")
    artifacts = [
        F.concat(F.lit("probability: "), at),
        F.concat(F.lit("mask: "), _or("mask_zarr_path", "no file")),
        F.concat(F.lit("state: "), _or("job_status", "unknown"))]
    return results.join(state, "run_id").select(
        F.concat(F.lit("export-"), "run_id").alias("export_id"), "run_id", F.lit(fmt).alias("format"),
        "survey_id", "status", "fault_voxel_fraction",
        F.array(*artifacts, *([sections] if overlays else [])).alias("included_artifacts"),
        at.alias("package_path"), "completed_at")


def qc_reports(runs: DataFrame, recommendations: bool = True) -> DataFrame:
    """Report sections and the overall verdict of every run."""
    done = F.col("status") == "complete"
    failed = F.coalesce(F.length("error") > 0, F.lit(False))
    overall = F.when(done & ~failed, "pass").when(failed, "fail").otherwise("pending")
    section = lambda title, status, details: F.struct(
        F.lit(title).alias("title"), status.alias("status"), details.alias("details"))
    first = section("State", overall, F.concat(
        F.lit("Run "), "run_id", F.lit(" of "), _or("survey_id", "an unnamed survey"), F.lit(" is "), "status",
        F.when(failed, F.concat(F.lit(" after the error: "), "error")).otherwise("")))
    second = section("Results", F.lit("pass"), F.concat(
        F.lit("Probabilities in "), _or("prob_zarr_path", "no file"), F.lit(", mask in "), _or("mask_zarr_path", "no file"),
        F.lit(", share of fault samples "), _fraction(), F.lit(", finished "),
        _or(_iso("completed_at"), "at an unknown time")))
    out = runs.select(
        F.concat(F.lit("qc-report-"), "run_id").alias("report_id"), "run_id",
        F.col("survey_id").alias("dataset_id"),
        F.when(done, F.array(first, second)).otherwise(F.array(first)).alias("sections"),
        overall.alias("overall_status"),
        F.when(done, F.concat(F.lit("Lay the overlays of run "), "run_id", F.lit(" over its inlines and hold them against the well tops.")))
        .otherwise(F.concat(F.lit("Come back later: the run is "), "status", F.lit("."))).alias("recommended_action"),
        F.when(done, 100).when(failed, 0).otherwise(50).alias("progress"),
        F.concat(F.lit("run "), "status").alias("message"), F.array(*map(F.lit, CAVEATS)).alias("caveats"))
    return out if recommendations else out.drop("recommended_action")


# --- files -----------------------------------------------------------------------------------


def browse(objects: DataFrame, container: str, prefix: str = "") -> DataFrame:
    """One level below a prefix: folders once each, and files with their size."""
    held = objects.where(F.col("container") == container)
    if held.isEmpty():
        raise LookupError(f"unknown container {container!r}")
    rel = F.substr("path", F.lit(len(prefix) + 1))
    inside = held.where(F.startswith("path", F.lit(prefix)) & (F.length("path") > len(prefix))).select(
        "path", "size", F.substring_index(rel, "/", 1).alias("name"), F.contains(rel, F.lit("/")).alias("deeper"))
    level = inside.groupBy("name", "deeper").agg(F.max("size").alias("size"))
    return level.select(
        "name", F.concat(F.lit(prefix), "name", F.when(F.col("deeper"), "/").otherwise("")).alias("path"),
        F.when(F.col("deeper"), "folder").otherwise("file").alias("type"),
        F.when(~F.col("deeper"), F.col("size")).alias("size"))


def size_label(size: Column) -> Column:
    mb, kb = 1 << 20, 1 << 10
    one = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return (F.when(size > mb, F.concat(one(mb), F.lit(" MB"))).when(size > kb, F.concat(one(kb), F.lit(" KB")))
            .otherwise(F.concat(size.cast("string"), F.lit(" B"))))


def listing(items: DataFrame, text: str = "") -> DataFrame:
    """Items whose name holds the text, with a readable size."""
    rows = items.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else items
    return rows.select("type", "name", "path", F.when(F.col("type") == "folder", "—").otherwise(
        size_label(F.coalesce("size", F.lit(0)))).alias("size_label"))


def registry_lookup(registry: DataFrame, component: str, n: int = 5) -> DataFrame:
    """The largest files of a component."""
    return registry.where(F.lower("component") == component.lower()).select(
        "component", "survey", "file_path", "file_size_bytes",
        (F.col("file_size_bytes") / 1e9).alias("size_gb")).orderBy(
        F.desc("file_size_bytes"), "file_path").limit(n)


def survey_inventory(geometry: DataFrame) -> DataFrame:
    return geometry.select(
        F.col("survey_id").alias("survey_name"), "n_inlines", "n_crosslines", "n_samples", "inline_min",
        "inline_max", "crossline_min", "crossline_max").orderBy("survey_name")


def registry_like(registry: DataFrame, text: str) -> DataFrame:
    return registry.where(F.col("file_path").ilike(f"%{text}%")).orderBy("component", "file_path")


def verify_files(expected: DataFrame, actual: DataFrame, tolerance_percent: float = 5.0) -> DataFrame:
    """Presence and size check of (name, size) rows."""
    off = F.abs(F.col("actual_size") - F.col("expected_size")) / F.col("expected_size") * 100
    mark = (F.when(F.col("actual_size").isNull(), "MISSING").when(off < tolerance_percent, "OK")
            .otherwise(F.concat(F.lit("size off "), F.rint(off).cast("long").cast("string"), F.lit("%"))))
    return expected.select("name", F.col("size").alias("expected_size")).join(
        actual.select("name", F.col("size").alias("actual_size")), "name", "left").withColumn("mark", mark)


# --- messages --------------------------------------------------------------------------------


def dangling_calls(messages: DataFrame) -> DataFrame:
    """Calls of a thread's last calling assistant message that no later tool message answers."""
    asking = messages.where((F.col("role") == "assistant") & (F.size("tool_calls") > 0))
    last = asking.groupBy("thread_id").agg(F.max_by(F.struct("seq", "tool_calls"), "seq").alias("m"))
    calls = last.select("thread_id", F.col("m.seq").alias("seq"), F.explode("m.tool_calls.id").alias("call_id"))
    replies = messages.where((F.col("role") == "tool") & F.col("tool_call_id").isNotNull()).groupBy(
        "thread_id", F.col("tool_call_id").alias("call_id")).agg(F.max("seq").alias("replied"))
    return calls.join(replies, ["thread_id", "call_id"], "left").where(
        F.col("replied").isNull() | (F.col("replied") <= F.col("seq"))).select("thread_id", "call_id", "seq")


# Words that decide the intent of a message, in order of precedence.
INTENT_WORDS = {
    "status": ("status", "run", "preproc", "inference", "job"),
    "wells": ("well", "formation", "tops", "borehole", "15/9"),
    "interpret": ("analyze", "end-to-end", "workflow", "full analysis"),
}


def intent(content: Column) -> Column:
    low = F.lower(content)
    out = None
    for name, words in INTENT_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("default")


def intent_tally(messages: DataFrame) -> DataFrame:
    return messages.groupBy(intent(F.col("content")).alias("intent")).agg(F.count("*").alias("messages"))
