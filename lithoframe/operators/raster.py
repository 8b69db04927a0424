"""Polylines to voxel masks: densify, resample along arc length, paint, dilate.

A mask is (survey_id, il, xl, s) with one row per set voxel, in index space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut, sized
from lithoframe.functions.numeric import half_even
from lithoframe.functions.scans import OrderedScan
from lithoframe.operators.geometry import SURVEY, grid_cells, world_to_grid

STICK = ["survey_id", "stick_id"]
VOXEL = ["survey_id", "il", "xl", "s"]
AXES = {"il": "n_inlines", "xl": "n_crosslines", "s": "n_samples"}

# Widest inline gap that is bridged, samples per voxel along a stick, shortest stick, decimals of a resampled position.
MAX_INLINE_GAP = 5
SAMPLES_PER_VOXEL = 2.0
MIN_LENGTH = 1e-9
DECIMALS = 9


def _toward(c: str, t: Column) -> Column:
    return F.col(c) + t * (F.col("nxt")[c] - F.col(c))


def densify(picks: DataFrame, order: list[str], max_gap: float = MAX_INLINE_GAP) -> DataFrame:
    """Sort each stick by inline and bridge gaps of more than one and at most max_gap inlines.

    Returns the points with a ``step`` column; their order is (il, *order, step).
    """
    scan = OrderedScan.on_any_order(picks, STICK, ["il", *order])
    points = scan.next_row("nxt", ["il", "xl", "s"]).result()
    gap = F.col("nxt.il") - F.col("il")
    pieces = F.when((gap > 1) & (gap <= max_gap), F.rint(gap).cast("int")).otherwise(1)
    t = F.col("step") / F.col("pieces")
    moved = lambda c: F.when(F.col("step") > 0, _toward(c, t)).otherwise(F.col(c))
    return (points.withColumn("pieces", pieces)
            .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select(*STICK, moved("il").alias("il"), moved("xl").alias("xl"), moved("s").alias("s"),
                    *order, "step"))


def resample(points: DataFrame, order: list[str]) -> DataFrame:
    """Evenly spaced positions along each polyline, about two per voxel of length.

    Which positions fall on a segment follows from its arc interval by arithmetic, so no position is
    ever matched against segments by a join.
    """
    scan = OrderedScan.on_any_order(points, STICK, order)
    scan.next_row("nxt", ["il", "xl", "s"])
    square = lambda c: F.pow(F.col("nxt")[c] - F.col(c), F.lit(2.0))
    scan.apply(lambda df: df.withColumn("seg", F.sqrt(square("il") + square("xl") + square("s"))))
    # the end of a segment is the very number its successor starts from, so no position is lost
    df = scan.stretches(F.col("seg"), "a0", "a1", "total", "nth", "n").result()
    count = F.greatest((F.col("total") * SAMPLES_PER_VOXEL).cast("int"), F.col("n").cast("int"))
    long_enough = F.col("total") >= MIN_LENGTH
    df = df.withColumns({"n_q": F.when(long_enough, count),
                         "gap": F.when(long_enough, F.col("total") / (count - 1))})
    first_k = lambda a: F.ceil(a / F.col("gap")).cast("int")
    stop = F.when(F.col("a1") >= F.col("total"), F.col("n_q")).otherwise(
        F.least(first_k(F.col("a1")), F.col("n_q")))
    start = first_k(F.col("a0"))
    along = F.when((F.col("a1") > F.col("a0")) & (stop > start), F.sequence(start, stop - 1))
    only = F.when((F.col("nth") == 0) & (F.col("total") < MIN_LENGTH), F.array(F.lit(0)))
    spread = df.withColumn("k", F.explode(F.coalesce(along, only)))
    pos = F.when(F.col("k") == F.col("n_q") - 1, F.col("total")).otherwise(F.col("k") * F.col("gap"))
    t = F.coalesce((pos - F.col("a0")) / (F.col("a1") - F.col("a0")), F.lit(0.0))
    moved = lambda c: F.when(long_enough, _toward(c, t)).otherwise(F.col(c))
    return spread.select(*STICK, "k", *[moved(c).alias(c) for c in ("il", "xl", "s")])


def to_runs(voxels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The distinct samples of each (il, xl) cell as one array, no longer than the time axis."""
    return voxels.groupBy(*keys, "survey_id", "il", "xl").agg(F.collect_set("s").alias("s"))


def grow_runs(runs: DataFrame, radius: int, axes: tuple[str, ...] = ("il", "xl", "s")) -> DataFrame:
    """Grow cells of samples by a cube, one axis at a time, merging between axes.

    Rows are cells, not voxels, and grow by (2 radius + 1) per pass, never by its cube.
    """
    if radius == 0:
        return runs
    cell = [c for c in runs.columns if c != "s"]
    around = lambda c: F.sequence(c - radius, c + radius)
    if "s" in axes:
        runs = runs.withColumn("s", F.array_distinct(F.flatten(F.transform("s", around))))
    for axis in ("il", "xl"):
        if axis in axes:
            rest = [c for c in runs.columns if c != axis]
            runs = runs.select(*rest, F.explode(around(F.col(axis))).alias(axis)).groupBy(*cell).agg(
                F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    return runs


def from_runs(runs: DataFrame) -> DataFrame:
    keys = [c for c in runs.columns if c != "s"]
    return runs.select(*keys, F.explode("s").alias("s"))


def dilate(voxels: DataFrame, radius: int, axes: tuple[str, ...] = ("il", "xl", "s")) -> DataFrame:
    """A voxel set grown by a cube of the given half-width."""
    return from_runs(grow_runs(to_runs(voxels), radius, axes)).select(*VOXEL)


def clip_to(voxels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Keep voxels inside the volume of their survey."""
    inside = F.lit(True)
    for axis, n in AXES.items():
        inside = inside & (F.col(axis) >= 0) & (F.col(axis) < F.col(n))
    s = sized(shapes).select("survey_id", *AXES.values())
    return voxels.join(s, SURVEY).where(inside).select(*voxels.columns)


def paint(positions: DataFrame, shapes: DataFrame, dilation: int = 1) -> DataFrame:
    """Round positions half to even, grow each by the dilation cube, clip to the volume."""
    centres = positions.select("survey_id", *[half_even(F.col(c)).alias(c) for c in AXES])
    return clip_to(dilate(centres, dilation), shapes)


def rasterise_index_sticks(picks: DataFrame, order: list[str], shapes: DataFrame, dilation: int = 1,
                           max_gap: float | None = None) -> DataFrame:
    """Sticks in index space to a mask, bridging inline gaps first when ``max_gap`` is given.

    Lengths along a stick are sums whose last digits depend on their order. Positions are taken to nine decimals, so that one
    halfway between voxels is halfway however they were summed.
    """
    if max_gap is not None:
        picks, order = cut(densify(picks, order, max_gap)), ["il", *order, "step"]
    at = resample(picks, order)
    return paint(at.withColumns({c: F.round(c, DECIMALS) for c in AXES}), shapes, dilation)


def rasterise_world_sticks(sticks: DataFrame, order: list[str], transform: DataFrame,
                           geometry: DataFrame, dilation: int = 1) -> DataFrame:
    """Sticks in metres and milliseconds to a mask through the survey transform."""
    placed = world_to_grid(sticks, transform)
    geometry = sized(geometry)
    g = geometry.select("survey_id", "inline_min", "inline_step", "crossline_min", "crossline_step")
    index = cut(placed.join(g, SURVEY).select(
        *STICK, *order,
        ((F.col("il") - F.col("inline_min")) / F.col("inline_step")).alias("il"),
        ((F.col("xl") - F.col("crossline_min")) / F.col("crossline_step")).alias("xl"), "s"))
    return rasterise_index_sticks(index, order, geometry, dilation)


def paint_points(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Direct paint: each (inline, crossline, twt) point marks a 3 x 3 patch of its time sample.

    ``bounds`` is (survey_id, inline_min, inline_max, crossline_min, crossline_max, twt_min,
    sample_rate_ms, n_inlines, n_crosslines, n_samples). No interpolation and no growth in time.
    """
    b = sized(bounds)
    step = lambda axis: F.greatest(F.lit(1.0), (F.col(f"{axis}_max") - F.col(f"{axis}_min"))
                                   / F.greatest(F.lit(1), F.col(f"n_{axis}s") - 1))
    at = lambda axis: half_even((F.col(axis) - F.col(f"{axis}_min")) / step(axis))
    centres = points.join(b, SURVEY).select(
        "survey_id", at("inline").alias("il"), at("crossline").alias("xl"),
        half_even((F.col("twt") - F.col("twt_min")) / F.col("sample_rate_ms")).alias("s"))
    return clip_to(dilate(centres, 1, axes=("il", "xl")), bounds)


def dense_mask(mask: DataFrame, shapes: DataFrame) -> DataFrame:
    """A 0/1 byte array per trace of the full index grid: zeros between the sorted positions that are set."""
    runs = mask.groupBy("survey_id", "il", "xl").agg(F.sort_array(F.collect_set("s")).alias("on"))
    axis = lambda n: [F.lit(0).alias(f"{n}_min"), (F.col(f"n_{n}s") - 1).alias(f"{n}_max"),
                      F.lit(1).alias(f"{n}_step")]
    cells = grid_cells(shapes.select("survey_id", *axis("inline"), *axis("crossline"))).select(
        "survey_id", F.col("inline").alias("il"), F.col("crossline").alias("xl"))
    sized_shapes = sized(shapes).select("survey_id", "n_samples")
    full = cells.join(runs, ["survey_id", "il", "xl"], "left").join(sized_shapes, SURVEY)
    none = F.array().cast("array<int>")
    on = F.filter(F.coalesce("on", none), lambda i: (i >= 0) & (i < F.col("n_samples")))
    byte = lambda v, n: F.array_repeat(F.lit(v).cast("tinyint"), n.cast("int"))
    # each position brings the zeros after the one before it
    filled = F.flatten(F.transform(on, lambda i, k: F.concat(
        byte(0, i - F.when(k > 0, F.get(on, k - 1)).otherwise(-1) - 1), byte(1, F.lit(1)))))
    rest = byte(0, F.col("n_samples") - 1 - F.coalesce(F.array_max(on), F.lit(-1)))
    return full.select("survey_id", "il", "xl", F.concat(filled, rest).alias("mask"))


def grid_mismatch(labels: DataFrame, traces: DataFrame) -> DataFrame:
    """Cells present on one side only; empty when the two grids agree."""
    cell = ["survey_id", "inline", "crossline"]
    left, right = labels.select(*cell).distinct(), traces.select(*cell).distinct()
    return (left.join(right, cell, "left_anti").withColumn("only_in", F.lit("labels"))
            .unionByName(right.join(left, cell, "left_anti").withColumn("only_in", F.lit("traces"))))
