"""Patch grids, splits, label balance, extraction and sampling.

Volumes are addressed in index space: (survey_id, il, xl) rows with ``samples``. A patch is named by
its start (il0, xl0, s0).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.functions.lineage import cut, sized
from lithoframe.functions.numeric import floor_div
from lithoframe.functions.scans import OrderedScan
from lithoframe.operators.geometry import SURVEY

PATCH = ["survey_id", "il0", "xl0", "s0"]
AXES = (("il", "n_inlines"), ("xl", "n_crosslines"), ("s", "n_samples"))
Size = tuple[int, int, int]

# Split shares, weight of a patch with faults, draws per epoch, guard against flat patches.
SPLIT_SHARES = (0.70, 0.15, 0.15)
VOLUME_ENDS = (0.7, 0.85)
FAULT_WEIGHT = 50.0
DRAWS = 200
FLAT = 1e-8


def to_index_space(traces: DataFrame, geometry: DataFrame) -> DataFrame:
    """(survey_id, il, xl, samples) with 0-based positions on the grid."""
    g = sized(geometry).select("survey_id", "inline_min", "inline_step", "crossline_min", "crossline_step")
    at = lambda axis: floor_div(F.col(axis) - F.col(f"{axis}_min"), F.col(f"{axis}_step"))
    return traces.join(g, SURVEY).select(
        "survey_id", at("inline").alias("il"), at("crossline").alias("xl"), "samples")


def starts(n: Column, p: int, stride: int, tail: bool = False) -> Column:
    """Window starts along an axis; ``tail`` adds a last window where the end is left uncovered."""
    regular = F.when(n >= p, F.sequence(F.lit(0), (n - p).cast("int"), F.lit(stride))).otherwise(
        F.array().cast("array<int>"))
    return F.array_union(regular, F.array((n - p).cast("int"))) if tail else regular


def covering(i: Column, n: Column, p: int, stride: int, tail: bool = False) -> Column:
    """Starts of the windows that contain position i, by arithmetic."""
    first = F.greatest(F.lit(0), F.ceil((i - (p - 1)) / stride)).cast("int")
    last = F.least(F.floor(i / stride), F.floor((n - p) / stride)).cast("int")
    regular = F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(
        F.array().cast("array<int>"))
    if not tail:
        return regular
    end = (n - p).cast("int")
    return F.when((i >= end) & (end % stride != 0), F.concat(regular, F.array(end))).otherwise(regular)


def overlap_stride(patch: Size, overlap: float) -> Size:
    if not 0.0 <= overlap < 1.0:
        raise ValueError("overlap must be in [0, 1)")
    return tuple(max(1, int(p * (1.0 - overlap))) for p in patch)


def clamp_patch(patch: Size, shape: Size) -> Size:
    """A patch no larger than the volume."""
    return tuple(min(p, n) for p, n in zip(patch, shape))


def _windows(shapes: DataFrame, patch: Size, stride: Size, tail: bool) -> DataFrame:
    """All window starts; inline starts are spread over tasks before the other axes are listed."""
    rows = shapes.select("survey_id", *[n for _, n in AXES],
                         F.explode(starts(F.col("n_inlines"), patch[0], stride[0], tail)).alias("il0"))
    rows = rows.repartition("survey_id", "il0")
    for (axis, n), p, st in list(zip(AXES, patch, stride))[1:]:
        rows = rows.withColumn(f"{axis}0", F.explode(starts(F.col(n), p, st, tail)))
    return rows


def patch_index(shapes: DataFrame, patch: Size, stride: Size | None = None,
                shares: tuple[float, float, float] = SPLIT_SHARES) -> DataFrame:
    """Training patches with their split; the split follows the inline centre of the patch."""
    if abs(sum(shares) - 1.0) > 1e-6:
        raise ValueError("split shares must sum to 1")
    fits = F.lit(True)
    for (_, n), p in zip(AXES, patch):
        fits = fits & (F.col(n) >= p)
    checked = shapes.withColumn("n_samples", F.when(fits, F.col("n_samples")).otherwise(
        F.raise_error("patch is larger than the volume").cast("int")))
    rows = _windows(checked, patch, stride or patch, tail=False)
    return rows.select(*PATCH, inline_split(F.col("il0") + patch[0] // 2, F.col("n_inlines"), shares)
                       .alias("split"))


def inline_split(position: Column, n: Column, shares: tuple[float, float, float] = SPLIT_SHARES) -> Column:
    """train, val or test by position along the inline axis."""
    train_end = (n * F.lit(shares[0])).cast("int")
    val_end = train_end + (n * F.lit(shares[1])).cast("int")
    return F.when(position < train_end, "train").when(position < val_end, "val").otherwise("test")


def split_volume(volume: DataFrame, shapes: DataFrame) -> DataFrame:
    """Contiguous inline split of whole traces, before any patching: train to 70 % of the lines, val to 85 %."""
    n, il = sized(shapes).select("survey_id", "n_inlines"), F.col("il")
    end = lambda share: (F.col("n_inlines") * share).cast("int")
    return volume.join(n, SURVEY).withColumn("split", F.when(il < end(VOLUME_ENDS[0]), "train").when(
        il < end(VOLUME_ENDS[1]), "val").otherwise("test")).drop("n_inlines")


def fault_counts(mask: DataFrame, shapes: DataFrame, patch: Size, stride: Size | None = None) -> DataFrame:
    """Fault voxels per patch, for patches that hold any."""
    rows = mask.join(sized(shapes).select("survey_id", *[n for _, n in AXES]), SURVEY)
    for (axis, n), p, st in zip(AXES, patch, stride or patch):
        rows = rows.withColumn(f"{axis}0", F.explode(covering(F.col(axis), F.col(n), p, st)))
    return rows.groupBy(*PATCH).agg(F.count("*").alias("fault_voxels"))


def with_fault_counts(index: DataFrame, mask: DataFrame, shapes: DataFrame, patch: Size,
                      stride: Size | None = None) -> DataFrame:
    counts = fault_counts(mask, shapes, patch, stride)
    return index.join(counts, PATCH, "left").fillna(0, ["fault_voxels"])


def keep_faulted(counted: DataFrame, patch: Size, min_fraction: float) -> DataFrame:
    """Drop patches whose fault share is below the minimum; 0 keeps all."""
    if min_fraction <= 0:
        return counted
    return counted.where(F.col("fault_voxels") / float(np.prod(patch)) >= min_fraction)


def cut_patches(volume: DataFrame, shapes: DataFrame, patch: Size, stride: Size | None = None,
                tail: bool = False, label: str | None = None,
                transform: Callable[[Column], Column] | None = None,
                label_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Patch tensors as flat arrays in (il, xl, s) order.

    Each trace sends the slices that its covering windows need; a patch gathers at most
    patch[0] * patch[1] of them, and has zeros where a trace is missing. ``label`` names a 0/1 array column beside ``samples``; without one
    the labels are zeros. The hooks are applied to finished patches.
    """
    stride = stride or patch
    rows = volume.join(sized(shapes).select("survey_id", *[n for _, n in AXES]), SURVEY)
    for i, axis in enumerate(("il", "xl")):
        n = F.col(AXES[i][1])
        rows = rows.withColumn(f"{axis}0", F.explode(covering(F.col(axis), n, patch[i], stride[i], tail)))
    rows = rows.withColumn("s0", F.explode(starts(F.col("n_samples"), patch[2], stride[2], tail)))
    piece = [F.slice("samples", F.col("s0") + 1, F.lit(patch[2])).alias("x")]
    if label is not None:
        piece.append(F.slice(F.col(label), F.col("s0") + 1, F.lit(patch[2])).alias("y"))
    parts = rows.groupBy(*PATCH).agg(F.sort_array(F.collect_list(F.struct("il", "xl", *piece))).alias("p"))
    full = F.size("p") == patch[0] * patch[1]
    place = lambda q: (q["il"] - F.col("il0")) * patch[1] + q["xl"] - F.col("xl0")

    def gathered(field: str, kind: str) -> Column:
        held = F.map_from_entries(F.transform("p", lambda q: F.struct(place(q), q[field])))
        none = F.array_repeat(F.lit(0).cast(kind), patch[2])
        filled = F.transform(F.sequence(F.lit(0), F.lit(patch[0] * patch[1] - 1)),
                             lambda k: F.coalesce(F.try_element_at(held, k), none))
        return F.flatten(F.when(full, F.col(f"p.{field}")).otherwise(filled))

    kind_of = lambda c: volume.schema[c].dataType.elementType.simpleString()
    x = gathered("x", kind_of("samples"))
    y = gathered("y", kind_of(label)) if label is not None else F.array_repeat(
        F.lit(0).cast("tinyint"), int(np.prod(patch)))
    same = lambda c: c
    return parts.select(*PATCH, (transform or same)(x).alias("patch"), (label_transform or same)(y).alias("label"))


def _standardised(patches: pd.Series, rule: Callable[..., np.ndarray]) -> pd.Series:
    """The rule on all patches of a batch at once; patches of one length are stacked."""
    out = pd.Series([None] * len(patches), dtype=object)
    lengths = patches.map(len).to_numpy() if len(patches) else np.empty(0, int)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.stack(patches.to_numpy()[at]).astype("f8")
        made = rule(x, x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)) if n else x
        for i, row in zip(at, made.astype("f4")):
            out.iat[i] = row
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def zscore(patch: pd.Series) -> pd.Series:
    """(x - mean) / (population std + 1e-8) of each patch."""
    return _standardised(patch, lambda x, mean, std: (x - mean) / (std + FLAT))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def zscore_unless_flat(patch: pd.Series) -> pd.Series:
    """(x - mean) / population std, but a flat patch stays as it is."""
    return _standardised(patch, lambda x, mean, std: np.where(std > FLAT, (x - mean) / np.where(std > FLAT, std, 1), x))


def fault_weights(counted: DataFrame, weight: float = FAULT_WEIGHT) -> DataFrame:
    """Sampling weight of each patch: high with any fault voxel, else 1."""
    return counted.withColumn("weight", F.when(F.col("fault_voxels") > 0, F.lit(weight)).otherwise(F.lit(1.0)))


def sample_weighted(weighted: DataFrame, k: int = DRAWS, seed: int = 0) -> DataFrame:
    """min(k, patches) draws with replacement per survey, in proportion to weight.

    Patches in their order cover a line by their weights, and a draw is the point on it that md5 of
    ``seed|survey|draw`` gives. At most k points of a survey meet each of its patches.
    """
    order = ["il0", "xl0", "s0"]
    placed = cut(OrderedScan.on_any_order(weighted.select(*PATCH, "weight"), SURVEY, order).running(
        {"end": ("sum", F.col("weight"))}).result())
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "survey_id", F.col("draw").cast("string"))), 1, 12), 16, 10)
    draws = (placed.groupBy("survey_id").agg(F.max("end").alias("total"), F.count("*").alias("n"))
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")).cast("int") - 1)))
             .withColumn("at", number.cast("double") / float(1 << 48) * F.col("total")))
    points = sized(draws.groupBy("survey_id").agg(F.collect_list(F.struct("draw", "at")).alias("points")))
    inside = F.filter("points", lambda p: (p["at"] >= F.col("end") - F.col("weight")) & (p["at"] < F.col("end")))
    return placed.join(points, SURVEY).withColumn("point", F.explode(inside)).select("point.draw", *PATCH, "weight")


def split_counts(counted: DataFrame) -> DataFrame:
    """Patches and patches with faults per split."""
    return counted.groupBy("survey_id", "split").agg(
        F.count("*").alias("patches"), F.count_if(F.col("fault_voxels") > 0).alias("fault_patches"))
