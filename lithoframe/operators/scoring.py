"""Scoring a volume with a pluggable model in overlapping windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.arrays import blank, total
from lithoframe.functions.lineage import sized
from lithoframe.operators.geometry import SURVEY
from lithoframe.operators.patches import FLAT, PATCH, Size, covering, cut_patches, overlap_stride

Predict = Callable[[np.ndarray], np.ndarray]

# Default overlap, batch size, threshold.
OVERLAP = 0.25
BATCH = 8
THRESHOLD = 0.5
LINE_BLOCK = 64  # traces blended together in one group


def amplitude_logits(batch: np.ndarray) -> np.ndarray:
    """The built-in scorer: the normalised amplitude itself is the logit."""
    return batch


def gaussian_weights(patch: Size, sigma: float | None = None) -> list[np.ndarray]:
    """One weight vector per axis; their product is the window weight, 1 at its largest."""
    sigma = min(patch) / 4.0 if sigma is None else sigma
    out = []
    for n in patch:
        offset = np.arange(n) - (n - 1) / 2.0
        w = np.exp(-0.5 * (offset / sigma) ** 2)
        out.append(w / w.max())
    return out


def uniform_weights(patch: Size) -> list[np.ndarray]:
    return [np.ones(n) for n in patch]


def window_weight(volume: DataFrame, shapes: DataFrame, patch: Size, overlap: float = OVERLAP) -> DataFrame:
    """Total window weight at every sample of each trace, the divisor of the blend.

    The kernel is separable and so is the window grid, so the total is a product of three sums.
    """
    stride = overlap_stride(patch, overlap)
    dims = sized(shapes).select("survey_id", "n_inlines", "n_crosslines", "n_samples")

    def along(i: Column, n: str, axis: int) -> Column:
        kernel = F.array(*[F.lit(float(w)) for w in gaussian_weights(patch)[axis]])
        return total(F.transform(covering(i, F.col(n), patch[axis], stride[axis], tail=True),
                                 lambda start: F.get(kernel, (i - start).cast("int"))))

    rows = volume.join(dims, SURVEY).select(
        "survey_id", "il", "xl", "n_samples",
        (along(F.col("il"), "n_inlines", 0) * along(F.col("xl"), "n_crosslines", 1)).alias("plane"))
    return rows.select("survey_id", "il", "xl", F.transform(
        F.sequence(F.lit(0), F.col("n_samples") - 1),
        lambda s: F.col("plane") * along(s, "n_samples", 2)).alias("weight"))


def _probabilities(patches: np.ndarray, patch: Size, predict: Predict, batch: int, normalise: bool = True) -> np.ndarray:
    x = patches.reshape(-1, *patch).astype("f8")
    if normalise:
        axes = (1, 2, 3)
        x = (x - x.mean(axis=axes, keepdims=True)) / (x.std(axis=axes, keepdims=True) + FLAT)
    logits = [predict(x[i:i + batch]) for i in range(0, len(x), batch)]
    return 1.0 / (1.0 + np.exp(-np.concatenate(logits)))


def score_patches(patches: DataFrame, patch: Size, predict: Predict = amplitude_logits,
                  batch: int = BATCH, normalise: bool = True) -> DataFrame:
    """Probabilities of each patch, flat in the same order as the patch; ``normalise`` z-scores patches first."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            probs = _probabilities(np.stack(f["patch"]), patch, predict, batch, normalise)
            yield f[PATCH].assign(prob=list(probs.reshape(len(f), -1).astype("f4")))

    return patches.select(*PATCH, "patch").mapInPandas(
        run, "survey_id string, il0 int, xl0 int, s0 int, prob array<float>")


def score_volume(volume: DataFrame, shapes: DataFrame, patch: Size, predict: Predict = amplitude_logits,
                 overlap: float = OVERLAP, batch: int = BATCH, uniform: bool = False) -> DataFrame:
    """Blend overlapping window scores to one probability array per trace.

    A scored window is cut back into trace slices at once; groups of neighbouring traces then add
    the weighted slices, so no group holds more than a strip of one inline. ``uniform`` weighs all
    positions alike, feeds patches as they are and leaves out the extra windows at the far edges; positions no
    window covers get 0.
    """
    windows = cut_patches(volume, shapes, patch, overlap_stride(patch, overlap), tail=not uniform)
    wi, wx, ws = uniform_weights(patch) if uniform else gaussian_weights(patch)
    d, h, w = patch

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        di, dx = (a.ravel() for a in np.mgrid[0:d, 0:h])
        for f in frames:
            probs = _probabilities(np.stack(f["patch"]), patch, predict, batch, not uniform).reshape(-1, w)
            n = len(f)
            yield pd.DataFrame({
                "survey_id": np.repeat(f["survey_id"].to_numpy(), d * h),
                "il": (f["il0"].to_numpy()[:, None] + di).ravel(),
                "xl": (f["xl0"].to_numpy()[:, None] + dx).ravel(),
                "s0": np.repeat(f["s0"].to_numpy(), d * h),
                "weight": np.tile(wi[di] * wx[dx], n),
                "prob": list(probs)})

    def blend(key, f):
        survey, il, _ = key
        xls, row = np.unique(f["xl"].to_numpy(), return_inverse=True)
        num = np.zeros((len(xls), int(f["n_samples"].iloc[0])))
        den = np.zeros_like(num)
        for s0, part in f.groupby("s0").indices.items():
            at = (row[part][:, None], s0 + np.arange(w))
            weight = f["weight"].to_numpy()[part][:, None] * ws
            np.add.at(num, at, np.stack(f["prob"].to_numpy()[part]) * weight)
            np.add.at(den, at, weight)
        prob = np.divide(num, den, out=np.zeros_like(num), where=den > 0)
        return pd.DataFrame({"survey_id": survey, "il": il, "xl": xls, "prob": list(prob.astype("f4"))})

    scored = windows.select(*PATCH, "patch").mapInPandas(
        slices, "survey_id string, il int, xl int, s0 int, weight double, prob array<double>")
    n_s = sized(shapes).select("survey_id", "n_samples")
    strip = F.floor(F.col("xl") / LINE_BLOCK).alias("strip")
    blended = scored.join(n_s, SURVEY).groupBy("survey_id", "il", strip).applyInPandas(
        blend, "survey_id string, il int, xl int, prob array<float>")
    if not uniform:
        return blended
    # traces outside every window are found by arithmetic, not by comparing with the result
    sizes = sized(shapes).select("survey_id", "n_inlines", "n_crosslines", "n_samples")
    missed = F.lit(False)
    for i, (axis, n) in enumerate((("il", "n_inlines"), ("xl", "n_crosslines"))):
        missed = missed | (F.size(covering(F.col(axis), F.col(n), patch[i], overlap_stride(patch, overlap)[i])) == 0)
    return blended.unionByName(volume.join(sizes, SURVEY).where(missed).select(
        "survey_id", "il", "xl", blank(F.col("n_samples")).alias("prob")))


def threshold_mask(probs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Sparse mask of the samples at or above the threshold."""
    return probs.select("survey_id", "il", "xl", F.posexplode("prob").alias("s", "p")).where(
        F.col("p") >= threshold).select("survey_id", "il", "xl", "s")
