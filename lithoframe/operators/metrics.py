"""Comparing predicted and true fault voxels.

Both sides are sparse voxel sets (survey_id, il, xl, s); volumes are never made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut, sized
from lithoframe.functions.numeric import finite_or_null, ratio
from lithoframe.functions.scans import OrderedScan
from lithoframe.operators.geometry import SURVEY
from lithoframe.operators.raster import VOXEL, grow_runs, to_runs

# Swept thresholds, smoothing of training ratios, smallest acceptable IoU.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
SMOOTH = 1e-8
ACCEPT_IOU = 0.3


def confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn per survey. Both sets are laid together and merged per voxel in one shuffle."""
    both = pred.select(*VOXEL, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        truth.select(*VOXEL, F.lit(0).alias("p"), F.lit(1).alias("t")))
    merged = both.groupBy(*VOXEL).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return merged.groupBy("survey_id").agg(
        F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"),
        F.count_if((F.col("p") == 1) & (F.col("t") == 0)).alias("fp"),
        F.count_if((F.col("p") == 0) & (F.col("t") == 1)).alias("fn"))


def overlap_ratios(counts: DataFrame, smooth: float = 0.0) -> DataFrame:
    """IoU, Dice, precision and recall from summed counts.

    A zero denominator gives 0; ``smooth`` adds a constant to every denominator instead.
    """
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({
        "iou": ratio(tp, tp + fp + fn + smooth), "dice": ratio(2 * tp, 2 * tp + fp + fn + smooth),
        "precision": ratio(tp, tp + fp + smooth), "recall": ratio(tp, tp + fn + smooth)})


def binary_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Voxel-exact metrics; F1 equals Dice."""
    return overlap_ratios(confusion(pred, truth)).withColumn("f1", F.col("dice"))


def threshold_counts(scored: DataFrame, keys: list[str],
                     thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn per threshold from (keys, p, target); a prediction is p strictly above it.

    Values are tallied by how many thresholds they exceed, in one pass; the counts of each threshold
    are suffix sums over at most len(thresholds) + 1 tallies.
    """
    above = sum(((F.col("p") > t).cast("int") for t in thresholds), F.lit(0))
    tallies = scored.groupBy(*keys, above.alias("above")).agg(
        F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") != 1).alias("neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"))
                               for i, t in enumerate(thresholds)])).alias("g")
    spread = tallies.select(*keys, "above", "pos", "neg", grid).select(
        *keys, "above", "pos", "neg", "g.i", "g.threshold")
    hit = F.col("above") > F.col("i")
    tally = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return spread.groupBy(*keys, "threshold").agg(
        tally(hit, "pos").alias("tp"), tally(hit, "neg").alias("fp"), tally(~hit, "pos").alias("fn"))


def best_threshold(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics at the threshold of the largest IoU, the lowest such threshold on ties."""
    rated = overlap_ratios(counts, SMOOTH)
    cols = ["threshold", "tp", "fp", "fn", "iou", "dice", "precision", "recall"]
    return rated.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(F.col("iou"), -F.col("threshold"))).alias("b")).select(
        *keys, *[F.col(f"b.{c}").alias("best_threshold" if c == "threshold" else c) for c in cols])


def average_precision(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Area under best precision per distinct recall, summed from recall 0."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    curve = overlap_ratios(counts, SMOOTH).groupBy(*keys, unit("recall").alias("r")).agg(
        F.max(unit("precision")).alias("p"))
    prior = F.coalesce(F.lag("r").over(Window.partitionBy(*keys).orderBy("r")), F.lit(0.0))
    return curve.withColumn("gain", (F.col("r") - prior) * F.col("p")).groupBy(*keys).agg(
        F.least(F.lit(1.0), F.sum("gain")).alias("ap"))


def _both_ways(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each set beside its counterpart, tagged by side, so both directions run as one job."""
    tag = lambda df, side: df.select(F.lit(side).alias("side"), *VOXEL)
    own = tag(pred, "pred").unionByName(tag(truth, "truth")).distinct()
    other = tag(truth, "pred").unionByName(tag(pred, "truth"))
    return own, other


def tolerant_metrics(pred: DataFrame, truth: DataFrame, *radii: int) -> DataFrame:
    """Precision and recall that forgive offsets up to each radius; 0 for an empty set.

    Offsets are Chebyshev distances, so a larger dilation grows out of the smaller one. Sets meet
    cell by cell, as arrays of samples, and are always shuffled (see ``nearest_squared_distance``).
    """
    own, other = _both_ways(pred, truth)
    own, grown = to_runs(own, ("side",)), to_runs(other, ("side",))
    cell = ["side", "survey_id", "il", "xl"]
    reached, near = 0, []
    for r in sorted(radii):
        grown = grow_runs(grown, r - reached)
        reached = r
        own = own.join(grown.withColumnRenamed("s", f"_near_{r}").hint("merge"), cell, "left")
        near.append(F.sum(F.coalesce(F.size(F.array_intersect("s", f"_near_{r}")), F.lit(0))).alias(f"n_{r}"))
    counts = own.groupBy("survey_id", "side").agg(F.sum(F.size("s")).alias("n"), *near)
    shares = counts.select("survey_id", "side", *[(F.col(f"n_{r}") / F.col("n")).alias(f"share_{r}") for r in radii])
    pick = lambda side, r: F.coalesce(
        F.max(F.when(F.col("side") == side, F.col(f"share_{r}"))), F.lit(0.0))
    return shares.groupBy("survey_id").agg(*[
        pick(side, r).alias(f"{name}_{r}") for r in radii
        for side, name in (("pred", "precision"), ("truth", "recall"))])


# --- nearest voxel ---------------------------------------------------------------------------

_CELL_EDGES = (4, 8)
FEW_CELLS = 20_000  # cells of a level that are sent to every task; more are shuffled
_C = {"il": "ci", "xl": "cj", "s": "ck"}
_POINT = ["side", *VOXEL]
_SET = ["side", *SURVEY]


def _square_gap(edge: int, far: bool) -> Column:
    """Squared distance from a voxel to the nearest or farthest voxel of a cell."""
    total = F.lit(0).cast("long")
    for a, c in _C.items():
        lo = F.col(c) * edge
        hi = lo + (edge - 1)
        gap = (F.greatest(F.abs(F.col(a) - lo), F.abs(F.col(a) - hi)) if far
               else F.greatest(lo - F.col(a), F.col(a) - hi, F.lit(0))).cast("long")
        total = total + gap * gap
    return total


def _within_cells(queries: DataFrame, targets: DataFrame, edge: int) -> DataFrame:
    """Smallest squared distance to targets in the 27 cells around each query.

    Voxels are distinct, so a cell holds at most edge**3 targets whatever the data.
    """
    cells = targets.select(*_SET, *[F.col(a).alias(f"t_{a}") for a in _C],
                           *[F.floor(F.col(a) / edge).cast("int").alias(c) for a, c in _C.items()])
    around = queries.select(*_POINT)
    for a, c in _C.items():
        home = F.floor(F.col(a) / edge).cast("int")
        around = around.withColumn(c, F.explode(F.sequence(home - 1, home + 1)))
    d2 = F.lit(0).cast("long")
    for a in _C:
        gap = (F.col(a) - F.col(f"t_{a}")).cast("long")
        d2 = d2 + gap * gap
    return around.join(cells.hint("merge"), [*_SET, *_C.values()]).groupBy(*_POINT).agg(F.min(d2).alias("d2"))


def _by_descent(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Nearest targets of far-off queries: refine cells from coarse to single voxels.

    A cell is kept while its nearest corner may still beat the farthest corner of the best cell, so
    a query follows a few cells per level rather than all targets. The few cells of a coarse level go
    to every task, where a shuffle by cell would gather all queries in them.
    """
    reach = targets.unionByName(queries).agg(
        F.max(F.greatest(*[F.abs(a) for a in _C]))).first()[0]
    edge = 1 << max(1, int(reach).bit_length())  # at this edge a set has at most 8 cells

    def occupied(e: int) -> DataFrame:
        cell = [F.floor(F.col(a) / e).cast("int").alias(c) for a, c in _C.items()]
        return targets.select(*_SET, *cell).distinct()

    frontier = queries.join(sized(occupied(edge)), _SET)
    while edge > 1:
        edge //= 2
        cells = cut(occupied(edge))
        few = cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS
        children = cells.withColumns({
            f"p{c}": F.floor(F.col(c) / 2).cast("int") for c in _C.values()}).hint("broadcast" if few else "merge")
        parents = frontier.select(*_POINT, *[F.col(c).alias(f"p{c}") for c in _C.values()])
        ranged = parents.join(children, [*_SET, *[f"p{c}" for c in _C.values()]]).select(
            *_POINT, *_C.values(), _square_gap(edge, far=False).alias("near"),
            _square_gap(edge, far=True).alias("far"))
        best = F.min("far").over(Window.partitionBy(*_POINT))
        frontier = cut(ranged.withColumn("best", best).where(F.col("near") <= F.col("best")).drop("best"))
    return frontier.groupBy(*_POINT).agg(F.min("near").alias("d2"))


def nearest_squared_distance(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact squared Euclidean distance of each voxel to the nearest target voxel of its side.

    Voxels near a target are settled in small cells; the few left over descend a cell hierarchy.
    Voxels of a side without targets give no rows. Written voxels take a fraction of a byte to a few
    bytes each, a hundred in a broadcast table, so the size of their files must not decide: they are
    always shuffled.
    """
    targets = cut(targets.select(*_POINT).distinct())
    hit = points.select(*_POINT).distinct().join(
        targets.withColumn("d2", F.lit(0).cast("long")).hint("merge"), _POINT, "left")
    hit = cut(hit.join(sized(targets.select(*_SET).distinct()), _SET, "left_semi"))
    done = [hit.where(F.col("d2") == 0)]
    left = hit.where(F.col("d2").isNull()).select(*_POINT)
    for edge in _CELL_EDGES:
        if left.isEmpty():
            break
        found = cut(left.join(_within_cells(left, targets, edge).hint("merge"), _POINT, "left"))
        settled = F.coalesce(F.col("d2") <= edge * edge, F.lit(False))
        done.append(found.where(settled))
        left = found.where(~settled).select(*_POINT)
    if not left.isEmpty():
        done.append(_by_descent(left, targets))
    out = done[0].select(*_POINT, "d2")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def surface_distance(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Average symmetric surface distance in voxels; infinite where one set is empty."""
    own, other = _both_ways(pred, truth)
    means = nearest_squared_distance(own, other).groupBy(*_SET).agg(F.avg(F.sqrt("d2")).alias("mean"))
    both = means.groupBy("survey_id").agg((F.sum("mean") / 2).alias("assd"))
    surveys = own.select("survey_id").distinct()
    return surveys.join(both, SURVEY, "left").select(
        "survey_id", F.coalesce("assd", F.lit(float("inf"))).alias("assd"))


def evaluation_row(pred: DataFrame, truth: DataFrame, shapes: DataFrame) -> DataFrame:
    """All metrics of a survey in one row. Continuity and throw are not measured and stay 0."""
    pred, truth = cut(pred.select(*VOXEL).distinct()), cut(truth.select(*VOXEL).distinct())
    row = shapes.select("survey_id", "n_inlines", "n_crosslines", "n_samples")
    for part in (binary_metrics(pred, truth), tolerant_metrics(pred, truth, 3, 5),
                 surface_distance(pred, truth)):
        row = row.join(part, SURVEY, "left")
    tolerant = [f"{m}_{n}" for n in (3, 5) for m in ("precision", "recall")]
    zero = ["tp", "fp", "fn", "iou", "dice", "precision", "recall", "f1", *tolerant]
    return (row.fillna(0, zero).withColumn("assd", F.coalesce("assd", F.lit(float("inf"))))
            .withColumns({"predicted_voxels": F.col("tp") + F.col("fp"),
                          "truth_voxels": F.col("tp") + F.col("fn"),
                          "fault_continuity": F.lit(0.0), "throw_error": F.lit(0.0)}))


def for_json(row: DataFrame) -> DataFrame:
    """The row with non-finite distances as null."""
    return row.withColumn("assd", finite_or_null(F.col("assd")))


def acceptance(iou: Column) -> Column:
    return F.when(iou > ACCEPT_IOU, "PASS").otherwise("WARN")


# --- training history ------------------------------------------------------------------------

def epoch_rollup(batches: DataFrame) -> DataFrame:
    """Batches to epochs: mean loss, summed counts, ratios taken once from the sums."""
    sums = batches.groupBy("run_id", "epoch", "phase").agg(
        F.avg("loss").alias("loss"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return overlap_ratios(sums, SMOOTH)


def saved_epochs(epochs: DataFrame) -> DataFrame:
    """Epochs that would have been saved, and why.

    An epoch is saved when its IoU beats all earlier ones (and 0), or when it at least equals them
    and its loss is below every earlier loss.
    """
    scan = OrderedScan.on_any_order(epochs, ["run_id"], ["epoch"])
    scan.running({"top": ("max", F.col("iou")), "low": ("min", F.col("loss"))}, through=-1)
    top = F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0))
    low = F.coalesce("low", F.lit(float("inf")))
    reason = F.when(F.col("iou") > top, "iou").when((F.col("iou") >= top) & (F.col("loss") < low), "loss")
    return scan.result().withColumn("selected_by", reason).where(F.col("selected_by").isNotNull()).select(
        "run_id", "epoch", "iou", "loss", "selected_by")


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The last saved epoch of each run."""
    return saved_epochs(epochs).groupBy("run_id").agg(
        F.max_by(F.struct("epoch", "iou", "loss", "selected_by"), "epoch").alias("b")).select("run_id", "b.*")
