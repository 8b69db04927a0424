"""Distribution summaries and exact percentiles of float32 values at any size.

One pass counts values into logarithmic buckets (1024 per octave), so a key yields a bounded
histogram whatever its row count; the partial counts are combined before the shuffle. A second pass
looks only inside the few buckets that hold a wanted rank and counts distinct values there, again a
bounded number for float32 input. No value list is ever gathered.

Infinities and NaN have buckets of their own. As in NumPy, one NaN makes every statistic of its key NaN but the
counts; an infinity takes part like any value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized, cut

PER_OCTAVE = 1024
_SHIFT = 1100 * PER_OCTAVE  # keeps bucket numbers of tiny magnitudes positive
_INF, _NAN = 1 << 40, 1 << 41  # beyond every finite bucket


def log_bucket(v: Column) -> Column:
    """A monotone integer label of a value: equal labels mean nearly equal values."""
    big = float("inf")
    long = lambda n: F.lit(n).cast("long")
    size = F.floor(F.log2(F.when(F.isnan(v) | (F.abs(v) == big), 1.0).otherwise(F.abs(v))) * PER_OCTAVE) + _SHIFT
    return (F.when(F.isnan(v), long(_NAN)).when(v == big, long(_INF)).when(v == -big, long(-_INF))
            .when(v == 0, long(0)).when(v > 0, size).otherwise(-size))


def histogram(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Per key and bucket: count, extremes, mean, variance and non-zero count."""
    v = F.col(value)
    return df.groupBy(*keys, log_bucket(v).alias("bucket")).agg(
        F.count(v).alias("n"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("var"),
        F.count_if(v != 0).alias("nonzero"),
    )


def _unless_nan(value: Column) -> Column:
    return F.when(F.max("bucket") == _NAN, float("nan")).otherwise(value)


def moments(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Merge bucket summaries to one row per key.

    The variance merges spreads around the overall mean, never raw sums of squares.
    """
    whole = Window.partitionBy(*keys)
    hist = hist.where(F.col("n") > 0)
    overall = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    spread = F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("overall"), F.lit(2.0)))
    return hist.withColumn("overall", overall).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        _unless_nan(F.min("lo")).alias("min"),
        F.max("hi").alias("max"),
        F.first("overall").alias("mean"),
        _unless_nan(F.sqrt(F.sum(spread) / F.sum("n"))).alias("std"),
        (F.sum("nonzero") / F.sum("n")).alias("nonzero_fraction"))


def percentiles(df: DataFrame, hist: DataFrame, keys: list[str], probs: dict[str, float],
                value: str = "v") -> DataFrame:
    """Linear-interpolated percentiles, one row per key with a column per name in ``probs``."""
    running = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    names = list(probs)
    at = hist.select(
        *keys, "bucket", "n",
        F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(whole).alias("total"), (F.max("bucket").over(whole) == _NAN).alias("nan"))
    wanted = F.array(*[
        F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), step(pos).cast("long").alias("rank"))
        for i, name in enumerate(names)
        for pos in [F.lit(probs[name]) * (F.col("total") - 1)]
        for side, step in ((0, F.floor), (1, F.ceil))
    ])
    before = F.col("upto") - F.col("n")
    targets = cut(
        at.select(*keys, "bucket", "total", "nan", before.alias("before"), F.explode(F.filter(
            wanted, lambda w: (w["rank"] >= before) & (w["rank"] < F.col("upto")))).alias("w"))
        .select(*keys, "bucket", "total", "nan", "before", "w.p", "w.side", "w.rank"))
    inside = sized(targets.select(*keys, "bucket").distinct())
    exact = (df.withColumn("bucket", log_bucket(F.col(value)))
             .join(inside, [*keys, "bucket"])
             .groupBy(*keys, "bucket", F.col(value).alias("_v")).agg(F.count("*").alias("m")))
    by_value = Window.partitionBy(*keys, "bucket").orderBy("_v")
    placed = exact.withColumn(
        "end", F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    hit = (placed.join(targets, [*keys, "bucket"])
           .where((F.col("rank") - F.col("before") < F.col("end"))
                  & (F.col("rank") - F.col("before") >= F.col("end") - F.col("m"))))
    pick = lambda i, side: F.max(F.when((F.col("p") == i) & (F.col("side") == side), F.col("_v")))
    out = hit.groupBy(*keys).agg(
        F.max("total").alias("total"), F.max("nan").alias("nan"),
        *[pick(i, 0).alias(f"_lo{i}") for i in range(len(names))],
        *[pick(i, 1).alias(f"_hi{i}") for i in range(len(names))])
    def between(i: int, name: str) -> Column:
        pos = F.lit(probs[name]) * (F.col("total") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        inside = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos)))
        return F.when(F.col("nan"), float("nan")).otherwise(inside).alias(name)
    return out.select(*keys, *[between(i, n) for i, n in enumerate(names)])


def exact_percentiles(df: DataFrame, keys: list[str], probs: dict[str, float],
                      value: str = "v") -> DataFrame:
    return percentiles(df, histogram(df, keys, value), keys, probs, value)


def summary(df: DataFrame, keys: list[str], probs: dict[str, float], value: str = "v") -> DataFrame:
    """Moments and percentiles in one row per key; the histogram is computed once."""
    hist = cut(histogram(df, keys, value))
    return moments(hist, keys).join(percentiles(df, hist, keys, probs, value), keys)
