"""Shards cut from a Hilbert curve through the documents' metadata.

Every dimension is quantised at approximate quantiles of all rows, the cells are numbered along a Hilbert curve, and the
rows in that order are cut into runs of equal counts. A shard then spans a small box of every dimension, so readers
skip most shards by the minima and maxima of any of them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lithoframe.llm.common import in_order


@dataclass(frozen=True)
class Settings:
    shards: int = 40
    bits: int = 6           # of each dimension
    accuracy: int = 10000   # of the quantiles


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the curve of each row of cells (rows x dimensions, values below 2 ** bits).

    From the highest bit down, the axes are reflected and exchanged so that sub-cubes join end to end, then
    Gray-coded; the index takes one bit of every axis in turn.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[:, i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> b) & 1)
    return index


def as_number(docs: DataFrame, column: str) -> Column:
    """A number in the order of the column: itself, or of a string seven bytes after what all strings begin with."""
    if not isinstance(docs.schema[column].dataType, StringType):
        return F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))
    low, high = docs.agg(F.min(column), F.max(column)).first()
    skipped = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    window = F.hex(F.substring(F.encode(F.col(column), "UTF-8"), skipped + 1, 7))
    return F.coalesce(F.conv(F.rpad(window, 14, "0"), 16, 10).cast("double"), F.lit(float("-inf")))


def along_curve(docs: DataFrame, dimensions: list[str], settings: Settings = Settings(), name: str = "curve") -> DataFrame:
    """docs with ``name``, the index of the cell that the row's dimensions fall into; nulls go before all values."""
    s = settings
    values = {c: as_number(docs, c) for c in dimensions}
    steps = F.array(*[F.lit(k / (1 << s.bits)) for k in range(1, 1 << s.bits)])
    found = docs.agg(*[F.percentile_approx(v, steps, F.lit(s.accuracy)) for v in values.values()]).first()
    bounds = [np.unique(np.array(b if b else [], float)) for b in found]

    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        cells = [np.searchsorted(b, points.iloc[:, i].to_numpy(float), side="right") for i, b in enumerate(bounds)]
        return pd.Series(hilbert(np.stack(cells, axis=1), s.bits), dtype="int64")

    return docs.withColumn(name, index(F.struct(*[v.alias(f"d{i}") for i, v in enumerate(values.values())])))


def shard(docs: DataFrame, dimensions: list[str], ties: list[str], settings: Settings = Settings()) -> DataFrame:
    """docs with curve, shard and slot: row r of n in the order of curve and ``ties`` is in shard r * shards // n.

    Shards differ by a row at most, and slots count from 0 without gaps. Rows equal in all of these are exchangeable.
    With fewer rows than shards some shards are empty. Input columns of these names are replaced, all
    others stay as they are, whatever their names.
    """
    s = settings
    new = {"curve", "shard", "slot"}
    held = [c for c in docs.columns if c.lower() not in new]
    # what the caller has goes along in one column, so its names meet none of those made here
    spare = max((c for c in docs.columns), key=len, default="") + "_curve"
    own = along_curve(docs, dimensions, s, spare).select(
        F.struct(*held).alias("_doc"), F.col(spare).alias("_curve"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)],
        F.lit(1).cast("long").alias("_one"))
    placed = in_order(own, ["_curve", *[f"_t{i}" for i in range(len(ties))]], {"_one": "_row"})
    n, row = docs.count(), F.col("_row")
    done = placed.withColumn("_shard", F.expr(f"(_row * {s.shards}L) div {max(n, 1)}L").cast("int")).withColumn(
        "_slot", row - F.expr(f"(_shard * {n}L + {s.shards - 1}L) div {s.shards}L"))
    return done.select("_doc.*", F.col("_curve").alias("curve"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def write_shards(sharded: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """A folder shard=k for each shard, its rows by slot, one file each."""
    (sharded.repartition(settings.shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
