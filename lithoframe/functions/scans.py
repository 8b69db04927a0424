"""Ordered scans over groups of any size.

A window over a group runs in one task. When one group may hold a large share of all rows the group
is split into contiguous blocks; each block is scanned on its own, and what a block needs from
earlier ones (a running total, the last name seen, the next row) comes from one summary row per
block. Only the summaries are scanned per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut, sized

ROWS_PER_BLOCK = 100_000
_BLK = "_blk"

_AGGS = {
    "sum": F.sum, "min": F.min, "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _merge(how: str, own: Column, carry: Column) -> Column:
    """Combine a value from within a block with what came before the block."""
    if how == "sum":
        return F.when(own.isNull(), carry).when(carry.isNull(), own).otherwise(own + carry)
    return {"min": F.least, "max": F.greatest, "last": F.coalesce}[how](own, carry)


class OrderedScan:
    """Running values along ``order`` within ``keys``; ``df`` grows a column per call."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        self.df, self.keys, self.order, self.parts = df, keys, order, parts

    @classmethod
    def on_dense_order(cls, df: DataFrame, keys: list[str], order: str,
                       rows_per_block: int = ROWS_PER_BLOCK) -> OrderedScan:
        """Blocks by arithmetic on an integer order column that is unique within its key.

        The rows are read several times, so they are written out first.
        """
        return cls(cut(df.withColumn(_BLK, F.floor(F.col(order) / rows_per_block))), keys, [order])

    @classmethod
    def on_any_order(cls, df: DataFrame, keys: list[str], order: list[str], rows: int | None = None,
                     rows_per_block: int = ROWS_PER_BLOCK) -> OrderedScan:
        """Blocks by range partition, so a group of any size is spread over tasks.

        Range bounds come from a sample and may differ between two computations of the same plan,
        so the assignment is written out before anything reads it twice. ``rows``, where the caller knows them, set
        the number of blocks and of the tasks that scan them, so that no task grows with the input.
        """
        parts = max(1, -(-rows // rows_per_block)) if rows is not None else None
        ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order)
        return cls(cut(ranged.withColumn(_BLK, F.spark_partition_id().cast("long"))), keys, order, parts)

    def _rows(self):
        return Window.partitionBy(*self.keys, _BLK).orderBy(*self.order)

    def _blocks(self):
        return Window.partitionBy(*self.keys).orderBy(_BLK)

    def _join_blocks(self, aggs: dict[str, Column], *carries: dict[str, Column]) -> None:
        """Attach to each row what its block receives from the block summaries of its group; each dict builds on those before.

        The rows feed both the summaries and the join, so rows that aren't written yet are written first: a chain of scans
        then costs one pass per step instead of doubling with each.
        """
        self.df = sized(self.df)
        blocks = self.df.groupBy(*self.keys, _BLK).agg(*[c.alias(n) for n, c in aggs.items()])
        for c in carries:
            blocks = blocks.withColumns(c)
        names = [n for c in carries for n in c]
        blocks, on = blocks.select(*self.keys, _BLK, *names), [*self.keys, _BLK]
        if self.parts:      # rows meet the written summaries first, then go to as many tasks as there are blocks
            self.df = self.df.join(sized(blocks), on, "left").repartition(self.parts, *on)
        else:
            self.df = self.df.join(blocks, on, "left")

    def running(self, specs: dict[str, tuple[str, Column]], through: int = 0) -> OrderedScan:
        """Running sum, min, max or last non-null per output name.

        ``through=-1`` leaves the current row out; the value is null where nothing precedes.
        """
        prior = self._blocks().rowsBetween(Window.unboundedPreceding, -1)
        self._join_blocks(
            {f"_s_{o}": self._block_value(how, c) for o, (how, c) in specs.items()},
            {f"_c_{o}": _AGGS[how](F.col(f"_s_{o}")).over(prior) for o, (how, _) in specs.items()})
        self._run_in_blocks(specs, through)
        self.df = self.df.withColumns({
            o: _merge(how, F.col(o), F.col(f"_c_{o}")) for o, (how, _) in specs.items()})
        self.df = self.df.drop(*[f"_c_{o}" for o in specs])
        return self

    def _run_in_blocks(self, specs: dict[str, tuple[str, Column]], through: int) -> None:
        rows = self._rows().rowsBetween(Window.unboundedPreceding, through)
        self.df = self.df.withColumns({f"_in_{o}": c for o, (_, c) in specs.items()}).withColumns({
            o: _AGGS[how](F.col(f"_in_{o}")).over(rows) for o, (how, _) in specs.items()}).drop(
            *[f"_in_{o}" for o in specs])

    def stretches(self, length: Column, start: str, end: str, total: str, nth: str, n: str) -> OrderedScan:
        """Where each row's stretch of ``length`` (not negative; null for none) starts and ends on the line of its group.

        ``start`` is the sum of the lengths before the row, ``end`` the very number the next row starts from (null at the
        end), ``total`` the start of the last row, ``nth`` the rows before the row, and ``n`` the rows of the group. All five
        come from one pass: rows are written once with what their block knows, and joined with one summary of each block.
        """
        rows, specs = self._rows(), {start: ("sum", length), nth: ("sum", F.lit(1))}
        self._run_in_blocks(specs, -1)
        self.df = self.df.withColumns({end: F.lead(start).over(rows), "_ends": F.lead(F.lit(True)).over(rows).isNull()})
        blocks = self._blocks()
        prior, group = blocks.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*self.keys)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        self._join_blocks(
            {"_sum": zero(F.sum(length)), "_most": zero(F.max(start)), "_rows": F.count(F.lit(1))},
            {"_before": zero(F.sum("_sum").over(prior)), "_gone": F.coalesce(F.sum("_rows").over(prior), F.lit(0))},
            {"_after": F.lead("_before").over(blocks), total: F.max(F.col("_most") + F.col("_before")).over(group),
             n: F.sum("_rows").over(group)})
        at = lambda c: zero(F.col(c)) + F.col("_before")
        self.df = self.df.withColumns({
            end: F.when(F.col("_ends"), F.col("_after")).otherwise(at(end)), start: at(start),
            nth: F.coalesce(nth, F.lit(0)) + F.col("_gone")}).drop("_ends", "_before", "_gone", "_after")
        return self

    def _block_value(self, how: str, value: Column) -> Column:
        if how != "last":
            return _AGGS[how](value)
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))

    def whole(self, specs: dict[str, tuple[str, Column]]) -> OrderedScan:
        """Sum, min or max of the whole group on every row."""
        group = Window.partitionBy(*self.keys)
        self._join_blocks({f"_s_{o}": _AGGS[how](c) for o, (how, c) in specs.items()},
                          {o: _AGGS[how](F.col(f"_s_{o}")).over(group) for o, (how, _) in specs.items()})
        return self

    def next_row(self, out: str, cols: list[str]) -> OrderedScan:
        """The following row of the group as a struct, null at the end."""
        self._join_blocks({"_s": F.min_by(F.struct(*cols), F.struct(*self.order))},
                          {"_c": F.lead("_s").over(self._blocks())})
        ahead = F.lead(F.struct(*cols)).over(self._rows())
        self.df = self.df.withColumn(out, F.coalesce(ahead, F.col("_c"))).drop("_c")
        return self

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> OrderedScan:
        """Add columns row by row."""
        self.df = fn(self.df)
        return self

    def result(self) -> DataFrame:
        return self.df.drop(_BLK)
