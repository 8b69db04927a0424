"""Fault-stick text to pick rows.

Input is (file, line_no, line). Files are split into line blocks, so one very long file is still
parsed by many tasks. Output rows carry their line number as the order of points in a stick.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.arrays import let
from lithoframe.functions.lineage import cut
from lithoframe.functions.numeric import parse_number
from lithoframe.functions.scans import ROWS_PER_BLOCK, OrderedScan

# Name of a stick without one, and the viewer's line offsets and sample interval.
UNNAMED = "UNKNOWN"
VIEWER_INLINE, VIEWER_CROSSLINE, VIEWER_DT_MS = 1001, 1900, 4.0

_SPACE = r"(?U)\s+"


def _read(lines: DataFrame, row: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Turn lines into rows: ``row(text, tokens, numbers)`` is a struct, or null to skip the line.

    Text is trimmed and split once; dropping lines by a generator keeps the planner from repeating
    the parse inside a filter.
    """
    text = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    parsed = let(text, lambda t: let(F.split(t, _SPACE), lambda tok: let(
        F.transform(tok, parse_number), lambda num: F.when(t != "", row(t, tok, num)))))
    return lines.select("file", "line_no", F.explode(F.array_compact(F.array(parsed))).alias("row")).select(
        "file", "line_no", "row.*")


def _at(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i))


def _point(num: Column, x: int, y: int, z: int) -> Column:
    """Three numbers as a struct, null unless all were parsed."""
    x, y, z = (_at(num, i) for i in (x, y, z))
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(),
                  F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def _event(header: Column, name: Column, point: Column) -> Column:
    return F.when(header | point.isNotNull(), F.struct(
        header.alias("header"), name.alias("name"), F.when(~header, point).alias("point")))


def _sessions(events: DataFrame, rows_per_block: int) -> DataFrame:
    """Number the sticks of each file.

    ``events`` holds only lines that matter: (file, line_no, header, name, point). A header always
    opens a stick; a named point opens one when the open stick has another name; an unnamed point
    joins the open stick, or opens an unnamed one at the start of a file.
    """
    scan = OrderedScan.on_dense_order(events, ["file"], "line_no", rows_per_block)
    scan.running({"prev": ("last", F.col("name")), "seen": ("sum", F.lit(1))}, through=-1)
    open_name = F.coalesce("prev", F.when(F.col("seen") > 0, F.lit(UNNAMED)))
    starts = (F.col("header") | open_name.isNull()
              | (F.col("name").isNotNull() & (F.col("name") != open_name)))
    scan.apply(lambda df: df.withColumns({
        "starts": starts.cast("int"),
        "fault_name": F.coalesce("name", open_name, F.lit(UNNAMED))}))
    scan.running({"stick_no": ("sum", F.col("starts"))})
    return cut(scan.result().where(F.col("point").isNotNull()).select(
        "file", "fault_name", "stick_no", "line_no", "point.*"))


def _drop_singles(points: DataFrame, stick: list[str]) -> DataFrame:
    """Remove sticks of one point. They are named by that point, so the join key is never hot."""
    lone = points.groupBy(*stick).agg(
        F.count("*").alias("n"), F.min("line_no").alias("line_no")).where(F.col("n") == 1)
    return points.join(lone.select("file", "line_no"), ["file", "line_no"], "left_anti")


def parse_petrel(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``FAULT name`` headers, ``name x y z`` points and ``x y z`` continuations."""
    def row(text, tok, num):
        n = F.size(tok)
        header = text.rlike(r"(?iU)^FAULT\s+\S+$")
        name = F.when(header, _at(tok, 1)).when(n == 4, _at(tok, 0))
        point = F.when(n == 4, _point(num, 1, 2, 3)).when(n == 3, _point(num, 0, 1, 2))
        return F.when(~F.substring(text, 1, 1).isin("#", "!", "/"), _event(header, name, point))

    return _drop_singles(_sessions(_read(lines, row), rows_per_block), ["file", "stick_no"])


def parse_opendtect(lines: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``Fault: name`` headers and points from the first three columns."""
    title = r"(?iU)^Fault\s*:\s*(.+)$"

    def row(text, tok, num):
        header = text.rlike(title)
        name = F.when(header, F.trim(F.regexp_extract(text, title, 1)))
        point = F.when(F.size(tok) >= 3, _point(num, 0, 1, 2))
        return F.when(~F.startswith(text, F.lit("#")), _event(header, name, point))

    return _drop_singles(_sessions(_read(lines, row), rows_per_block), ["file", "stick_no"])


def parse_five_column(lines: DataFrame) -> DataFrame:
    """``x y z stick point`` rows, grouped by stick number wherever they stand in the file.

    Points of a stick are ordered by (point_id, line_no).
    """
    def row(text, tok, num):
        whole = lambda i: F.when(F.abs(_at(num, i)) < 9.2e18, _at(num, i).cast("long"))
        point = _point(num, 0, 1, 2)
        good = ((F.size(tok) >= 5) & ~F.startswith(text, F.lit("#")) & point.isNotNull()
                & whole(3).isNotNull() & whole(4).isNotNull())
        return F.when(good, F.struct(point.alias("p"), whole(3).alias("stick_no"), whole(4).alias("point_id")))

    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return _drop_singles(cut(_read(lines, row)), ["file", "stick_no"]).select(
        "file", F.concat(stem, F.lit("_stick"), "stick_no").alias("fault_name"),
        "stick_no", "point_id", "line_no", "p.*")


def parse_index_dat(lines: DataFrame) -> DataFrame:
    """One stick per file; first two tokens and the last one, the last being a sample index."""
    def row(text, tok, num):
        il, xl, last = _at(num, 0), _at(num, 1), F.element_at(num, -1)
        good = ((F.size(tok) >= 3) & ~F.startswith(text, F.lit("#")) & ~F.startswith(text, F.lit("FAULT"))
                & il.isNotNull() & xl.isNotNull() & last.isNotNull())
        return F.when(good, F.struct(il.alias("il"), xl.alias("xl"), last.alias("s")))

    return _read(lines, row)


def parse_viewer_dat(lines: DataFrame) -> DataFrame:
    """Lines of exactly three integers as absolute inline, crossline and time; other text raises."""
    def row(text, tok, num):
        at = lambda i: _at(tok, i).cast("int")
        return F.when((F.size(tok) == 3) & ~F.startswith(text, F.lit("#")), F.struct(
            (at(0) + VIEWER_INLINE).cast("double").alias("inline"),
            (at(1) + VIEWER_CROSSLINE).cast("double").alias("crossline"),
            (at(2) * VIEWER_DT_MS).alias("twt")))

    return _read(lines, row)


PARSERS = {
    "petrel": parse_petrel,
    "volve": parse_index_dat,
    "f3": parse_five_column,
    "opendtect": parse_opendtect,
}


def parse_sticks(lines: DataFrame, fmt: str) -> DataFrame:
    """Dispatch by format name."""
    if fmt not in PARSERS:
        raise ValueError(f"unknown stick format {fmt!r}; have {sorted(PARSERS)}")
    return PARSERS[fmt](lines)
