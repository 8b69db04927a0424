"""SEG-Y as a splittable Spark source, and from bytes already in a column.

Partitions are byte ranges, cut from listed sizes alone: no file is opened to plan a read. Ranges of small files share a
partition. Trace records have a fixed length, so a task reads a file's header and begins at the first record of its range. Records are decoded as one NumPy buffer
into Arrow batches. With ``headers_only`` the samples are skipped in the file, and rows have no ``samples``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual,
)

from lithoframe import schema

# File layout in bytes and the sample encodings handled.
TEXT_HEADER, BINARY_HEADER, TRACE_HEADER = 3200, 400, 240
DT_AT, SAMPLES_AT, FORMAT_AT, EXTRA_TEXT_AT = 16, 20, 24, 304  # within the binary header
IBM_FLOAT, IEEE_FLOAT = 1, 5
TRACE_FIELDS = {  # name: (big-endian type, 1-based byte)
    "coord_scalar": (">i2", 71),
    "delay_ms": (">i2", 109),
    "cdp_x": (">i4", 181),
    "cdp_y": (">i4", 185),
    "inline": (">i4", 189),
    "crossline": (">i4", 193),
}
PARTITION_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
FILE_STRIDE = 1 << 40  # trace numbers of the next file start here
SKIP_BYTES = 2048  # shorter runs of samples between headers are read through: a request of its own costs more

ARROW = pa.schema([
    ("survey_id", pa.string()), ("trace_no", pa.int64()), ("inline", pa.int32()), ("crossline", pa.int32()),
    ("cdp_x", pa.float64()), ("cdp_y", pa.float64()), ("coord_scalar", pa.int32()), ("delay_ms", pa.float64()),
    ("dt_ms", pa.float64()), ("n_samples", pa.int32()), ("samples", pa.list_(pa.float32()))])
HEADERS = pa.schema([f for f in ARROW if f.name != "samples"])


@dataclass
class Layout:
    """What the file headers say about every trace record."""

    data_at: int
    n_samples: int
    dt_ms: float
    encoding: int

    @property
    def record(self) -> int:
        return TRACE_HEADER + 4 * self.n_samples

    @classmethod
    def parse(cls, head: bytes) -> Layout:
        if len(head) < TEXT_HEADER + BINARY_HEADER:
            raise ValueError("shorter than its file headers")
        short = lambda at: int.from_bytes(head[TEXT_HEADER + at:TEXT_HEADER + at + 2], "big", signed=True)
        encoding = short(FORMAT_AT)
        if encoding not in (IBM_FLOAT, IEEE_FLOAT):
            raise ValueError(f"unsupported sample encoding {encoding}")
        n = short(SAMPLES_AT) & 0xFFFF
        if n == 0:
            raise ValueError("no samples per trace")
        extra = max(0, short(EXTRA_TEXT_AT))
        return cls(TEXT_HEADER + BINARY_HEADER + extra * TEXT_HEADER, n, (short(DT_AT) & 0xFFFF) / 1000.0, encoding)

    def traces(self, size: int) -> int:
        """Trace records of a file of this size."""
        total, odd = divmod(size - self.data_at, self.record)
        if odd or total < 0:
            raise ValueError("does not hold whole trace records")
        return total

    def dtype(self, samples: bool = True) -> np.dtype:
        """A record; without its samples, a trace header alone."""
        fields = {n: (t, at - 1) for n, (t, at) in TRACE_FIELDS.items()}
        names, formats, offsets = [*fields], [t for t, _ in fields.values()], [o for _, o in fields.values()]
        if samples:
            names, formats, offsets = [*names, "raw"], [*formats, (">u4", (self.n_samples,))], [*offsets, TRACE_HEADER]
        return np.dtype({"names": names, "formats": formats, "offsets": offsets,
                         "itemsize": self.record if samples else TRACE_HEADER})


def decode_floats(raw: np.ndarray, encoding: int) -> np.ndarray:
    """32-bit words as float32: IEEE as they are, IBM by sign, base-16 exponent and fraction."""
    if encoding == IEEE_FLOAT:
        return raw.astype("u4").view("f4")
    word = raw.astype("u4")
    power = 4 * (((word >> 24) & 0x7F).astype("i4") - 64) - 24
    size = np.ldexp((word & 0xFFFFFF).astype("f8"), power)
    return np.where(word >> 31, -size, size).astype("f4")


def decode(buffer: bytes, layout: Layout, survey_id: str, first_trace: int, keep=None, samples: bool = True) -> pa.RecordBatch:
    """Whole trace records, or trace headers alone, to rows; ``keep`` picks records by header before samples are decoded."""
    rec = np.frombuffer(buffer, layout.dtype(samples))
    number = first_trace + np.arange(len(rec))
    if keep is not None:
        chosen = keep(rec)
        rec, number = rec[chosen], number[chosen]
    same = lambda v, t: pa.array(np.full(len(rec), v), t)
    col = lambda n, t: pa.array(rec[n].astype(t))
    columns = [
        pa.array([survey_id] * len(rec), pa.string()), pa.array(number.astype("i8")), col("inline", "i4"),
        col("crossline", "i4"), col("cdp_x", "f8"), col("cdp_y", "f8"), col("coord_scalar", "i4"),
        col("delay_ms", "f8"), same(layout.dt_ms, pa.float64()), same(layout.n_samples, pa.int32())]
    if not samples:
        return pa.RecordBatch.from_arrays(columns, schema=HEADERS)
    values = decode_floats(rec["raw"].reshape(-1), layout.encoding)
    ends = np.arange(0, len(values) + 1, layout.n_samples, dtype="i4")
    return pa.RecordBatch.from_arrays(
        [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=ARROW)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/")
                                      and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class ByteRange:
    """The records of a file that begin in [start, stop)."""

    path: str
    size: int
    survey_id: str
    file_no: int
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[ByteRange]


_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: np.isin(v, list(x)),
}


def headers_only(options: dict) -> bool:
    return str(options.get("headers_only", "false")).lower() == "true"


class SegyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.survey_id = options.get("survey_id")
        self.part_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.samples = not headers_only(options)
        self.filters = []

    def pushFilters(self, filters):
        """Filters on line numbers are tested on headers, before samples are decoded."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("inline",), ("crossline",)):
                self.filters.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            system, inner = _open(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
                found = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.is_file]
                yield from sorted((prefix + i.path, i.size) for i in found
                                  if i.extension.lower() in ("sgy", "segy"))
            elif info.is_file:
                yield path, info.size
            else:
                raise FileNotFoundError(path)

    def partitions(self) -> list[InputPartition]:
        """Ranges in order, put together while they hold no more than ``partition_bytes``."""
        parts, room = [], 0
        for file_no, (path, size) in enumerate(self._files()):
            for at in range(0, max(1, size), self.part_bytes):
                piece = ByteRange(path, size, self.survey_id or _stem(path), file_no, at, min(at + self.part_bytes, size))
                if not parts or piece.stop - at > room:
                    parts.append(Ranges([]))
                    room = self.part_bytes
                parts[-1].ranges.append(piece)
                room -= piece.stop - at
        return parts

    def _wanted(self, rec: np.ndarray) -> np.ndarray:
        mask = np.ones(len(rec), bool)
        for name, test, value in self.filters:
            mask &= test(rec[name], value)
        return mask

    def _records(self, f, layout: Layout, first: int, count: int) -> bytes:
        """These records, or their headers alone."""
        if self.samples or layout.record - TRACE_HEADER < SKIP_BYTES:
            whole = f.read_at(count * layout.record, layout.data_at + first * layout.record)
            if self.samples:
                return whole
            return np.frombuffer(whole, np.uint8).reshape(count, layout.record)[:, :TRACE_HEADER].tobytes()
        at = range(layout.data_at + first * layout.record, layout.data_at + (first + count) * layout.record, layout.record)
        return b"".join(f.read_at(TRACE_HEADER, a) for a in at)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for piece in part.ranges:
            yield from self._read_range(piece)

    def _read_range(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        system, inner = _open(part.path)
        with system.open_input_file(inner) as f:
            try:
                layout = Layout.parse(f.read_at(TEXT_HEADER + BINARY_HEADER, 0))
                total = layout.traces(part.size)
            except ValueError as e:
                raise ValueError(f"{part.path}: {e}") from None
            begins = lambda at: min(total, max(0, -((layout.data_at - at) // layout.record)))
            first, stop = begins(part.start), begins(part.stop)
            step = max(1, BATCH_BYTES // layout.record)
            for at in range(first, stop, step):
                buffer = self._records(f, layout, at, min(step, stop - at))
                yield decode(buffer, layout, part.survey_id, part.file_no * FILE_STRIDE + at,
                             self._wanted if self.filters else None, self.samples)


class SegyDataSource(DataSource):
    """``spark.read.format("segy").load(path)``; options survey_id, partition_bytes and headers_only."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self):
        held = [f for f in schema.TRACES if f.name != "samples" or not headers_only(self.options)]
        return T.StructType(held)

    def reader(self, schema) -> DataSourceReader:
        return SegyReader(self.options)


def read_segy(spark, *paths: str, **options) -> DataFrame:
    """Traces of SEG-Y files or folders; ``headers_only=True`` leaves the samples in the files."""
    spark.dataSource.register(SegyDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("segy").options(**options).load(",".join(paths))


def from_bytes(files: DataFrame) -> DataFrame:
    """Traces of many small files held as (path, content); trace numbers count within a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                view = content.as_buffer()
                layout = Layout.parse(view[:TEXT_HEADER + BINARY_HEADER].to_pybytes())
                layout.traces(len(view))
                yield decode(view[layout.data_at:], layout, _stem(path), 0)

    return files.select("path", "content").mapInArrow(run, schema.TRACES)
