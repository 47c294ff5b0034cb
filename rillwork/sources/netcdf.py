"""Classic NetCDF files as rows, read by ranges of bytes, and written a file a month.

The header names every variable's place; a partition is a run of time steps of one file, and of those steps only the rows of the grid within the
bounds are read. ``read_netcdf`` and ``write_netcdf`` register the format. Classic files are those of versions 1 (CDF-1), 2 (64-bit offsets) and 5 (64-bit data).
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from .files import PUSHDOWN, Bounds, Ranges, listed, publish, ranges, remove, stage, store

SUFFIXES = (".nc",)
#: Cells of a partition, about; files whose headers are read at a time.
CELLS, THREADS = 1 << 20, 16

# fixed values of the format
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
_UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
_TIME, _X, _Y = ("time", "valid_time", "t"), ("x", "lon", "longitude", "projection_x_coordinate", "easting"), ("y", "lat", "latitude", "projection_y_coordinate", "northing")


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    #: Bytes from one record to the next; 0 if it has none.
    step: int
    attributes: dict

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize


class _Cursor:
    """Reads a header piece by piece, a block of the file at a time."""

    def __init__(self, read: Ranges):
        self.read, self.at, self.held, self.first = read, 0, b"", 0

    def take(self, n: int) -> bytes:
        if self.at + n > self.first + len(self.held):
            self.first, self.held = self.at, self.read(self.at, max(n, 1 << 16))
        out = self.held[self.at - self.first : self.at - self.first + n]
        if len(out) < n:
            raise ValueError("the header is cut off")
        self.at += n
        return out

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]


def header(read: Ranges) -> dict[str, Variable]:
    """All variables of a classic file by name."""
    c = _Cursor(read)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file")
    count, offset = ("q" if magic[3] == 5 else "i"), ("i" if magic[3] == 1 else "q")

    def text() -> str:
        n = c.number(count)
        return c.take(-(-n // 4) * 4)[:n].decode()

    def attributes() -> dict:
        out = {}
        if c.number("i") in (0, _ATTRIBUTES):
            for _ in range(c.number(count)):
                name, kind = text(), _TYPES[c.number("i")]
                n = c.number(count)
                size = n * np.dtype(kind).itemsize
                raw = c.take(-(-size // 4) * 4)[:size]
                out[name] = raw.decode(errors="replace") if kind == "S1" else np.frombuffer(raw, ">" + kind).astype(kind)
        return out

    records = c.number(count)
    dims: list[tuple[str, int]] = []
    if c.number("i") in (0, _DIMENSIONS):
        dims = [(text(), c.number(count)) for _ in range(c.number(count))]
    attributes()
    found: list[list] = []
    if c.number("i") in (0, _VARIABLES):
        for _ in range(c.number(count)):
            name = text()
            own = [dims[c.number(count)] for _ in range(c.number(count))]
            found.append([name, own, attributes(), _TYPES[c.number("i")], c.number(count), c.number(offset)])
    recorded = [v for v in found if v[1] and v[1][0][1] == 0]
    # a single record variable isn't padded to four bytes
    sizes = [int(np.prod([n for _, n in v[1][1:]])) * np.dtype(v[3]).itemsize for v in recorded]
    step = sizes[0] if len(recorded) == 1 else sum(-(-s // 4) * 4 for s in sizes)
    if records < 0:  # written as a stream
        records = (read.size - min(v[5] for v in recorded)) // step if recorded and step else 0
    return {name: Variable(name, tuple(d for d, _ in own), tuple(n or records for _, n in own), kind, begin, step if [name, own] in [v[:2] for v in recorded] else 0, a) for name, own, a, kind, _, begin in found}


def values(read: Ranges, v: Variable, first: int = 0, last: int | None = None) -> np.ndarray:
    """Entries ``first`` to ``last`` of a variable's first dimension."""
    last = v.shape[0] if last is None else last
    inner = v.shape[1:]
    n = int(np.prod(inner)) * v.size
    if v.step and v.step != n:
        raw = b"".join(read(v.begin + i * v.step, n) for i in range(first, last))
    else:
        raw = read(v.begin + first * n, (last - first) * n)
    return np.frombuffer(raw, ">" + v.kind).reshape(last - first, *inner)


def _unpacked(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Numbers with fill values as NaN, scaled as the variable says."""
    out = raw.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        if name in v.attributes:
            out[raw == np.asarray(v.attributes[name]).astype(v.kind)[0]] = np.nan
    one = lambda name, other: float(np.atleast_1d(v.attributes.get(name, other))[0])
    return out * one("scale_factor", 1.0) + one("add_offset", 0.0)


def times(v: Variable, raw: np.ndarray) -> list[datetime]:
    """Times without a zone, from units such as ``hours since 1900-01-01 00:00:00``."""
    m = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", str(v.attributes.get("units", "")))
    if not m:
        raise ValueError(f"times in {v.attributes.get('units')!r}")
    start = datetime(*(int(p or 0) for p in m.groups()[1:]))
    return [start + timedelta(microseconds=round(float(x) * _UNITS[m[1]] * 1e6)) for x in raw]


def of_kind(dims: Sequence[str], names: Sequence[str]) -> str | None:
    return next((d for d in dims if d.lower() in names), None)


@dataclass(frozen=True)
class _Layout:
    place: str
    variable: Variable
    at: tuple[datetime, ...]
    x: np.ndarray
    y: np.ndarray
    turned: bool


def layout(place: str, name: str | None = None) -> _Layout:
    """A file's gridded variable (``name``, or the first over time, y and x) with its coordinates."""
    with ranges(place) as read:
        found = header(read)
        gridded = [v for v in found.values() if len(v.dims) == 3 and of_kind(v.dims[:1], _TIME) and of_kind(v.dims[1:], _X) and of_kind(v.dims[1:], _Y)]
        v = next((v for v in gridded if name in (None, v.name)), None)
        if v is None:
            raise ValueError(f"{place} has no variable {name or 'over time, y and x'}")
        at = times(found[v.dims[0]], values(read, found[v.dims[0]]))
        axis = {d: values(read, found[d]).astype(np.float64) for d in v.dims[1:]}
        x, y = of_kind(v.dims[1:], _X), of_kind(v.dims[1:], _Y)
        return _Layout(place, v, tuple(at), axis[x], axis[y], v.dims[1] == x)


@dataclass
class _Run(InputPartition):
    def __init__(self, layout: _Layout, steps: list[int], rows: tuple[int, int]):
        super().__init__(None)
        self.layout, self.steps, self.rows = layout, steps, rows


def rows_of(time: datetime, y: np.ndarray, x: np.ndarray, cells: np.ndarray, place: str) -> pa.RecordBatch:
    """Rows of one time step's grid, y by x; NaN cells are left out."""
    kept = np.flatnonzero(~np.isnan(cells.ravel()))
    stamp = pa.array([time.replace(tzinfo=timezone.utc)], pa.timestamp("us", tz="UTC")).take(pa.array(np.zeros(len(kept), np.int64)))
    return pa.RecordBatch.from_arrays([stamp, pa.array(y[kept // len(x)]), pa.array(x[kept % len(x)]), pa.array(cells.ravel()[kept]), pa.array([place] * len(kept), pa.string())], ["time", "y", "x", "value", "file"])


def seconds(t: datetime) -> float:
    """Of a time without a zone, or of one with, as UTC."""
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()


class GridReader(DataSourceReader):
    """Common to sources of ``time, y, x, value, file``: bounds by options or filters."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.place, self.variable = options["path"], options.get("variable")
        self.files = json.loads(options["files"]) if "files" in options else None
        self.cells, self.lenient = int(options.get("cells", CELLS)), options.get("damaged") == "skip"
        self.bounds = Bounds(("x", "y"), options)
        self.times = Bounds(("time",), options, datetime.fromisoformat)

    def partitions(self) -> list[InputPartition]:
        def runs(place: str) -> list[InputPartition]:
            try:
                return self.runs(place)
            except (ValueError, struct.error, KeyError, IndexError):
                if self.lenient:
                    return []
                raise

        with ThreadPoolExecutor(THREADS) as pool:
            return [r for found in pool.map(runs, listed(self.place, self.suffixes) if self.files is None else self.files) for r in found] or [InputPartition(None)]

    def runs(self, place: str) -> list[InputPartition]:
        raise NotImplementedError

    def wanted(self, time: datetime) -> bool:
        low, high = self.times.low.get("time"), self.times.high.get("time")
        return (low is None or seconds(time) >= seconds(low)) and (high is None or seconds(time) <= seconds(high))

    def within(self, c: str, axis: np.ndarray) -> np.ndarray:
        return np.flatnonzero((axis >= self.bounds.low.get(c, -np.inf)) & (axis <= self.bounds.high.get(c, np.inf)))

    def narrow(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.bounds.narrow(f)
            self.times.narrow(f)
            yield f


class _Reader(GridReader):
    suffixes = SUFFIXES

    def runs(self, place: str) -> list[InputPartition]:
        found = layout(place, self.variable)
        outer, axis = ("x", found.x) if found.turned else ("y", found.y)
        rows = self.within(outer, axis)
        steps = [i for i, t in enumerate(found.at) if self.wanted(t)]
        if not len(rows) or not steps:
            return []
        each = max(1, self.cells // max(1, (rows[-1] - rows[0] + 1) * (len(found.y) if found.turned else len(found.x))))
        return [_Run(found, steps[i : i + each], (int(rows[0]), int(rows[-1]) + 1)) for i in range(0, len(steps), each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Run):
            return
        found, (first, last) = partition.layout, partition.rows
        v, inner = found.variable, found.variable.shape[2]
        with ranges(found.place) as read:
            for step in partition.steps:
                base = v.begin + step * (v.step or v.shape[1] * inner * v.size)
                raw = np.frombuffer(read(base + first * inner * v.size, (last - first) * inner * v.size), ">" + v.kind).reshape(last - first, inner)
                cells = _unpacked(v, raw)
                y, x = (found.y, found.x[first:last]) if found.turned else (found.y[first:last], found.x)
                cells = cells.T if found.turned else cells
                some_y, some_x = self.within("y", y), self.within("x", x)
                yield rows_of(found.at[step], y[some_y], x[some_x], cells[np.ix_(some_y, some_x)], found.place)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.narrow(filters)


class NetCdf(DataSource):
    """Options: ``path`` (a file or folder), ``variable``, ``x_min, x_max, y_min, y_max, time_min, time_max``, ``cells`` of a partition, ``pushdown``,
    and ``damaged=skip`` to pass over files that can't be read.

    Rows are ``time, y, x, value, file``; cells with the fill value are left out. As a sink it takes ``time, y, x, value`` and writes
    ``<prefix>_<year>_<month>.nc``.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return "time timestamp, y double, x double, value double, file string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MonthWriter(dict(self.options), overwrite, ".nc", lambda *a, variable=self.options.get("variable", "value"): netcdf_chunks(variable, *a))


def netcdf_chunks(name: str, at: list[datetime], y: np.ndarray, x: np.ndarray, cells: np.ndarray, none: float = 9.96920996838687e36) -> Iterator[bytes]:
    """A file of 64-bit offsets with ``name`` over time (its records), y and x. NaN is written as the fill value."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attribute = lambda n, v: text(n) + (struct.pack(">i", 2) + text(v) if isinstance(v, str) else struct.pack(">iid", 6, 1, v))
    dims = struct.pack(">ii", _DIMENSIONS, 3) + b"".join(text(d) + struct.pack(">i", n) for d, n in (("time", 0), ("y", len(y)), ("x", len(x))))
    variables = [("time", [0], [("units", "seconds since 1970-01-01 00:00:00")], 8), ("y", [1], [], 8 * len(y)), ("x", [2], [], 8 * len(x)), (name, [0, 1, 2], [("_FillValue", none)], 8 * len(y) * len(x))]

    def listing(begins: Sequence[int]) -> bytes:
        out = struct.pack(">ii", _VARIABLES, len(variables))
        for (n, own, attributes, size), begin in zip(variables, begins):
            out += text(n) + struct.pack(f">i{len(own)}i", len(own), *own)
            out += struct.pack(">ii", _ATTRIBUTES if attributes else 0, len(attributes)) + b"".join(attribute(*a) for a in attributes)
            out += struct.pack(">iiq", 6, min(size, 2**31 - 4), begin)
        return out

    start = struct.pack(">4si", b"CDF\x02", len(at)) + dims + struct.pack(">ii", 0, 0)
    first = len(start) + len(listing([0] * 4))
    yield start + listing([first + 8 * (len(y) + len(x)), first, first + 8 * len(y), first + 8 * (len(y) + len(x)) + 8])
    yield np.asarray(y, ">f8").tobytes() + np.asarray(x, ">f8").tobytes()
    for t, grid in zip(at, cells):
        yield struct.pack(">d", seconds(t)) + np.where(np.isnan(grid), none, grid).astype(">f8").tobytes()


@dataclass
class _Staged(WriterCommitMessage):
    files: dict[str, str] = field(default_factory=dict)


class MonthWriter(DataSourceArrowWriter):
    """Writes each month of a partition's rows to a hidden file; commit gives all their names, abort removes them."""

    def __init__(self, options: dict[str, str], overwrite: bool, suffix: str, chunks):
        self.place, self.prefix, self.suffix = options["path"].rstrip("/"), options.get("prefix", "values"), suffix
        self.overwrite, self.chunks = overwrite, chunks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in iterator:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            micros = column("time").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            y, x, value = (column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "x", "value"))
            month = micros.astype("datetime64[us]").astype("datetime64[M]").astype(np.int64)
            for m in np.unique(month):
                mine = month == m
                held.setdefault((1970 + int(m) // 12, 1 + int(m) % 12), []).append((micros[mine], y[mine], x[mine], value[mine]))
        out = _Staged()
        for (year, month), parts in held.items():
            micros, y, x, value = (np.concatenate(p) for p in zip(*parts))
            at, t = np.unique(micros, return_inverse=True)
            ys, i = np.unique(y, return_inverse=True)
            xs, j = np.unique(x, return_inverse=True)
            cells = np.full((len(at), len(ys), len(xs)), np.nan)
            cells[t, i, j] = value
            stamps = [datetime(1970, 1, 1) + timedelta(microseconds=int(u)) for u in at]
            out.files[f"{self.prefix}_{year}_{month}{self.suffix}"] = stage(self.place, self.chunks(stamps, ys, xs, cells))[0]
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m.files for m in messages if m]
        new = {n: s for p in parts for n, s in p.items()}
        if sum(map(len, parts)) != len(new):
            self.abort(messages)
            raise ValueError("a month lies in two partitions: deal rows by month first")
        if self.overwrite and store(self.place)[0].get_file_info(store(self.place)[1]).type.name == "Directory":
            remove(p for p in listed(self.place, [self.suffix]) if p.rpartition("/")[2] not in new)
        for name, staged in new.items():
            publish(staged, f"{self.place}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(s for m in messages if m for s in m.files.values())


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets readers take filters."""
    spark.dataSource.register(NetCdf)
    spark.conf.set(PUSHDOWN, "true")


def grid_options(path: str | Sequence[str], variable: str | None, skip_damaged: bool, cells: int) -> dict[str, str]:
    where = {"path": path} if isinstance(path, str) else {"path": "", "files": json.dumps(list(path))}
    return where | {"cells": str(cells), "pushdown": "true", **({"variable": variable} if variable else {}), **({"damaged": "skip"} if skip_damaged else {})}


def read_netcdf(spark: SparkSession, path: str | Sequence[str], variable: str | None = None, skip_damaged: bool = False, cells: int = CELLS) -> DataFrame:
    """``time, y, x, value, file`` of a file, a folder or a list of files; filters on ``time`` leave out steps, those on ``y`` rows of the grid, before they are read."""
    register(spark)
    return spark.read.format("netcdf").options(**grid_options(path, variable, skip_damaged, cells)).load()


def by_month(df: DataFrame) -> DataFrame:
    """``time, y, x, value`` with a month's rows in one partition; rows without a time or place drop out."""
    rows = df.select(F.col("time").cast("timestamp").alias("time"), *(F.col(c).cast("double").alias(c) for c in ("y", "x", "value")))
    return rows.dropna(subset=["time", "y", "x"]).repartition(F.trunc(F.to_date("time"), "month"))


def write_netcdf(df: DataFrame, path: str, prefix: str = "values", variable: str = "value", append: bool = False) -> None:
    """One file a month, named ``<prefix>_<year>_<month>.nc``; months are those of UTC.

    A task holds a month's grid: every time with every y and x that the month has. A cell given twice keeps one value. Files appear
    together, when all are written; with ``append``, months that are there and not written again stay.
    """
    register(df.sparkSession)
    by_month(df).write.format("netcdf").options(prefix=prefix, variable=variable).mode("append" if append else "overwrite").save(path)
