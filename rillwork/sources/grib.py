"""GRIB files as rows: messages are indexed by their lengths, and only those within the bounds are decoded.

Editions 1 and 2, regular grids of latitude and longitude, simple packing, with or without a bitmap. ``read_grib`` and ``write_grib`` register the format;
what is written is edition 2.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition

from .files import PUSHDOWN, Ranges, ranges
from .netcdf import CELLS, GridReader, MonthWriter, by_month, grid_options, rows_of

SUFFIXES = (".grib", ".grb", ".grib2", ".grb2")
#: Bits of a packed value that the sink writes.
BITS = 32

# fixed values of the format: seconds of a unit of time
_STEPS = {0: 60, 1: 3600, 2: 86400, 10: 3 * 3600, 11: 6 * 3600, 12: 12 * 3600, 13: 1, 254: 1}


def signed(raw: bytes) -> int:
    """Sign and size, as the format has them."""
    n = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return -(n - top) if n >= top else n


def _sign(n: int, size: int) -> bytes:
    return (abs(n) | (n < 0) << (8 * size - 1)).to_bytes(size, "big")


def hexadecimal_float(raw: bytes) -> float:
    """A float of base 16, as edition 1 has its reference value."""
    sign, power, fraction = raw[0] >> 7, raw[0] & 127, int.from_bytes(raw[1:4], "big")
    return (-1) ** sign * fraction / 2**24 * 16.0 ** (power - 64)


@dataclass(frozen=True)
class Message:
    """Where a message lies, what it is of, and where its packed values are within it."""

    begin: int
    length: int
    name: str
    time: datetime
    y: tuple[float, float, int]
    x: tuple[float, float, int]
    reference: float
    binary: int
    decimal: int
    bits: int
    data: tuple[int, int]
    bitmap: tuple[int, int] | None


def _first(read: Ranges, at: int, head: bytes) -> Message:
    length = int.from_bytes(head[4:7], "big")
    p = read(at + 8, 40)
    n, has = int.from_bytes(p[:3], "big"), p[7]
    if not has & 128:
        raise ValueError("a message without a grid")
    hour = datetime(100 * (p[24] - 1) + p[12], p[13], p[14], p[15], p[16])
    step = p[18] if p[20] in (0, 1) else p[19] if p[20] in (2, 3, 4, 5) else int.from_bytes(p[18:20], "big") if p[20] == 10 else 0
    g = read(at + 8 + n, 32)
    if g[5] not in (0, 4):
        raise ValueError(f"grid of kind {g[5]}")
    nx, ny = int.from_bytes(g[6:8], "big"), int.from_bytes(g[8:10], "big")
    y0, x0, y1, x1 = (signed(g[i : i + 3]) / 1000 for i in (10, 13, 17, 20))
    if g[27] & 0b10110000:
        raise ValueError("a grid by columns, or not from west to east")
    here = 8 + n + int.from_bytes(g[:3], "big")
    bitmap = None
    if has & 64:
        size = int.from_bytes(read(at + here, 3), "big")
        bitmap = (here + 6, size - 6)
        here += size
    d = read(at + here, 11)
    if d[3] >> 4 & 0b1101:
        raise ValueError("packed otherwise than simply")
    size = int.from_bytes(d[:3], "big")
    return Message(at, length, str(p[8]), hour + timedelta(seconds=step * _STEPS.get(p[17], 3600)), (y0, y1, ny), (x0, x1, nx), hexadecimal_float(d[6:10]), signed(d[4:6]), signed(p[26:28]), d[10], (here + 11, size - 11), bitmap)


def _second(read: Ranges, at: int, head: bytes) -> Message:
    length = struct.unpack(">Q", head[8:16])[0]
    here, discipline = 16, head[6]
    time = grid = name = packing = bitmap = None
    while here < length - 4:
        size = struct.unpack(">I", read(at + here, 4))[0]
        s = read(at + here, min(size, 128))
        if s[4] == 1:
            time = datetime(*struct.unpack(">HBBBBB", s[12:19]))
        elif s[4] == 3:
            if struct.unpack(">H", s[12:14])[0] != 0:
                raise ValueError("no grid of latitude and longitude")
            nx, ny = struct.unpack(">II", s[30:38])
            y0, x0, y1, x1 = (signed(s[i : i + 4]) / 1e6 for i in (46, 50, 55, 59))
            if s[71] & 0b10110000:
                raise ValueError("a grid by columns, or not from west to east")
            grid = (y0, y1, ny), (x0, x1, nx)
        elif s[4] == 4:
            name = f"{discipline}.{s[9]}.{s[10]}"
            time += timedelta(seconds=_STEPS.get(s[17], 3600) * struct.unpack(">i", s[18:22])[0])
        elif s[4] == 5:
            if struct.unpack(">H", s[9:11])[0] != 0:
                raise ValueError("packed otherwise than simply")
            packing = struct.unpack(">f", s[11:15])[0], signed(s[15:17]), signed(s[17:19]), s[19]
        elif s[4] == 6 and s[5] == 0:
            bitmap = (here + 6, size - 6)
        elif s[4] == 7:
            return Message(at, length, name, time, *grid, *packing, (here + 5, size - 5), bitmap)
        here += size
    raise ValueError("a message without data")


def messages(read: Ranges) -> Iterator[Message]:
    """The file's index: one message after another, by their lengths; of a message only its head is read."""
    at = 0
    while at + 16 <= read.size:
        head = read(at, 16)
        if head[:4] != b"GRIB":
            at += 1 if b"GRIB" not in head else head.index(b"GRIB")  # filling between messages
            continue
        m = {1: _first, 2: _second}[head[7]](read, at, head)
        yield m
        at += m.length


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    """``n`` whole numbers of ``bits`` bits, highest first."""
    if bits == 0:
        return np.zeros(n)
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", n).astype(np.float64)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return flat @ (2.0 ** np.arange(bits - 1, -1, -1))


def decode(m: Message, read: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitudes, longitudes and the grid; cells outside the bitmap are NaN."""
    (y0, y1, ny), (x0, x1, nx) = m.y, m.x
    n = ny * nx
    there = np.ones(n, bool) if m.bitmap is None else np.unpackbits(np.frombuffer(read(m.begin + m.bitmap[0], m.bitmap[1]), np.uint8), count=n).astype(bool)
    packed = unpack_bits(read(m.begin + m.data[0], m.data[1]), m.bits, int(there.sum()))
    cells = np.full(n, np.nan)
    cells[there] = (m.reference + packed * 2.0**m.binary) / 10.0**m.decimal
    if x1 < x0:
        x1 += 360
    return np.linspace(y0, y1, ny), np.linspace(x0, x1, nx), cells.reshape(ny, nx)


class _Run(InputPartition):
    def __init__(self, place: str, held: list[Message]):
        super().__init__(None)
        self.place, self.held = place, held


class _Reader(GridReader):
    suffixes = SUFFIXES

    def runs(self, place: str) -> list[InputPartition]:
        out: list[_Run] = []
        size = 0
        with ranges(place) as read:
            for m in messages(read):
                if self.variable not in (None, m.name) or not self.wanted(m.time):
                    continue
                if not self.bounds.holds("y", *sorted(m.y[:2])) or m.x[0] <= m.x[1] and not self.bounds.holds("x", *m.x[:2]):
                    continue
                if not out or size >= self.cells:
                    out.append(_Run(place, []))
                    size = 0
                out[-1].held.append(m)
                size += m.y[2] * m.x[2]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Run):
            return
        with ranges(partition.place) as read:
            for m in partition.held:
                y, x, cells = decode(m, read)
                some_y, some_x = self.within("y", y), self.within("x", x)
                yield rows_of(m.time, y[some_y], x[some_x], cells[np.ix_(some_y, some_x)], partition.place)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.narrow(filters)


class Grib(DataSource):
    """Options as of ``netcdf``; ``variable`` is a number of edition 1's table, or ``discipline.category.number`` of edition 2."""

    @classmethod
    def name(cls) -> str:
        return "grib"

    def schema(self) -> str:
        return "time timestamp, y double, x double, value double, file string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MonthWriter(dict(self.options), overwrite, ".grib", grib_chunks)


def _spaced(axis: np.ndarray) -> np.ndarray:
    """The axis in even steps of its least one."""
    if len(axis) < 2:
        return axis
    step = np.diff(axis).min()
    n = round((axis[-1] - axis[0]) / step)
    full = np.linspace(axis[0], axis[-1], n + 1)
    if n > 100 * len(axis) or np.abs(full[np.rint((axis - axis[0]) / step).astype(int)] - axis).max() > step / 1000:
        raise ValueError("the grid isn't even")
    return full


def grib_chunks(at: list[datetime], y: np.ndarray, x: np.ndarray, cells: np.ndarray) -> Iterator[bytes]:
    """A message for each time, of edition 2. Values keep about ``BITS`` bits between the message's least and greatest; NaN is outside its bitmap."""
    ys, xs = _spaced(y), _spaced(x)
    i, j = np.abs(ys[:, None] - y).argmin(axis=0), np.abs(xs[:, None] - x).argmin(axis=0)
    micro = lambda v: _sign(round(float(v) * 1e6), 4)
    section = lambda number, body: struct.pack(">IB", len(body) + 5, number) + body
    for t, grid in zip(at, cells):
        full = np.full((len(ys), len(xs)), np.nan)
        full[np.ix_(i, j)] = grid
        flat = full.ravel()
        there = ~np.isnan(flat)
        held = flat[there]
        low = np.float32(held.min()) if len(held) else np.float32(0)
        if len(held) and low > held.min():
            low = np.nextafter(low, np.float32(-np.inf))
        spread = float(held.max() - low) if len(held) else 0.0
        binary = int(np.ceil(np.log2(spread / (2**BITS - 1)))) if spread > 0 else 0
        bits = BITS if spread > 0 else 0
        packed = np.rint((held - float(low)) / 2.0**binary).astype(f">u{BITS // 8}").tobytes() if bits else b""
        identity = struct.pack(">HHBBBHBBBBBBB", 0, 0, 2, 1, 1, t.year, t.month, t.day, t.hour, t.minute, t.second, 0, 1)
        shape = struct.pack(">BIBBH", 0, len(flat), 0, 0, 0) + b"\6" + b"\0" * 15 + struct.pack(">II", len(xs), len(ys)) + struct.pack(">II", 0, 0xFFFFFFFF)
        step = lambda axis: round(float(axis[1] - axis[0]) * 1e6) if len(axis) > 1 else 0
        shape += micro(ys[0]) + micro(xs[0]) + b"\x30" + micro(ys[-1]) + micro(xs[-1]) + struct.pack(">IIB", step(xs), step(ys), 0x40)
        product = struct.pack(">HHBBBBBHBBiBBIBBI", 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 255, 0, 0)
        packing = struct.pack(">IHf", len(held), 0, low) + _sign(binary, 2) + _sign(0, 2) + struct.pack(">BB", bits, 0)
        bitmap = b"\xff" if there.all() else b"\0" + np.packbits(there).tobytes()
        body = section(1, identity) + section(3, shape) + section(4, product) + section(5, packing) + section(6, bitmap) + section(7, packed) + b"7777"
        yield b"GRIB\0\0\0\2" + struct.pack(">Q", len(body) + 16) + body


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets readers take filters."""
    spark.dataSource.register(Grib)
    spark.conf.set(PUSHDOWN, "true")


def read_grib(spark: SparkSession, path: str | Sequence[str], variable: str | None = None, skip_damaged: bool = False, cells: int = CELLS) -> DataFrame:
    """``time, y, x, value, file`` of a file, a folder or a list of files; filters on ``time``, ``y`` and ``x`` leave out messages before they are decoded."""
    register(spark)
    return spark.read.format("grib").options(**grid_options(path, variable, skip_damaged, cells)).load()


def write_grib(df: DataFrame, path: str, prefix: str = "values", append: bool = False) -> None:
    """As ``write_netcdf``, with an even grid of degrees and times in whole seconds; values are packed to ``BITS`` bits."""
    register(df.sparkSession)
    by_month(df).write.format("grib").options(prefix=prefix).mode("append" if append else "overwrite").save(path)
