"""GeoTIFF grids as rows: a partition is a run of strips or tiles, and only those within the bounds are opened.

``spark.read.format("geotiff")`` needs ``register``; ``read_geotiff`` does it. Files may be TIFF or BigTIFF of either byte order, striped or tiled,
plain, deflated, LZW or packed bits, with or without horizontal differences, of any number of bands of one type.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage

from .files import PUSHDOWN, Bounds, Ranges, listed, publish, ranges, remove, stage, store

SUFFIXES = (".tif", ".tiff", ".TIF", ".TIFF")
#: Cells of a partition, about.
CELLS = 1 << 20
#: Headers read at a time on the driver.
THREADS = 16

# fixed values of the format: tags, and the sizes and codes of field types
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _ROWS, _STRIP_SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES, _FORMAT = 322, 323, 324, 325, 339
_SCALE, _TIE, _MATRIX, _NONE = 33550, 33922, 34264, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKED = 1, 5, 8, 32946, 32773


@dataclass(frozen=True)
class Grid:
    """What a file's first directory says, without its lists of blocks."""

    place: str
    order: str
    width: int
    height: int
    block_width: int
    block_height: int
    kind: str
    samples: int
    planar: int
    compression: int
    predictor: int
    x0: float
    y0: float
    dx: float
    dy: float
    none: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)


def _tags(read: Ranges) -> tuple[str, dict[int, tuple]]:
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count_kind, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    size = struct.calcsize(count_kind)
    (n,) = struct.unpack(order + count_kind, read(at, size))
    raw = read(at + size, n * entry)
    out = {}
    for i in range(n):
        part = raw[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "HH", part[:4])
        (count,) = struct.unpack(order + ("Q" if big else "I"), part[4 : 4 + inline])
        if kind not in _TYPES:
            continue
        code, held = _TYPES[kind], part[-inline:]
        length = count * struct.calcsize(code)
        if length > inline:
            held = read(struct.unpack(order + ("Q" if big else "I"), held)[0], length)
        out[tag] = struct.unpack(f"{order}{count}{code}", held[:length])
    return order, out


def grid_of(place: str) -> tuple[Grid, Sequence[int], Sequence[int]]:
    """A file's grid, and where its blocks begin and how long they are."""
    with ranges(place) as read:
        order, tags = _tags(read)
    one = lambda tag, other: tags.get(tag, (other,))[0]
    bits, form = one(_BITS, 1), one(_FORMAT, 1)
    if bits % 8 or (bits, form) not in {(b, f) for b in (8, 16, 32, 64) for f in (1, 2)} | {(32, 3), (64, 3)}:
        raise ValueError(f"{place}: samples of {bits} bits in format {form}")
    tiled = _TILES in tags
    width, height = one(_WIDTH, 0), one(_HEIGHT, 0)
    block = (one(_TILE_WIDTH, 0), one(_TILE_HEIGHT, 0)) if tiled else (width, min(one(_ROWS, height), height))
    if _MATRIX in tags:
        m = tags[_MATRIX]
        if m[1] or m[4]:
            raise ValueError(f"{place}: a turned grid")
        x0, y0, dx, dy = m[3], m[7], m[0], m[5]
    else:
        sx, sy = tags.get(_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y = tags.get(_TIE, (0.0, 0.0, 0.0, 0.0, 0.0))[:5]
        x0, y0, dx, dy = x - i * sx, y + j * sy, sx, -sy
    none = b"".join(tags[_NONE]).split(b"\0")[0].strip() if _NONE in tags else b""
    grid = Grid(place, order, width, height, *block, f"{'uif'[form - 1]}{bits // 8}", one(_SAMPLES, 1), one(_PLANAR, 1), one(_COMPRESSION, 1), one(_PREDICTOR, 1), x0, y0, dx, dy, float(none) if none else None)
    if grid.compression not in (_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKED) or grid.predictor not in (1, 2):
        raise ValueError(f"{place}: compression {grid.compression}, predictor {grid.predictor}")
    return grid, tags[_TILES if tiled else _STRIPS], tags[_TILE_SIZES if tiled else _STRIP_SIZES]


def _unpacked(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, each width one code early."""
    clear, end = 256, 257
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", bytearray()
    held = n = 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == end:
            break
        if code == clear:
            table, width, last = list(first), 9, b""
            continue
        if last:
            table.append(last + (table[code] if code < len(table) else last)[:1])
        last = table[code]
        out += last
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


_DECODE = {_PLAIN: bytes, _LZW: _lzw, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress, _PACKED: _unpacked}


def block_values(grid: Grid, index: int, data: bytes, band: int) -> tuple[np.ndarray, int, int]:
    """Values of a block's band, rows by columns, and its first row and column. A missing block has no values."""
    per_plane = grid.across * grid.down
    row, col = divmod(index % per_plane, grid.across)
    row, col = row * grid.block_height, col * grid.block_width
    samples = grid.samples if grid.planar == 1 else 1
    raw = _DECODE[grid.compression](data)
    whole = np.frombuffer(raw, grid.order + grid.kind)
    lines = len(whole) // (grid.block_width * samples)
    cube = whole[: lines * grid.block_width * samples].reshape(lines, grid.block_width, samples)
    if grid.predictor == 2:
        cube = np.cumsum(cube, axis=1, dtype=grid.kind)
    values = cube[: grid.height - row, : grid.width - col, band if grid.planar == 1 else 0]
    return values, row, col


@dataclass
class _Run(InputPartition):
    grid: Grid
    blocks: list[tuple[int, int, int]]

    def __init__(self, grid: Grid, blocks: list[tuple[int, int, int]]):
        super().__init__(None)
        self.grid, self.blocks = grid, blocks


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.place, self.band = options["path"], int(options.get("band", 1)) - 1
        self.bounds, self.cells = Bounds(("x", "y"), options), int(options.get("cells", CELLS))

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(THREADS) as pool:
            runs = [run for found in pool.map(self._runs, listed(self.place, SUFFIXES)) for run in found]
        return runs or [InputPartition(None)]

    def _runs(self, place: str) -> list[_Run]:
        grid, begins, sizes = grid_of(place)
        if self.band >= grid.samples:
            raise ValueError(f"{place} has {grid.samples} bands")
        plane = 0 if grid.planar == 1 else self.band * grid.across * grid.down
        runs: list[_Run] = []
        size = 0
        for i in range(plane, plane + grid.across * grid.down):
            row, col = divmod(i - plane, grid.across)
            ys = sorted(grid.y0 + grid.dy * (r + 0.5) for r in (row * grid.block_height, min((row + 1) * grid.block_height, grid.height) - 1))
            xs = sorted(grid.x0 + grid.dx * (c + 0.5) for c in (col * grid.block_width, min((col + 1) * grid.block_width, grid.width) - 1))
            if not sizes[i] or not self.bounds.holds("x", *xs) or not self.bounds.holds("y", *ys):
                continue
            if not runs or size >= self.cells:
                runs.append(_Run(grid, []))
                size = 0
            runs[-1].blocks.append((i, begins[i], sizes[i]))
            size += grid.block_width * grid.block_height
        return runs

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Run):
            return
        grid = partition.grid
        with ranges(grid.place) as read:
            for index, begin, size in partition.blocks:
                values, row, col = block_values(grid, index, read(begin, size), self.band)
                y = np.repeat(grid.y0 + grid.dy * (np.arange(row, row + values.shape[0]) + 0.5), values.shape[1])
                x = np.tile(grid.x0 + grid.dx * (np.arange(col, col + values.shape[1]) + 0.5), values.shape[0])
                value = values.ravel().astype(np.float64)
                kept = ~np.isnan(value)
                if grid.none is not None:
                    kept &= value != grid.none
                for c, at in (("x", x), ("y", y)):
                    kept &= (at >= self.bounds.low.get(c, -np.inf)) & (at <= self.bounds.high.get(c, np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]), pa.array(y[kept]), pa.array(value[kept]), pa.array([grid.place] * int(kept.sum()), pa.string())], ["x", "y", "value", "file"])


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.bounds.narrow(f)
            yield f


class GeoTiff(DataSource):
    """Options: ``path`` (a file or folder), ``band`` (from 1), ``x_min, x_max, y_min, y_max``, ``cells`` of a partition, ``pushdown``.

    Rows are ``x, y`` (cell centres)``, value, file``; cells without a value are left out. As a sink it takes ``x, y, value`` and writes one file
    a square of ``tile`` cells of size ``size``, aligned at 0, with the options ``rows`` (of a strip), ``deflate`` and ``none``.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "x double, y double, value double, file string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def tiff_bytes(values: np.ndarray, x0: float, y0: float, size: float, none: float | None = None, rows: int = 64, deflate: bool = True) -> bytes:
    """One band as a striped file; ``x0, y0``: the corner of least x and greatest y."""
    height, width = values.shape
    kind = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    strips = [values[r : r + rows].astype(values.dtype.newbyteorder("<")).tobytes() for r in range(0, height, rows)]
    strips = [zlib.compress(s, 6) for s in strips] if deflate else strips
    tags: list[tuple[int, int, Sequence]] = [(_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [8 * values.dtype.itemsize]), (_COMPRESSION, 3, [_DEFLATE if deflate else _PLAIN]), (262, 3, [1])]
    begins = np.cumsum([8, *map(len, strips)])
    tags += [(_STRIPS, 4, begins[:-1].tolist()), (_SAMPLES, 3, [1]), (_ROWS, 4, [rows]), (_STRIP_SIZES, 4, list(map(len, strips))), (_PLANAR, 3, [1]), (_FORMAT, 3, [kind])]
    tags += [(_SCALE, 12, [size, size, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])]
    if none is not None:
        tags.append((_NONE, 2, [bytes([c]) for c in f"{none:g}\0".encode()]))
    at = int(begins[-1]) + int(begins[-1]) % 2
    beyond = at + 2 + 12 * len(tags) + 4
    entries, more = b"", b""
    for tag, code, v in tags:
        raw = struct.pack(f"<{len(v)}{_TYPES[code]}", *v)
        if len(raw) > 4:
            raw, more = struct.pack("<I", beyond + len(more)), more + raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, code, len(v)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips).ljust(at - 8, b"\0") + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + more


@dataclass
class _Staged(WriterCommitMessage):
    files: dict[str, str] = field(default_factory=dict)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.place, self.overwrite = options["path"].rstrip("/"), overwrite
        self.size, self.tile, self.rows = float(options["size"]), int(options.get("tile", 256)), int(options.get("rows", 64))
        self.none, self.deflate = float(options.get("none", -9999)), options.get("deflate", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in iterator:
            x, y, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "value"))
            ix, iy = np.floor(x / self.size).astype(np.int64), np.floor(y / self.size).astype(np.int64)
            order = np.lexsort((ix // self.tile, iy // self.tile))
            tx, ty = ix[order] // self.tile, iy[order] // self.tile
            cuts = np.flatnonzero((np.diff(tx, prepend=tx[:1] - 1) != 0) | (np.diff(ty, prepend=ty[:1] - 1) != 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                cells = tiles.setdefault((int(tx[a]), int(ty[a])), np.full((self.tile, self.tile), self.none))
                mine = order[a:b]
                cells[self.tile - 1 - iy[mine] % self.tile, ix[mine] % self.tile] = np.where(np.isnan(value[mine]), self.none, value[mine])
        out = _Staged()
        for (tx, ty), cells in tiles.items():
            span = self.tile * self.size
            data = tiff_bytes(cells, tx * span, (ty + 1) * span, self.size, self.none, self.rows, self.deflate)
            out.files[f"tile_{tx}_{ty}.tif"] = stage(self.place, [data])[0]
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m.files for m in messages if m]
        if sum(map(len, parts)) != len({n for p in parts for n in p}):
            self.abort(messages)
            raise ValueError("a tile lies in two partitions: write with write_geotiff, which deals rows by tile")
        new = {n: s for p in parts for n, s in p.items()}
        if self.overwrite and store(self.place)[0].get_file_info(store(self.place)[1]).type.name == "Directory":
            remove(p for p in listed(self.place, SUFFIXES) if p.rpartition("/")[2] not in new)
        for name, staged in new.items():
            publish(staged, f"{self.place}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(s for m in messages if m for s in m.files.values())


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets readers take filters."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set(PUSHDOWN, "true")


def read_geotiff(spark: SparkSession, path: str, band: int = 1, cells: int = CELLS) -> DataFrame:
    """``x, y, value, file`` of a file or folder; filters on ``x`` and ``y`` decide which strips and tiles are opened."""
    register(spark)
    return spark.read.format("geotiff").options(path=path, band=str(band), cells=str(cells), pushdown="true").load()


def write_geotiff(df: DataFrame, path: str, size: float, tile: int = 256, rows: int = 64, deflate: bool = True, none: float = -9999.0) -> None:
    """``x, y, value`` as one file a square of ``tile`` cells; a cell given twice keeps one of its values, one at ``none`` none.

    A task holds the tiles it was dealt, of ``8 * tile**2`` bytes each. Files appear together, when all are written.
    """
    register(df.sparkSession)
    span = size * tile
    at = (F.floor(F.col("x") / span), F.floor(F.col("y") / span))
    dealt = df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("value").cast("double").alias("value"))
    dealt = dealt.where(F.col("x").isNotNull() & F.col("y").isNotNull()).repartition(*at)
    options = {"size": str(size), "tile": str(tile), "rows": str(rows), "deflate": str(deflate).lower(), "none": str(none)}
    dealt.write.format("geotiff").options(**options).mode("overwrite").save(path)
