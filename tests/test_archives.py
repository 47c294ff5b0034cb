"""GeoTIFF, NetCDF and GRIB: round trips, files made by hand, and what is opened under bounds."""

from __future__ import annotations

import datetime as dt
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.sources import files, geotiff, grib, netcdf, tables

NONE = -9999.0


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def grid_values():
    draw = np.random.default_rng(4)
    cells = draw.integers(-50, 50, (37, 53)).astype(np.float64)
    cells[draw.random(cells.shape) < 0.2] = NONE
    return cells


def expected(cells, x0, y0, size):
    return sorted((x0 + (c + 0.5) * size, y0 - (r + 0.5) * size, float(v)) for (r, c), v in np.ndenumerate(cells) if v != NONE)


@pytest.mark.parametrize("kind", ["f8", "f4", "i4", "i2"])
@pytest.mark.parametrize("deflate", [True, False])
def test_strips(spark, tmp_path, grid_values, kind, deflate):
    (tmp_path / "a.tif").write_bytes(geotiff.tiff_bytes(grid_values.astype(kind), 100.0, 900.0, 10.0, NONE, rows=5, deflate=deflate))
    got = geotiff.read_geotiff(spark, f"file://{tmp_path}/a.tif")
    assert rows(got, "x", "y", "value") == expected(grid_values, 100.0, 900.0, 10.0)


def packed(data):
    out = b""
    while data:
        run = len(data) - len(data.lstrip(data[:1]))
        if run > 2:
            out, data = out + bytes([257 - min(run, 128)]) + data[:1], data[min(run, 128) :]
        else:
            out, data = out + bytes([min(len(data), 3) - 1]) + data[:3], data[3:]
    return out


def lzw(data):
    """Codes of growing width, written by the format's own rule."""
    table, codes, width, word = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b""
    following = 258
    for b in data:
        b = bytes([b])
        if word + b in table:
            word += b
            continue
        codes.append((table[word], width))
        table[word + b] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4095:
            codes.append((256, width))
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = b
    codes += [(table[word], width)]
    following += 1
    width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def tiff(tags, blocks, order=">", big=False):
    """A file from its tags (number: type, values); blocks go first, and ``offsets`` stands for where they begin."""
    kinds, count = {3: "H", 4: "I", 12: "d", 2: "c", 16: "Q"}, "Q" if big else "I"
    at, begins, body = 16, [], b""
    for b in blocks:
        begins.append(at + len(body))
        body += b
    start = at + len(body)
    entries, more, inline = b"", b"", 8 if big else 4
    beyond = start + (8 if big else 2) + (20 if big else 12) * len(tags) + inline
    for tag, (kind, v) in sorted(tags.items()):
        v = begins if v == "offsets" else v
        raw = struct.pack(f"{order}{len(v)}{kinds[kind]}", *v)
        if len(raw) > inline:
            raw, more = struct.pack(order + count, beyond + len(more)), more + raw
        entries += struct.pack(f"{order}HH{count}", tag, kind, len(v)) + raw.ljust(inline, b"\0")
    head = struct.pack(order + ("2sHHHQ" if big else "2sHI8x"), b"MM" if order == ">" else b"II", *((43, 8, 0, start) if big else (42, start)))
    return head + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * inline + more


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression, code", [(1, bytes), (8, zlib.compress), (5, lzw), (32773, packed)])
def test_tiles_bands_and_predictors(spark, tmp_path, order, compression, code):
    """Two bands of 40 by 24 cells in tiles of 16 by 16, side by side and apart, with differences, by either byte order."""
    draw = np.random.default_rng(compression)
    bands = np.minimum(draw.integers(0, 900, (2, 24, 40)), 300).astype("u2")
    wide = np.zeros((2, 32, 48), "u2")
    wide[:, :24, :40] = bands
    tiles = [wide[:, r : r + 16, c : c + 16] for r in (0, 16) for c in (0, 16, 32)]
    difference = lambda t: np.diff(t, axis=-1, prepend=np.zeros((*t.shape[:-1], 1), t.dtype)).astype(t.dtype)
    raw = lambda t: t.astype(order + "u2").tobytes()
    together = [code(raw(np.moveaxis(difference(t), 0, -1))) for t in tiles]
    apart = [code(raw(t[b])) for b in (0, 1) for t in tiles]
    place = [(33922, (12, [0.0, 0, 0, 50.0, 80.0, 0])), (33550, (12, [2.0, 4.0, 0.0]))]
    for big, planar, predictor, blocks in ((False, 1, 2, together), (True, 2, 1, apart)):
        long = 16 if big else 4
        tags = {256: (3, [40]), 257: (3, [24]), 258: (3, [16, 16]), 259: (3, [compression]), 277: (3, [2]), 284: (3, [planar]), 317: (3, [predictor]), 322: (3, [16]), 323: (3, [16]), 324: (long, "offsets"), 325: (long, [len(b) for b in blocks]), **dict(place)}
        (tmp_path / "t.tif").write_bytes(tiff(tags, blocks, order, big))
        for band in (1, 2):
            got = geotiff.read_geotiff(spark, str(tmp_path / "t.tif"), band=band, cells=300)
            assert rows(got, "x", "y", "value") == sorted((50 + (c + 0.5) * 2, 80 - (r + 0.5) * 4, float(v)) for (r, c), v in np.ndenumerate(bands[band - 1]))


def test_bounds_decide_which_strips_are_opened(spark, tmp_path, grid_values):
    for name, x0 in (("a", 100.0), ("b", 5000.0)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.tiff_bytes(grid_values, x0, 900.0, 10.0, NONE, rows=5))
    options = {"path": str(tmp_path), "pushdown": "true"}
    reader = geotiff._PushingReader({**options})
    assert sum(len(p.blocks) for p in reader.partitions()) == 16  # 8 strips a file
    bounds = (("x", "<", 400.0), ("y", ">=", 700.0), ("y", "<", 800.0))
    kinds = {"<": geotiff.Filter.__subclasses__()[4], ">=": geotiff.Filter.__subclasses__()[3]}
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    assert kinds == {"<": LessThan, ">=": GreaterThanOrEqual}
    filters = [kinds[o]((c,), v) for c, o, v in bounds]
    assert list(reader.pushFilters(filters)) == filters  # Spark still evaluates them
    held = [b for p in reader.partitions() for b in p.blocks]
    assert [i for i, _, _ in held] == [2, 3] and {p.grid.place for p in reader.partitions()} == {f"{tmp_path}/a.tif"}
    got = geotiff.read_geotiff(spark, str(tmp_path)).where("x < 400 and y >= 700 and y < 800")
    assert got.rdd.getNumPartitions() == 1
    assert rows(got, "x", "y", "value") == [v for v in expected(grid_values, 100.0, 900.0, 10.0) if v[0] < 400 and 700 <= v[1] < 800]
    assert geotiff.read_geotiff(spark, str(tmp_path)).where("x < 0").count() == 0


def test_geotiff_sink(spark, tmp_path):
    draw = random.Random(2)
    cells = {(draw.randrange(-90, 90), draw.randrange(-90, 90)): draw.random() for _ in range(3000)}
    df = spark.createDataFrame([((i + 0.5) * 5, (j + 0.5) * 5, v) for (i, j), v in cells.items()] + [(1000.0, 3.0, None), (None, 1.0, 1.0)], "x double, y double, value double")
    place = f"file://{tmp_path}/out"
    for _ in range(2):  # a second run replaces the first
        geotiff.write_geotiff(df.repartition(5), place, 5.0, tile=40, rows=7)
        assert rows(geotiff.read_geotiff(spark, place), "x", "y", "value") == sorted(((i + 0.5) * 5, (j + 0.5) * 5, v) for (i, j), v in cells.items())
    geotiff.write_geotiff(df.where("x < 0"), place, 5.0, tile=40)
    assert rows(geotiff.read_geotiff(spark, place), "x", "y") == sorted(((i + 0.5) * 5, (j + 0.5) * 5) for i, j in cells if i < 0)
    geotiff.register(spark)
    with pytest.raises(Exception, match="two partitions"):
        df.where("value is not null").repartition(3).write.format("geotiff").option("size", "5").mode("append").save(place)
    assert not list((tmp_path / "out" / "_staging").iterdir())


def test_damaged_grids_are_told(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"not a grid at all")
    with pytest.raises(Exception, match="TIFF"):
        geotiff.read_geotiff(spark, str(tmp_path)).count()
    assert geotiff.read_geotiff(spark, str(tmp_path / "nothing")) is not None


def months(spark, n=4000, seed=1):
    draw = random.Random(seed)
    start = dt.datetime(2001, 11, 3)
    held = {(start + dt.timedelta(hours=draw.randrange(24 * 100)), 50.0 + draw.randrange(12) / 4, -3.0 + draw.randrange(9) / 4): round(draw.uniform(-9, 9), 3) for _ in range(n)}
    return held, spark.createDataFrame([(t, y, x, v) for (t, y, x), v in held.items()], "time timestamp, y double, x double, value double")


@pytest.mark.parametrize("kind", ["netcdf", "grib"])
def test_month_files_round_trip(spark, tmp_path, kind):
    held, df = months(spark)
    place = f"file://{tmp_path}/{kind}"
    write, read, suffix = (netcdf.write_netcdf, netcdf.read_netcdf, "nc") if kind == "netcdf" else (grib.write_grib, grib.read_grib, "grib")
    for _ in range(2):
        write(df.repartition(4), place, "p")
    assert [p.rpartition("/")[2] for p in files.listed(place)] == [f"p_2001_11.{suffix}", f"p_2001_12.{suffix}", f"p_2002_1.{suffix}", f"p_2002_2.{suffix}"]
    got = read(spark, place, cells=500)
    assert got.rdd.getNumPartitions() > 10
    close = sorted((t, y, x, round(v, 6)) for t, y, x, v in rows(got, "time", "y", "x", "value"))
    assert close == sorted((t, y, x, v) for (t, y, x), v in held.items())
    low, high = dt.datetime(2001, 12, 5), dt.datetime(2002, 1, 2, 5)
    some = read(spark, place, cells=500).where((F.col("time") >= low) & (F.col("time") < high) & (F.col("y") <= 51.0) & F.col("x").isin(-3.0, -2.5))
    assert some.rdd.getNumPartitions() < got.rdd.getNumPartitions() / 2
    assert sorted(r[:3] for r in rows(some, "time", "y", "x")) == sorted(k for k in held if low <= k[0] < high and k[1] <= 51.0 and k[2] in (-3.0, -2.5))
    write(df.where(F.month("time") == 1), place, "p", append=True)
    assert len(files.listed(place)) == 4
    write(df.where(F.month("time") == 1), place, "p")
    assert len(files.listed(place)) == 1


def test_only_wanted_bytes_are_read(tmp_path):
    grid = np.arange(40 * 60.0).reshape(40, 60)
    at = [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    (tmp_path / "a_2000_1.nc").write_bytes(b"".join(netcdf.netcdf_chunks("v", at, np.arange(40.0), np.arange(60.0), [grid + i for i in range(30)])))
    reader = netcdf._Reader({"path": str(tmp_path), "time_min": "2000-01-10", "time_max": "2000-01-11", "y_min": "5", "y_max": "6"})
    (part,) = reader.partitions()
    assert part.steps == [9, 10] and part.rows == (5, 7)
    got = [b.to_pydict() for b in reader.read(part)]
    assert [sorted(set(b["y"])) for b in got] == [[5.0, 6.0]] * 2 and got[1]["value"] == (grid[5:7] + 10).ravel().tolist()
    (tmp_path / "b.grib").write_bytes(b"\0\0junk" + b"".join(grib.grib_chunks(at, np.arange(40.0), np.arange(60.0), [grid + i for i in range(30)])))
    with files.ranges(str(tmp_path / "b.grib")) as read:
        index = list(grib.messages(read))
        assert [m.time for m in index] == at and read.taken < read.size / 2
        y, x, cells = grib.decode(index[7], read)
    assert y.tolist() == list(range(40)) and np.abs(cells - grid - 7).max() < 1e-5


def classic(version, turned=False, stream=False):
    """A file as other writers make them: packed shorts, hours since, a second record variable, either order of axes."""
    count, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    n = lambda v: struct.pack(count, v)
    text = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    axes = [("lat", 3), ("lon", 2)]
    dims = [("time", 0), *(axes[::-1] if turned else axes)]
    head = b"CDF" + bytes([version]) + (b"\xff" * len(n(0)) if stream else n(2)) + struct.pack(">i", 10) + n(3) + b"".join(text(d) + n(s) for d, s in dims)
    head += struct.pack(">i", 12) + n(1) + text("title") + struct.pack(">i", 2) + text("made by hand")
    number = lambda name, kind, code, v: text(name) + struct.pack(">i", kind) + n(1) + struct.pack(">" + code, v) + b"\0" * (-struct.calcsize(code) % 4)
    place = {d: i for i, (d, _) in enumerate(dims)}
    variables = [("lat", ["lat"], [], 5, 12), ("lon", ["lon"], [], 5, 8), ("time", ["time"], [text("units") + struct.pack(">i", 2) + text("hours since 1900-01-01 00:00:0.0")], 4, 4)]
    variables.append(("t2m", [d for d, _ in dims], [number("scale_factor", 6, "d", 0.5), number("add_offset", 6, "d", 270.0), number("_FillValue", 3, "h", -32767)], 3, 12))
    listing = lambda begins: struct.pack(">i", 11) + n(4) + b"".join(text(v) + n(len(own)) + b"".join(n(place[d]) for d in own) + (struct.pack(">i", 12) + n(len(a)) + b"".join(a) if a else struct.pack(">i", 0) + n(0)) + struct.pack(">i", kind) + n(size) + struct.pack(offset, b) for (v, own, a, kind, size), b in zip(variables, begins))
    first = len(head) + len(listing([0] * 4))
    data = np.array([53.5, 53.25, 53.0], ">f4").tobytes() + np.array([-3.0, -2.5], ">f4").tobytes()
    cells = np.array([[[1, 2], [3, -32767], [5, 6]], [[7, 8], [9, 10], [11, 12]]], ">i2")
    for i, hour in enumerate((990_000, 990_001)):
        data += struct.pack(">i", hour) + (cells[i].T if turned else cells[i]).tobytes()
    return head + listing([first, first + 12, first + 20, first + 24]) + data


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("turned, stream", [(False, False), (True, False), (False, True)])
def test_classic_files_of_others(spark, tmp_path, version, turned, stream):
    (tmp_path / "era_2012_12.nc").write_bytes(classic(version, turned, stream))
    start = dt.datetime(1900, 1, 1) + dt.timedelta(hours=990_000)
    wanted = sorted((start + dt.timedelta(hours=t), y, x, 270 + (6 * t + 2 * i + j + 1) / 2) for t in (0, 1) for i, y in enumerate((53.5, 53.25, 53.0)) for j, x in enumerate((-3.0, -2.5)) if (t, i, j) != (0, 1, 1))
    assert rows(netcdf.read_netcdf(spark, str(tmp_path)), "time", "y", "x", "value") == wanted
    assert rows(netcdf.read_netcdf(spark, str(tmp_path), "t2m").where("y < 53.5 and x = -2.5"), "value") == sorted((v,) for _, y, x, v in wanted if y < 53.5 and x == -2.5)


def test_rows_of_another_month_and_damaged_files(spark, tmp_path):
    held, df = months(spark, 300)
    place = f"file://{tmp_path}/m"
    netcdf.write_netcdf(df, place, "p")
    (tmp_path / "m" / "p_2001_11.nc").rename(tmp_path / "m" / "p_2001_12.nc")  # a file that holds another month
    (tmp_path / "m" / "q_2001_12.nc").write_bytes(b"CDF\x02\0")
    with pytest.raises(Exception, match="cut off"):
        netcdf.read_netcdf(spark, place).count()
    got = tables.of_own_month(netcdf.read_netcdf(spark, place, skip_damaged=True), prefix="p")
    assert rows(got, "time", "y", "x") == sorted(k for k in held if k[0].year == 2002)


def first_edition(values, bits, binary, decimal, bitmap=None):
    """A message of edition 1 by hand: 3 by 2 cells from 53.5 N, 3 W."""
    three = lambda v: ((1 << 23) * (v < 0) | abs(v)).to_bytes(3, "big")
    pds = bytes([0, 0, 28, 128, 98, 1, 255, 128 | (64 if bitmap else 0), 167, 1, 0, 0, 12, 6, 30, 18, 0, 1, 5, 0, 0, 0, 0, 0, 21, 0]) + struct.pack(">H", 1 << 15 | -decimal if decimal < 0 else decimal)
    gds = bytes([0, 0, 32, 0, 255, 0, 0, 2, 0, 3]) + three(53500) + three(-3000) + b"\x80" + three(53000) + three(-2500) + struct.pack(">HHB", 500, 250, 0) + b"\0" * 4
    bms = b""
    if bitmap:
        raw = np.packbits(bitmap).tobytes()
        bms = (6 + len(raw)).to_bytes(3, "big") + bytes([8 * len(raw) - len(bitmap), 0, 0]) + raw
    stream = int("".join(f"{v:0{bits}b}" for v in values).ljust(-(-len(values) * bits // 8) * 8, "0"), 2).to_bytes(-(-len(values) * bits // 8), "big")
    bds = (11 + len(stream)).to_bytes(3, "big") + b"\0" + struct.pack(">H", 1 << 15 | -binary if binary < 0 else binary) + b"\x42\x64\x00\x00" + bytes([bits]) + stream  # 100 in base 16
    body = pds + gds + bms + bds + b"7777"
    return b"GRIB" + (len(body) + 8).to_bytes(3, "big") + b"\1" + body


@pytest.mark.parametrize("bits", [8, 12, 5])
def test_first_edition(spark, tmp_path, bits):
    (tmp_path / "a.grib").write_bytes(first_edition([1, 2, 3, 4, 5, 6], bits, -1, 0) + first_edition([7, 9, 11], bits, 1, 1, [1, 0, 1, 0, 0, 1]))
    at = dt.datetime(2012, 6, 30, 23)
    places = [(y, x) for y in (53.5, 53.25, 53.0) for x in (-3.0, -2.5)]
    wanted = [(at, *p, 100 + v / 2) for p, v in zip(places, range(1, 7))] + [(at, *places[i], (100 + 2 * v) / 10) for i, v in ((0, 7), (2, 9), (5, 11))]
    assert rows(grib.read_grib(spark, str(tmp_path), "167"), "time", "y", "x", "value") == sorted(wanted)
    assert grib.read_grib(spark, str(tmp_path), "168").count() == 0
