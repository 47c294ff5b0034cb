"""Meshes, snapping, and joins by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def mesh(spark: SparkSession, bounds: tuple[float, float, float, float], size: float = 1000.0, within=None) -> DataFrame:
    """``node_id, ix, iy, easting, northing`` of the aligned cells whose centre lies in the bounds (and ``within``, a predicate of
    easting and northing); ids count along x, then y."""
    x0, y0, x1, y1 = bounds
    n = lambda low, high: (int(low // size), int(-(-high // size)) - 1)
    (i0, i1), (j0, j1) = n(x0, x1), n(y0, y1)
    cells = spark.range(i0, i1 + 1).select(F.col("id").alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(j0).cast("long"), F.lit(j1).cast("long"))))
    cells = cells.withColumns({"easting": (F.col("ix") + 0.5) * size, "northing": (F.col("iy") + 0.5) * size})
    if within is not None:
        cells = cells.where(within(F.col("easting"), F.col("northing")))
    # ids without a global window: cells of the columns before, then place in the column
    counts = cells.groupBy("ix").count()
    before = counts.select("ix", F.coalesce(F.sum("count").over(Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("ix").orderBy("iy")) - 1
    return cells.join(before, "ix").withColumn("node_id", F.col("_before") + place).select("node_id", "ix", "iy", "easting", "northing")


def snap(points: DataFrame, nodes: DataFrame, size: float = 1000.0, x: str = "easting", y: str = "northing") -> DataFrame:
    """Points in a cell, with its node and centre in place of their own coordinates; others drop out."""
    placed = points.withColumns({"_ix": cell(F.col(x), size), "_iy": cell(F.col(y), size)}).drop(x, y)
    target = nodes.select("node_id", F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "easting", "northing")
    return placed.join(target, ["_ix", "_iy"]).drop("_ix", "_iy").dropDuplicates()


def touching(nodes: DataFrame) -> DataFrame:
    """``src, dst`` of cells that share a side or corner, both ways."""
    steps = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)))
    asked = nodes.select(F.col("node_id").alias("src"), "ix", "iy", F.explode(steps).alias("s")).select("src", (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"))
    return asked.join(nodes.select(F.col("node_id").alias("dst"), "ix", "iy"), ["ix", "iy"]).select("src", "dst")


def within_radius(points: DataFrame, radius: float, key: str = "node_id", x: str = "easting", y: str = "northing") -> DataFrame:
    """``src, dst, distance`` with ``0 < distance <= radius``, both ways.

    Cells of the radius' size make it an equi-join with the nine cells around instead of a join of all with all.
    """
    at = points.select(F.col(key).alias("dst"), F.col(x).alias("_x2"), F.col(y).alias("_y2"), cell(F.col(x), radius).alias("_ix"), cell(F.col(y), radius).alias("_iy"))
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = points.select(F.col(key).alias("src"), F.col(x).alias("_x1"), F.col(y).alias("_y1"), F.explode(around).alias("s"))
    asked = asked.withColumns({"_ix": cell(F.col("_x1"), radius) + F.col("s.dx"), "_iy": cell(F.col("_y1"), radius) + F.col("s.dy")})
    distance = F.sqrt((F.col("_x2") - F.col("_x1")) ** 2 + (F.col("_y2") - F.col("_y1")) ** 2)
    return asked.join(at, ["_ix", "_iy"]).withColumn("distance", distance).where((F.col("distance") > 0) & (F.col("distance") <= radius)).select("src", "dst", "distance")


#: Points that a point finds in its own cell at the finest level of a pyramid, about, and its most levels.
PER_CELL, LEVELS = 4, 20


def _around(level: Column, x: Column, y: Column, box: tuple[float, float, float]) -> Column:
    """The nine cells of a level around a place, as structs of ``l, ix, iy``."""
    x0, y0, span = box
    at = lambda c, c0: F.floor((c - c0) / span * F.pow(F.lit(2.0), level)).cast("long")
    return F.array(*(F.struct(level.alias("l"), (at(x, x0) + i).alias("ix"), (at(y, y0) + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def _above(c: str, n: Column) -> Column:
    """A cell's number ``n`` levels above; halving is exact."""
    return F.floor(F.col(c) / F.pow(F.lit(2.0), n)).cast("long")


def _pyramid(base: DataFrame, most: int) -> DataFrame:
    """``l, ix, iy, n``: cells of levels 0 to ``most`` that hold any of ``base``, the counted cells of level ``LEVELS``."""
    every = base.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(most))))
    return every.select("l", _above("ix", LEVELS - F.col("l")).alias("ix"), _above("iy", LEVELS - F.col("l")).alias("iy"), "n").groupBy("l", "ix", "iy").agg(F.sum("n").alias("n"))


def _finest(base: DataFrame) -> int:
    """The first level at which a target's cell holds, on average, no more than twice ``PER_CELL`` beyond those that no level parts from it."""
    square = F.sum(F.col("n").cast("double") * F.col("n"))
    company = {r["l"]: r["n"] for r in _pyramid(base, LEVELS).groupBy("l").agg((square / F.sum("n")).alias("n")).collect()}
    return min(level for level, n in company.items() if n <= company[LEVELS] + 2 * PER_CELL)


def nearest_points(points: DataFrame, k: int, key: str = "node_id", x: str = "easting", y: str = "northing", itself: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """``src, dst, distance, rank`` of the ``k`` nearest targets (ties by id), of all targets if there are fewer.

    Targets are counted in the cells of a pyramid, each level of half the size of the one above, down to the level at which a target shares its
    cell with about ``PER_CELL`` others, however narrow or clustered the targets lie in their box. A point takes the finest level at which
    the nine cells around it hold ``k`` targets; the ``k``-th distance in them bounds the search, and the nine cells of the finest
    level as large as that bound hold every target within it. So rows grow with points and ``k``, not with points times targets;
    targets at one place can't be told apart by cells and are all looked at. Points without coordinates are left out.
    """
    other = (points if targets is None else targets).select(F.col(key).alias("dst"), F.col(x).cast("double").alias("_x2"), F.col(y).cast("double").alias("_y2")).where("_x2 is not null and _y2 is not null")
    asked = points.select(F.col(key).alias("src"), F.col(x).cast("double").alias("_x1"), F.col(y).cast("double").alias("_y1")).where("_x1 is not null and _y1 is not null")
    places = other.select(F.col("_x2").alias("x"), F.col("_y2").alias("y"), F.lit(1).alias("n")).union(asked.select("_x1", "_y1", F.lit(0)))
    row = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.sum("n")).first()
    if not row[4]:
        return asked.where("false").join(other.where("false"), asked["src"].eqNullSafe(other["dst"])).select("src", "dst", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    box = (row[0], row[1], max(row[2] - row[0], row[3] - row[1]) * (1 + 1e-9) or 1.0)
    at = lambda c, c0, l: F.floor((F.col(c) - c0) / box[2] * 2.0**l).cast("long")
    base = other.select(at("_x2", box[0], LEVELS).alias("ix"), at("_y2", box[1], LEVELS).alias("iy")).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    finest = _finest(base)
    level = lambda: F.explode(F.sequence(F.lit(0), F.lit(finest)))
    centre = lambda c, px, py: _around(F.col(c), F.col(px), F.col(py), box)[4]
    least = k + (0 if itself else 1)
    # a cell and its neighbours, where they hold enough
    aside = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    full = _pyramid(base, finest).withColumn("s", aside).select("l", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"), "n")
    full = full.groupBy("l", "ix", "iy").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n")
    asked = asked.withColumns({"_ix": at("_x1", box[0], finest), "_iy": at("_y1", box[1], finest)})
    cells = asked.select("_ix", "_iy").distinct().withColumn("l", level())
    cells = cells.select("_ix", "_iy", "l", _above("_ix", finest - F.col("l")).alias("ix"), _above("_iy", finest - F.col("l")).alias("iy"))
    enough = cells.join(full, ["l", "ix", "iy"]).groupBy("_ix", "_iy").agg(F.max("l").alias("_l"))
    chosen = asked.join(enough, ["_ix", "_iy"], "left").select("src", "_x1", "_y1", F.coalesce("_l", F.lit(0)).alias("_l"))
    placed = other.withColumn("_l", level()).select("dst", "_x2", "_y2", centre("_l", "_x2", "_y2").alias("c"))
    distance = F.sqrt((F.col("_x2") - F.col("_x1")) ** 2 + (F.col("_y2") - F.col("_y1")) ** 2)

    def found(at: DataFrame) -> DataFrame:
        pairs = at.withColumn("c", F.explode(_around(F.col("_l"), F.col("_x1"), F.col("_y1"), box))).join(placed, "c")
        pairs = pairs if itself else pairs.where(F.col("src") != F.col("dst"))
        return pairs.withColumn("distance", distance)

    first = Window.partitionBy("src", "_x1", "_y1").orderBy("distance", "dst")
    bound = found(chosen).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).groupBy("src", "_x1", "_y1").agg(F.max("distance").alias("_r"), F.count(F.lit(1)).alias("n"))
    fit = F.floor(F.log2(F.lit(box[2]) / (F.col("_r") * (1 + 1e-9)))).cast("int")
    wide = F.when(F.col("n") < k, 0).when(F.col("_r") == 0, finest).otherwise(F.greatest(F.lit(0), F.least(F.lit(finest), fit)))
    near = found(bound.withColumn("_l", wide)).where((F.col("distance") <= F.col("_r")) | (F.col("n") < k))
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("src", "dst", "distance", "rank")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a line segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, length), F.lit(0.0))))
    return F.sqrt((px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2)


def nearest_line(points: DataFrame, segments: DataFrame, reach: float = 50000.0, bucket: float = 5000.0, key: str = "node_id") -> DataFrame:
    """``node_id, distance``: to the nearest of ``segments`` (``x1, y1, x2, y2``) within reach, in whole units; infinite if none.

    Segments go to every bucket of their box; points search rings of buckets around them that cover the reach.
    """
    rings = int(-(-reach // bucket))
    low = lambda a, b: cell(F.least(a, b), bucket)
    high = lambda a, b: cell(F.greatest(a, b), bucket)
    placed = segments.withColumn("_bx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("_by", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    asked = points.select(key, F.col("easting").alias("_px"), F.col("northing").alias("_py"))
    asked = asked.withColumn("_dx", F.explode(F.sequence(F.lit(-rings), F.lit(rings)))).withColumn("_dy", F.explode(F.sequence(F.lit(-rings), F.lit(rings))))
    asked = asked.withColumns({"_bx": cell(F.col("_px"), bucket) + F.col("_dx"), "_by": cell(F.col("_py"), bucket) + F.col("_dy")})
    d = segment_distance(*(F.col(c) for c in ("_px", "_py", "x1", "y1", "x2", "y2")))
    found = asked.join(placed, ["_bx", "_by"]).withColumn("_d", d).where(F.col("_d") <= reach).groupBy(key).agg(F.min("_d").alias("_d"))
    return points.select(key).join(found, key, "left").select(key, F.coalesce(F.floor("_d").cast("double"), F.lit(float("inf"))).alias("distance"))


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the ring's edges an odd number of times."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            crossings = crossings + (((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))).cast("int"))
    return crossings % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """As ``in_polygon``, for a column of rings: arrays of (x, y), not closed."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    crossed = F.filter(edges, lambda e: (y >= F.least(e["y1"], e["y2"])) & (y < F.greatest(e["y1"], e["y2"])) & (x < e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    return F.size(crossed) % 2 == 1


def containing(points: DataFrame, shapes: DataFrame, bucket: float = 5000.0, x: str = "easting", y: str = "northing", ring: str = "ring") -> DataFrame:
    """Left join of points with the shapes that contain them: an equi-join on the buckets of a shape's box, then the ray test."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda c: F.explode(F.sequence(cell(F.array_min(c), bucket), cell(F.array_max(c), bucket)))
    placed = shapes.withColumn("_bx", span(xs)).withColumn("_by", span(ys))
    asked = points.withColumns({"_bx": cell(F.col(x), bucket), "_by": cell(F.col(y), bucket)})
    return asked.join(placed, (asked["_bx"] == placed["_bx"]) & (asked["_by"] == placed["_by"]) & in_ring(F.col(x), F.col(y), F.col(ring)), "left").drop("_bx", "_by", ring)


def zonal_means(raster: DataFrame, size: float, values: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``ix, iy`` and the mean of each value over the raster cells whose centre lies in a mesh cell; nulls don't count."""
    return raster.groupBy(cell(F.col(x), size).alias("ix"), cell(F.col(y), size).alias("iy")).agg(*(F.avg(v).alias(v) for v in values))


def zonal_modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, least of ties, nulls left out."""
    return rows.groupBy(key).agg(F.mode(value, True).alias(value))


def all_modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Every most frequent value of each key, sorted."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    top = counts.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("count")))).where("_r = 1")
    return top.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("modes"))


def slope_aspect(dem: DataFrame, size: float = 1.0, ix: str = "ix", iy: str = "iy", z: str = "z") -> DataFrame:
    """``ix, iy, slope`` (degrees)``, aspect_sin, aspect_cos, slope_dx, slope_dy`` of inner cells, from the eight around (Horn, 1981)."""
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    steps = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in around))
    spread = dem.select(ix, iy, z, F.explode(steps).alias("s")).select((F.col(ix) - F.col("s.dx")).alias(ix), (F.col(iy) - F.col("s.dy")).alias(iy), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), z)
    east = {-1: -1, 0: 0, 1: 1}
    weight = lambda i, j: (2 if j == 0 else 1) * east[i]
    gx = sum((F.when((F.col("dx") == i) & (F.col("dy") == j), weight(i, j) * F.col(z)).otherwise(0.0) for i, j in around), F.lit(0.0))
    gy = sum((F.when((F.col("dx") == i) & (F.col("dy") == j), weight(j, i) * F.col(z)).otherwise(0.0) for i, j in around), F.lit(0.0))
    grads = spread.groupBy(ix, iy).agg((F.sum(gx) / (8 * size)).alias("gx"), (F.sum(gy) / (8 * size)).alias("gy"), F.count(z).alias("_n")).where("_n = 8")
    cells = dem.select(ix, iy).join(grads, [ix, iy])
    steep = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)
    sine, cosine = (F.when(steep > 0, -F.col(g) / steep).otherwise(0.0) for g in ("gx", "gy"))
    return cells.select(ix, iy, F.degrees(F.atan(steep)).alias("slope"), sine.alias("aspect_sin"), cosine.alias("aspect_cos"), (sine * steep).alias("slope_dx"), (cosine * steep).alias("slope_dy"))


def mosaic(tiles: Sequence[DataFrame], keys: Sequence[str] = ("x", "y"), value: str = "value") -> DataFrame:
    """Union of rasters; where several have a cell, the first has it."""
    parts = [t.select(*keys, value, F.lit(i).alias("_tile")) for i, t in enumerate(tiles)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, "_tile").alias(value))


def area_weighted(cube: DataFrame, area: Column, time: str = "time", value: str = "value", cells: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """``time, total, mean``: over the cells that have a value at the first time."""
    first = cube.agg(F.min(time).alias("_t0"))  # one row
    mask = cube.crossJoin(F.broadcast(first)).where((F.col(time) == F.col("_t0")) & F.col(value).isNotNull()).select(*cells)
    kept = cube.join(mask, list(cells), "left_semi").withColumn("_area", area)
    return kept.groupBy(time).agg(F.sum(F.col(value) * F.col("_area")).alias("total"), F.try_divide(F.sum(F.col(value) * F.col("_area")), F.sum(F.when(F.col(value).isNotNull(), F.col("_area")))).alias("mean"))


def clip_segments(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Parts of segments (``x1, y1, x2, y2``) inside a box, by Liang and Barsky's parameters; those outside drop out."""
    left, bottom, right, top = box
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, F.col("x1") - left), (dx, right - F.col("x1")), (-dy, F.col("y1") - bottom), (dy, top - F.col("y1"))):
        r = F.when(p != 0, q / p)
        enter = F.when(p < 0, F.greatest(enter, r)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, r)).otherwise(leave)
        outside = outside | ((p == 0) & (q < 0))
    cut = segments.withColumns({"_a": enter, "_b": leave, "_out": outside}).where(~F.col("_out") & (F.col("_a") <= F.col("_b")))
    at = lambda c, d, t: F.col(c) + F.col(t) * d
    return cut.withColumns({"_x1": at("x1", dx, "_a"), "_y1": at("y1", dy, "_a"), "_x2": at("x1", dx, "_b"), "_y2": at("y1", dy, "_b")}).drop("x1", "y1", "x2", "y2", "_a", "_b", "_out").withColumnsRenamed({"_x1": "x1", "_y1": "y1", "_x2": "x2", "_y2": "y2"})
