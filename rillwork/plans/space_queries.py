"""Meshes, places and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..functions import scalars as S
from ..operators import baselines, graphs, polygons, selection, spatial
from .registry import SERIES, STATIONS, query, r, series, stations, stored, table

#: Corners of an area, as shares of the box around all stations.
_RING = [(0.05, 0.05), (0.95, 0.15), (0.85, 0.9), (0.3, 0.75)]


def _crossings(x: str, y: str) -> str:
    corner = lambda fx, fy: (f"(x0 + {fx!r}::DOUBLE * w)", f"(y0 + {fy!r}::DOUBLE * h)")
    edges = zip(_RING, [*_RING[1:], _RING[0]])
    sides = ((*corner(*p), *corner(*q)) for p, q in edges)
    return " + ".join(f"({y} >= least({b}, {e}) AND {y} < greatest({b}, {e}) AND {x} < {a} + ({y} - {b}) * (({c} - {a}) / ({e} - {b})))::INT" for a, b, c, e in sides)


_MESH = f"""{STATIONS}, bounds AS (SELECT x0, y0, x1 - x0 AS w, y1 - y0 AS h, x1, y1 FROM (SELECT floor(min(easting) / 1000) * 1000.0::DOUBLE AS x0, floor(min(northing) / 1000) * 1000.0::DOUBLE AS y0,
    (floor(max(easting) / 1000) + 1) * 1000.0::DOUBLE AS x1, (floor(max(northing) / 1000) + 1) * 1000.0::DOUBLE AS y1 FROM stations)),
  cells AS (SELECT ix, iy, (ix + 0.5::DOUBLE) * 1000 AS easting, (iy + 0.5::DOUBLE) * 1000 AS northing FROM (SELECT unnest(range((x0 // 1000)::BIGINT, (x1 // 1000)::BIGINT)) AS ix FROM bounds), (SELECT unnest(range((y0 // 1000)::BIGINT, (y1 // 1000)::BIGINT)) AS iy FROM bounds)),
  mesh AS (SELECT row_number() OVER (ORDER BY ix, iy) - 1 AS node_id, ix, iy, easting, northing FROM cells, bounds WHERE ({_crossings('easting', 'northing')}) % 2 = 1)"""
# heights and slopes of nodes, made up from their places
_NODES = "nodes AS (SELECT node_id, easting, northing, 100 + easting / 97.0::DOUBLE + northing * northing / 1e6::DOUBLE AS elevation, sin(easting / 3000) AS slope_dx, cos(northing / 2000) AS slope_dy FROM mesh)"


def _bounds(spark: SparkSession, d: str) -> tuple[float, float, float, float]:
    """Whole kilometres around all stations."""
    side = lambda f, c, more: (F.floor(f(c) / 1000) + more) * 1000.0
    return tuple(stations(spark, d).agg(side(F.min, "easting", 0), side(F.min, "northing", 0), side(F.max, "easting", 1), side(F.max, "northing", 1)).first())


def _mesh(spark: SparkSession, d: str) -> DataFrame:
    x0, y0, x1, y1 = bounds = _bounds(spark, d)
    ring = [(x0 + fx * (x1 - x0), y0 + fy * (y1 - y0)) for fx, fy in _RING]
    return spatial.mesh(spark, bounds, 1000.0, lambda x, y: spatial.in_polygon(x, y, ring))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    e, n = F.col("easting"), F.col("northing")
    return _mesh(spark, d).withColumns({"elevation": 100 + e / 97.0 + n * n / 1e6, "slope_dx": F.sin(e / 3000), "slope_dy": F.cos(n / 2000)})


@query(f"WITH {_MESH} SELECT node_id, ix, iy, easting, northing FROM mesh")
def g05_g03_mesh(spark: SparkSession, d: str) -> DataFrame:
    return _mesh(spark, d)


@query(f"WITH {_MESH} SELECT s.station, m.node_id, m.easting, m.northing FROM stations s JOIN mesh m ON floor(s.easting / 1000) = m.ix AND floor(s.northing / 1000) = m.iy")
def g13_j10_snap(spark: SparkSession, d: str) -> DataFrame:
    return spatial.snap(stations(spark, d).select("station", "easting", "northing"), _mesh(spark, d)).select("station", "node_id", "easting", "northing")


@query(f"WITH {_MESH} SELECT m.node_id, count(s.station) AS n FROM mesh m LEFT JOIN stations s ON s.easting >= m.easting - 500 AND s.easting < m.easting + 500 AND s.northing >= m.northing - 500 AND s.northing < m.northing + 500 GROUP BY ALL")
def j11_mesh_contains(spark: SparkSession, d: str) -> DataFrame:
    """Stations in each mesh cell, by the cell that their place names."""
    at = stations(spark, d).select("station", spatial.cell(F.col("easting"), 1000.0).alias("ix"), spatial.cell(F.col("northing"), 1000.0).alias("iy"))
    return _mesh(spark, d).join(at, ["ix", "iy"], "left").groupBy("node_id").agg(F.count("station").alias("n"))


@query(f"WITH {_MESH} SELECT a.node_id AS src, b.node_id AS dst FROM mesh a JOIN mesh b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.node_id <> b.node_id")
def j12_touching(spark: SparkSession, d: str) -> DataFrame:
    return spatial.touching(_mesh(spark, d))


@query(f"WITH {STATIONS}, p AS (SELECT a.node_id AS src, b.node_id AS dst, sqrt(pow(b.easting - a.easting, 2) + pow(b.northing - a.northing, 2)) AS distance FROM stations a, stations b) SELECT src, dst, round(distance, 6) AS distance FROM p WHERE distance > 0 AND distance <= 2500")
def j16_within_radius(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_radius(stations(spark, d), 2500.0).select("src", "dst", r("distance"))


@query(f"WITH {STATIONS}, p AS (SELECT a.node_id AS src, b.node_id AS dst, sqrt(pow(b.easting - a.easting, 2) + pow(b.northing - a.northing, 2)) AS distance FROM stations a, stations b) SELECT src, dst, round(distance, 6) AS distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p QUALIFY rank <= 3")
def j24_nearest_three(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_points(stations(spark, d), 3, itself=True).select("src", "dst", r("distance"), F.col("rank").cast("long").alias("rank"))


# a river from each fifth station to the next
_SEG = "seg AS (SELECT * FROM (SELECT easting AS x1, northing AS y1, lead(easting) OVER w AS x2, lead(northing) OVER w AS y2 FROM stations WHERE node_id % 5 = 0 WINDOW w AS (ORDER BY node_id)) WHERE x2 IS NOT NULL)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    at = stations(spark, d).where("node_id % 5 = 0").select("node_id", "easting", "northing")
    following = at.select((F.col("node_id") - 5).alias("node_id"), F.col("easting").alias("x2"), F.col("northing").alias("y2"))
    return at.withColumnsRenamed({"easting": "x1", "northing": "y1"}).join(following, "node_id").select("x1", "y1", "x2", "y2")


@query(f"""WITH {_MESH}, {_SEG},
  t AS (SELECT node_id, easting AS px, northing AS py, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((easting - x1) * (x2 - x1) + (northing - y1) * (y2 - y1))::DOUBLE / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM mesh, seg)
SELECT node_id, floor(min(sqrt(pow(px - (x1 + t * dx), 2) + pow(py - (y1 + t * dy), 2)))) AS distance FROM t GROUP BY node_id""")
def g12_j15_nearest_line(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_line(_mesh(spark, d), _segments(spark, d), 20000.0)


@query(f"""WITH {_MESH}, {_SEG}, box AS (SELECT x0 + w / 8 AS l, y0 AS b, x0 + w * 5 / 8 AS r, y0 + h * 3 / 4 AS t FROM bounds),
  s AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM seg, box),
  cut AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN dx > 0 THEN (l - x1) / dx WHEN dx < 0 THEN (r - x1) / dx END, CASE WHEN dy > 0 THEN (b - y1) / dy WHEN dy < 0 THEN (t - y1) / dy END) AS enter,
    least(1.0::DOUBLE, CASE WHEN dx > 0 THEN (r - x1) / dx WHEN dx < 0 THEN (l - x1) / dx END, CASE WHEN dy > 0 THEN (t - y1) / dy WHEN dy < 0 THEN (b - y1) / dy END) AS leave FROM s WHERE (dx <> 0 OR x1 BETWEEN l AND r) AND (dy <> 0 OR y1 BETWEEN b AND t))
SELECT round(x1 + enter * dx, 6) AS x1, round(y1 + enter * dy, 6) AS y1, round(x1 + leave * dx, 6) AS x2, round(y1 + leave * dy, 6) AS y2 FROM cut WHERE enter <= leave""")
def j14_clip_lines(spark: SparkSession, d: str) -> DataFrame:
    x0, y0, x1, y1 = _bounds(spark, d)
    out = spatial.clip_segments(_segments(spark, d), (x0 + (x1 - x0) / 8, y0, x0 + (x1 - x0) * 5 / 8, y0 + (y1 - y0) * 3 / 4))
    return out.select(r("x1"), r("y1"), r("x2"), r("y2"))


_SHAPES = [("clay", [(0.0, 0.0), (6000.0, 0.0), (6000.0, 6000.0), (0.0, 6000.0)]), ("sand", [(5000.0, 2000.0), (9900.0, 5000.0), (5000.0, 9000.0)])]


def _in_shape(ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, [*ring[1:], ring[0]])
    return "(" + " + ".join(f"(northing >= {min(b, e)} AND northing < {max(b, e)} AND easting < {a} + (northing - {b}) * ({c - a}::DOUBLE) / ({e - b}))::INT" for (a, b), (c, e) in edges if b != e) + ") % 2 = 1"


def _shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in ring]) for n, ring in _SHAPES], "kind string, ring array<struct<x: double, y: double>>")


@query(f"WITH {STATIONS}, m AS (" + " UNION ALL ".join(f"SELECT station, '{n}' AS kind FROM stations WHERE {_in_shape(ring)}" for n, ring in _SHAPES) + ") SELECT station, kind FROM stations LEFT JOIN m USING (station)")
def j13_g10_containing(spark: SparkSession, d: str) -> DataFrame:
    return spatial.containing(stations(spark, d), _shapes(spark), 2000.0).select("station", "kind")


@query(f"WITH {STATIONS}, m AS (" + " UNION ALL ".join(f"SELECT station, node_id % 4 AS zone, '{n}' AS kind FROM stations WHERE {_in_shape(ring)}" for n, ring in _SHAPES) + "), c AS (SELECT zone, kind, count(*) AS n FROM m GROUP BY ALL) SELECT zone, arg_min(kind, (-n, kind)) AS kind FROM c GROUP BY zone")
def g11_zonal_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial.containing(stations(spark, d), _shapes(spark), 2000.0).select((F.col("node_id") % 4).alias("zone"), "kind").where("kind is not null")
    return spatial.zonal_modes(rows, "zone", "kind")


@query("SELECT CAST(floor((p_partkey % 100 * 35.0) / 1000) AS BIGINT) AS ix, CAST(floor((p_partkey // 100 * 35.0) / 1000) AS BIGINT) AS iy, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY ALL")
def a07_zonal_means(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 100 * 35.0).alias("x"), (F.floor(F.col("p_partkey") / 100) * 35.0).alias("y"), "p_retailprice")
    return spatial.zonal_means(p, 1000.0, ["p_retailprice"]).select("ix", "iy", r("p_retailprice"))


@query("""WITH dem AS (SELECT p_partkey % 40 AS ix, p_partkey // 40 AS iy, p_size * 1.0::DOUBLE AS z FROM part),
  g AS (SELECT c.ix, c.iy, sum(z_w.z * CASE WHEN z_w.iy = c.iy THEN 2 ELSE 1 END * (z_w.ix - c.ix)) / (8 * 25) AS gx, sum(z_w.z * CASE WHEN z_w.ix = c.ix THEN 2 ELSE 1 END * (z_w.iy - c.iy)) / (8 * 25) AS gy
    FROM dem c JOIN dem z_w ON abs(z_w.ix - c.ix) <= 1 AND abs(z_w.iy - c.iy) <= 1 AND NOT (z_w.ix = c.ix AND z_w.iy = c.iy) GROUP BY ALL HAVING count(*) = 8)
SELECT ix, iy, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope, round(CASE WHEN gx * gx + gy * gy > 0 THEN -gx / sqrt(gx * gx + gy * gy) ELSE 0 END, 6) + 0.0 AS aspect_sin, round(-gy, 6) + 0.0 AS slope_dy FROM g""")
def g08_slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    dem = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("ix"), F.floor(F.col("p_partkey") / 40).alias("iy"), (F.col("p_size") * 1.0).alias("z"))
    out = spatial.slope_aspect(dem, 25.0)
    return out.select("ix", "iy", r("slope"), (F.round("aspect_sin", 6) + 0.0).alias("aspect_sin"), (F.round("slope_dy", 6) + 0.0).alias("slope_dy"))


@query("""WITH s AS (SELECT degrees(atan(p_size / 10.0)) AS v, p_partkey, p_partkey % 5 = 0 AS gone FROM part), m AS (SELECT median(v) AS m FROM s WHERE NOT gone)
SELECT p_partkey, round(greatest(least(CASE WHEN gone THEN m ELSE v END, 75), 8), 6) AS slope FROM s, m""")
def g09_fill_and_cap(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.degrees(F.atan(F.col("p_size") / 10.0))).alias("v"))
    filled = s.crossJoin(F.broadcast(s.agg(F.percentile("v", F.lit(0.5)).alias("m")))).select("p_partkey", F.coalesce("v", "m").alias("v"))
    return filled.select("p_partkey", r(S.clip(F.col("v"), 8.0, 75.0)).alias("slope"))


@query("WITH t AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_retailprice AS v, 0 AS n FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey % 50, p_partkey // 50, -1.0, 1 FROM part) SELECT x, y, arg_min(v, n) AS value FROM t GROUP BY ALL")
def s15_mosaic(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("x"), F.floor(F.col("p_partkey") / 50).alias("y"), F.col("p_retailprice").alias("value"), "p_partkey")
    return spatial.mosaic([p.where("p_partkey % 3 > 0"), p.withColumn("value", F.lit(-1.0))])


_CUBE = "cube AS (SELECT CAST(l_shipdate AS DATE) AS time, 54 + l_suppkey % 10 * 0.1::DOUBLE AS lat, CAST(l_suppkey // 10 AS INTEGER) AS lon, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def _cube(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("time"), (54 + F.col("l_suppkey") % 10 * 0.1).alias("lat"), F.floor(F.col("l_suppkey") / 10).cast("int").alias("lon")).agg(F.avg("l_quantity").alias("value"))


@query(f"""WITH {_CUBE}, mask AS (SELECT lat, lon FROM cube WHERE time = (SELECT min(time) FROM cube)),
  w AS (SELECT time, value, pow(6371000.0::DOUBLE, 2) * radians(0.1::DOUBLE) * (sin(radians(lat + 0.05::DOUBLE)) - sin(radians(lat - 0.05::DOUBLE))) AS a FROM cube SEMI JOIN mask USING (lat, lon))
SELECT time, round(sum(value * a) / 1e6, 2) AS total, round(sum(value * a) / sum(a), 6) AS mean FROM w GROUP BY time""")
def a09_g06_g07_area_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.area_weighted(_cube(spark, d), S.cell_area(F.col("lat"), 0.1, 0.1))
    return out.select("time", F.round(F.col("total") / 1e6, 2).alias("total"), r("mean"))


@query(f"WITH {_CUBE} SELECT time, round(sum(value), 6) AS total FROM cube GROUP BY time")
def a08_grid_total(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).groupBy("time").agg(F.round(F.sum("value"), 6).alias("total"))


_TOUCH = "touch AS (SELECT a.node_id AS src, b.node_id AS dst FROM mesh a JOIN mesh b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.node_id <> b.node_id)"
_ATTRS = """attrs AS (SELECT src, dst, sqrt(pow(d.easting - s.easting, 2) + pow(d.northing - s.northing, 2)) AS distance, s.elevation - d.elevation AS elev_diff, s.slope_dx, s.slope_dy,
    greatest(-1, least(1, ((d.easting - s.easting) * s.slope_dx + (d.northing - s.northing) * s.slope_dy) / (sqrt(pow(d.easting - s.easting, 2) + pow(d.northing - s.northing, 2)) * sqrt(pow(s.slope_dx, 2) + pow(s.slope_dy, 2)) + 1e-6))) AS dir_score
  FROM edges JOIN nodes s ON src = s.node_id JOIN nodes d ON dst = d.node_id)"""
_EDGES = f"{_MESH}, {_NODES}, {_TOUCH}, near AS (SELECT a.node_id AS src, b.node_id AS dst FROM mesh a, mesh b WHERE a.node_id % 9 = 0 AND b.node_id % 9 = 0 AND a.node_id <> b.node_id AND sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)) <= 4000), edges AS (SELECT * FROM touch UNION SELECT * FROM near)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    m = _mesh(spark, d)
    return graphs.edge_set(m, m.where("node_id % 9 = 0"), 4000.0)


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def g14_u03_edge_set(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {_EDGES}, {_ATTRS} SELECT src, dst, round(distance, 6) AS distance, round(elev_diff, 6) AS elev_diff, round(slope_dx, 6) AS slope_dx, round(slope_dy, 6) AS slope_dy, round(dir_score, 6) AS dir_score FROM attrs")
def g15_j26_edge_attributes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.edge_attributes(_edges(spark, d), _nodes(spark, d)).select("src", "dst", *(r(c) for c in graphs.ATTRIBUTES))


@query(f"WITH {_EDGES}, {_ATTRS}, s AS (SELECT avg(distance) AS m1, stddev_pop(distance) AS s1, avg(elev_diff) AS m2, stddev_pop(elev_diff) AS s2 FROM attrs) SELECT src, dst, round(((distance - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END)::DOUBLE, 3) AS distance, round(((elev_diff - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END)::DOUBLE, 3) AS elev_diff FROM attrs, s")
def g16_a19_standardised_edges(spark: SparkSession, d: str) -> DataFrame:
    attrs = graphs.edge_attributes(_edges(spark, d), _nodes(spark, d))
    out = graphs.standardised(attrs, graphs.scaler(attrs, ["distance", "elev_diff"]), ["distance", "elev_diff"])
    return out.select("src", "dst", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("distance", "elev_diff")))


@query(f"WITH {_EDGES}, {_ATTRS}, w AS (SELECT dst, exp(dir_score) AS w, elevation AS v FROM attrs JOIN nodes ON src = node_id) SELECT dst, round(sum(w * v) / sum(w), 6) AS out FROM w GROUP BY dst")
def n01_attention(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    attrs = graphs.edge_attributes(_edges(spark, d), nodes).join(nodes.select(F.col("node_id").alias("src"), "elevation"), "src")
    return graphs.attention(attrs, "dir_score", "elevation").select("dst", r("out"))


_IDW = "near AS (SELECT a.station, b.station AS other, b.level, sqrt(pow(b.easting - a.easting, 2) + pow(b.northing - a.northing, 2)) AS dist, row_number() OVER (PARTITION BY a.station ORDER BY sqrt(pow(b.easting - a.easting, 2) + pow(b.northing - a.northing, 2)), b.station) AS k FROM stations a, stations b WHERE a.station <> b.station)"


@query(f"WITH {STATIONS}, {_IDW} SELECT station, round(sum(pow(dist, -2) * level) / sum(pow(dist, -2)), 6) AS estimate FROM near WHERE k <= 5 GROUP BY station")
def t25_inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    s = stations(spark, d)
    return baselines.inverse_distance(s, s).select("station", r("estimate"))


_LEAP = "CASE WHEN (year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0)) AND dayofyear(day) >= 60 THEN dayofyear(day) - 1 ELSE dayofyear(day) END"
_CURVES = f"levels AS (SELECT station, avg(value) AS level FROM series GROUP BY ALL), curves AS (SELECT station, {_LEAP} AS doy, avg(value) AS curve, avg(value) - any_value(level) AS shape, any_value(level) AS level FROM series JOIN levels USING (station) GROUP BY ALL)"


@query(f"WITH {SERIES}, {_CURVES} SELECT station, doy, round(level, 6) AS level, round(curve, 6) AS curve, round(shape, 6) AS shape FROM curves")
def t25_climatology(spark: SparkSession, d: str) -> DataFrame:
    return baselines.climatology(series(spark, d)).select("station", F.col("doy").cast("long").alias("doy"), r("level"), r("curve"), r("shape"))


@query(f"WITH {SERIES}, {_CURVES} SELECT doy, round(avg(shape), 6) AS shape FROM curves GROUP BY doy")
def a29_mean_shape(spark: SparkSession, d: str) -> DataFrame:
    return baselines.mean_shape(baselines.climatology(series(spark, d))).select(F.col("doy").cast("long").alias("doy"), r("shape"))


@query(f"""WITH {SERIES}, {_CURVES}, stations AS (SELECT station, row_number() OVER (ORDER BY station) * row_number() OVER (ORDER BY station) * 100.0::DOUBLE AS easting, 0.0::DOUBLE AS northing, 0 AS level FROM levels), {_IDW},
  lv AS (SELECT n.station, sum(pow(dist, -2) * l.level) / sum(pow(dist, -2)) AS level FROM near n JOIN levels l ON l.station = n.other WHERE k <= 3 GROUP BY ALL),
  sh AS (SELECT n.station, c.doy, sum(pow(dist, -2) * c.shape) / sum(pow(dist, -2)) AS shape FROM near n JOIN curves c ON c.station = n.other WHERE k <= 3 GROUP BY ALL)
SELECT station, doy, round(level + shape, 6) AS prediction FROM sh JOIN lv USING (station)""")
def t26_regional_seasonal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    curves = baselines.climatology(series(spark, d))
    i = F.row_number().over(Window.orderBy("station"))
    places = curves.select("station").distinct().withColumn("easting", i * i * 100.0).withColumn("northing", F.lit(0.0))
    return baselines.regional_seasonal(places, curves, 3).select("station", F.col("doy").cast("long").alias("doy"), r("prediction"))


@query(f"WITH {SERIES}, {_CURVES}, s AS (SELECT *, {_LEAP} AS doy, lag(value) OVER (PARTITION BY station ORDER BY day) AS before FROM series) SELECT station, day, round(coalesce(before, curve), 6) AS prediction FROM s LEFT JOIN curves USING (station, doy)")
def w17_persistence(spark: SparkSession, d: str) -> DataFrame:
    rows = series(spark, d)
    return baselines.persistence(rows, baselines.climatology(rows)).select("station", "day", r("prediction"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """A station for each label: the mean of all its vectors, in all components."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
    return whole.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("station"), "features")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """All vectors with all components, for what is one aggregation and one pass over rows."""
    return table(spark, d, "embeddings").select(F.format_string("v%02d", F.col("vec_id").cast("long")).alias("station"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


_VEC = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), v AS (SELECT 'v' || label AS station, list(m ORDER BY i) AS f FROM means GROUP BY label),
  dist AS (SELECT a.station AS a, b.station AS b, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.f[i] - b.f[i], 2)))) AS distance FROM v a JOIN v b ON a.station < b.station)"""
_FAR = """s AS (SELECT 'v' || node_id % 10 AS station, avg(easting) AS easting, avg(northing) AS northing FROM stations GROUP BY ALL),
  far AS (SELECT a.station AS a, b.station AS b, sqrt(pow(a.easting - b.easting, 2) + pow(a.northing - b.northing, 2)) / 1000 AS km FROM s a JOIN s b ON a.station < b.station)"""


@query(f"WITH {_VEC} SELECT a, b, round(distance, 6) AS distance FROM dist")
def g19_vector_distances(spark: SparkSession, d: str) -> DataFrame:
    return selection.vector_distances(_vectors(spark, d)).select("a", "b", r("distance"))


@query("""WITH x AS (SELECT o_totalprice AS a, o_custkey AS b FROM orders), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT round(corr(ra, rb), 8) AS rho, count(*) AS n FROM k""")
def g19_spearman(spark: SparkSession, d: str) -> DataFrame:
    return selection.spearman(table(spark, d, "orders"), "o_totalprice", "o_custkey", stored).select(r("rho", 8), "n")


def _far(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the labels' places: each the centre of a tenth of all suppliers."""
    s = stations(spark, d).groupBy(F.concat(F.lit("v"), (F.col("node_id") % 10).cast("string")).alias("station")).agg(F.avg("easting").alias("easting"), F.avg("northing").alias("northing"))
    a, b = (s.select(F.col("station").alias(k), F.col("easting").alias(f"x{k}"), F.col("northing").alias(f"y{k}")) for k in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (S.planar(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) / 1000).alias("km"))


@query(f"""WITH {_VEC}, {STATIONS}, {_FAR},
  j AS (SELECT a AS test, b AS validation, distance, km FROM dist JOIN far USING (a, b) UNION ALL SELECT b, a, distance, km FROM dist JOIN far USING (a, b)),
  c AS (SELECT *, count(*) FILTER (km >= 7) OVER (PARTITION BY test) AS n FROM j)
SELECT test, validation, row_number() OVER (PARTITION BY test ORDER BY distance, validation) AS rank FROM c WHERE km >= CASE WHEN n >= 2 THEN 7 ELSE 4.2 END QUALIFY rank <= 2""")
def g20_two_validations(spark: SparkSession, d: str) -> DataFrame:
    near = selection.vector_distances(_vectors(spark, d))
    return selection.two_validations(near, _far(spark, d), 7.0).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_VEC}, s AS (SELECT a AS station, distance FROM dist UNION ALL SELECT b, distance FROM dist) SELECT station, round(sum(distance), 6) AS total FROM s GROUP BY station ORDER BY sum(distance) LIMIT 1")
def a32_prototype(spark: SparkSession, d: str) -> DataFrame:
    return selection.prototypes(_vectors(spark, d)).select("station", r("total"))


# Matrices are lists of rows; all of them are symmetric, so that rows times rows is their product.
_COV = """plain AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), centre AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(f[i]) AS m FROM plain, range(1, 65) a(i) GROUP BY i)),
  cells AS (SELECT i, j, covar_samp(f[i], f[j]) AS v FROM plain, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL), cov AS (SELECT list(w ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS w FROM cells GROUP BY i)),
  spread AS (SELECT sum(v) FILTER (i = j) AS trace FROM cells), unit AS (SELECT list(w ORDER BY i) AS one FROM (SELECT i, list((i = j)::INT::DOUBLE ORDER BY j) AS w FROM range(1, 65) a(i), range(1, 65) b(j) GROUP BY i)),
  off AS (SELECT vec_id, list_transform(range(1, 65), lambda i: f[i] - m[i]) AS x FROM plain, centre)"""


def _times(a: str, b: str) -> str:
    return f"list_transform({a}, lambda p: list_transform({b}, lambda q: list_dot_product(p, q)))"


def _whiten_sql() -> str:
    """The inverse square root of the covariance by Newton's iteration: y and z go to the root and its inverse, until their product is one."""
    half = "list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: 0.5 * ((i = j)::INT * 3 - t[i][j])))"
    return f"""WITH RECURSIVE {_COV}, ridged AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: (a[i][j] + (i = j)::INT * 1e-6) / trace)) AS y FROM cov, spread),
  turns AS (SELECT 0 AS k, 1.0::DOUBLE AS off_one, y, one AS z FROM ridged, unit UNION ALL
    SELECT k + 1, list_max(list_transform(range(1, 65), lambda i: list_max(list_transform(range(1, 65), lambda j: abs((i = j)::INT - t[i][j]))))), {_times('y', 'h')}, {_times('h', 'z')} FROM (SELECT *, {half} AS h FROM (SELECT k, y, z, {_times('z', 'y')} AS t FROM turns WHERE k < 60 AND off_one > 1e-6))),
  root AS (SELECT arg_max(z, k) AS z FROM turns)
SELECT 'v' || format('{{:02d}}', vec_id) AS station, i::INT - 1 AS i, round(list_dot_product(z[i], x) / sqrt(trace), 6) + 0.0 AS value FROM off, root, spread, range(1, 65) a(i)"""


def _spread(df: DataFrame) -> DataFrame:
    """A row a component."""
    return df.select("station", F.posexplode("features").alias("i", "value")).select("station", "i", (F.round("value", 6) + 0.0).alias("value"))


@query(_whiten_sql())
def g17_whiten(spark: SparkSession, d: str) -> DataFrame:
    """Every component of every whitened vector."""
    return _spread(selection.whiten(_embeddings(spark, d)))


def _principal_sql(most: int = 12, squarings: int = 26) -> str:
    """Direction by direction: squared again and again, the covariance leaves its first direction alone, which is then taken out of it."""
    step = squarings + 1
    best = "list_position(d, list_max(d))"
    found = f"list_transform(b[{best}], lambda x: x / sqrt(list_dot_product(b[{best}], b[{best}])))"
    signed = "list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda e: abs(e)), list_max(list_transform(v, lambda e: abs(e))))]))"
    return f"""WITH RECURSIVE {_COV},
  turns AS (SELECT 0 AS k, a, a AS b, []::DOUBLE[][] AS kept, []::DOUBLE[] AS sizes FROM cov UNION ALL
    SELECT k + 1, CASE WHEN v IS NULL THEN a ELSE less END, CASE WHEN v IS NULL THEN list_transform(bb, lambda p: list_transform(p, lambda x: x / scale)) ELSE less END, CASE WHEN v IS NULL THEN kept ELSE list_append(kept, {signed}) END, CASE WHEN v IS NULL THEN sizes ELSE list_append(sizes, lam) END
    FROM (SELECT *, list_sum(list_transform(range(1, 65), lambda i: bb[i][i])) AS scale, CASE WHEN v IS NOT NULL THEN list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: a[i][j] - lam * v[i] * v[j])) END AS less
      FROM (SELECT *, CASE WHEN v IS NULL THEN {_times('b', 'b')} END AS bb, CASE WHEN v IS NOT NULL THEN list_dot_product(v, list_transform(a, lambda p: list_dot_product(p, v))) END AS lam
        FROM (SELECT *, CASE WHEN k % {step} = {squarings} THEN {found} END AS v FROM (SELECT *, list_transform(range(1, 65), lambda i: b[i][i]) AS d FROM turns WHERE k < {most * step}))))),
  last AS (SELECT kept, sizes FROM turns WHERE k = {most * step}),
  enough AS (SELECT greatest(3, coalesce(min(n) FILTER (list_sum(sizes[1:n]) >= 0.95 * trace), {most})) AS n FROM last, spread, range(1, {most + 1}) t(n))
SELECT 'v' || format('{{:02d}}', vec_id) AS station, i::INT - 1 AS i, round(list_dot_product(kept[i], x), 6) + 0.0 AS value FROM off, last, enough, range(1, {most + 1}) a(i) WHERE i <= enough.n"""


@query(_principal_sql())
def g18_principal(spark: SparkSession, d: str) -> DataFrame:
    """Every score of every vector."""
    return _spread(selection.principal(_embeddings(spark, d)))


@query(f"""WITH {_VEC}, {STATIONS}, {_FAR}, y AS (SELECT a, b, km FROM far UNION ALL SELECT b, a, km FROM far), names AS (SELECT station, row_number() OVER (ORDER BY station) AS k FROM v),
  drawn AS (SELECT i, station, row_number() OVER (PARTITION BY i ORDER BY md5('55:' || i || ':' || station), station) AS k FROM names, range(1, 200) t(i)),
  renamed AS (SELECT d.i, n.station, d.station AS other FROM drawn d JOIN names n USING (k) UNION ALL SELECT 0, station, station FROM names),
  r AS (SELECT p.i, corr(x.distance, y.km) AS r FROM dist x JOIN renamed p ON p.station = x.a JOIN renamed q ON q.i = p.i AND q.station = x.b JOIN y ON y.a = p.other AND y.b = q.other GROUP BY p.i)
SELECT round((SELECT r FROM r WHERE i = 0), 8) AS r, round(count(*) FILTER (WHERE r >= (SELECT r FROM r WHERE i = 0) - 1e-12) / 200.0, 6) AS p FROM r""")
def g19_mantel(spark: SparkSession, d: str) -> DataFrame:
    out = selection.mantel(selection.vector_distances(_vectors(spark, d)), _far(spark, d).withColumnRenamed("km", "distance"), 199)
    return out.select(r("r", 8), r("p"))


def _k_centres_sql(k: int, buffer: float = 5.0, relax: float = 0.8) -> str:
    """A centre a step, among those that lie apart by the widest buffer that leaves any."""
    steps = ["t0 AS (SELECT 'v0' AS station, 0 AS turn)"]
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(i))
        steps.append(f"""c{i} AS (SELECT e.a AS station, min(e.distance) AS env, min(e.km) AS km FROM both_ways e JOIN ({before}) t ON t.station = e.b WHERE e.a NOT IN (SELECT station FROM ({before})) GROUP BY e.a),
  t{i} AS (SELECT station, {i} AS turn FROM c{i} WHERE km >= coalesce((SELECT max(w) FROM widths WHERE w <= (SELECT max(km) FROM c{i})), 0) ORDER BY env DESC, station DESC LIMIT 1)""")
    widths = ", ".join(str(buffer * relax**j) for j in range(70))
    return f"""WITH {_VEC}, {STATIONS}, {_FAR}, widths AS (SELECT unnest([{widths}]::DOUBLE[]) AS w),
  both_ways AS (SELECT a, b, distance, km FROM dist JOIN far USING (a, b) UNION ALL SELECT b, a, distance, km FROM dist JOIN far USING (a, b)), {', '.join(steps)},
  chosen AS ({' UNION ALL '.join(f'SELECT * FROM t{i}' for i in range(k))}),
  away AS (SELECT a, min(distance) AS d FROM (SELECT a, b, distance FROM dist UNION ALL SELECT b, a, distance FROM dist) WHERE b IN (SELECT station FROM chosen) AND a NOT IN (SELECT station FROM chosen) GROUP BY a)
SELECT (SELECT string_agg(station, ',' ORDER BY turn) FROM chosen) AS centres, round(max(d), 6) AS r_max, round(quantile_cont(d, 0.95), 6) AS r_95 FROM away"""


@query(_k_centres_sql(5))
def g21_k_centres(spark: SparkSession, d: str) -> DataFrame:
    near, far = selection.vector_distances(_vectors(spark, d)), _far(spark, d)
    chosen = selection.k_centres(near, far, 5, "v0")
    out = selection.coverage(near, chosen)
    return out.select(F.lit(",".join(chosen)).alias("centres"), r("r_max"), r("r_95"))


def _arc_sql(lat: str) -> str:
    """Meridional arc from the true origin."""
    a, b = projection.AIRY
    n, o = (a - b) / (a + b), float(projection.LAT0)
    return f"""{b * projection.SCALE} * ({1 + n + 1.25 * n**2 + 1.25 * n**3} * ({lat} - {o}) - {3 * n + 3 * n**2 + 2.625 * n**3} * sin({lat} - {o}) * cos({lat} + {o})
      + {1.875 * (n**2 + n**3)} * sin(2 * ({lat} - {o})) * cos(2 * ({lat} + {o})) - {35 / 24 * n**3} * sin(3 * ({lat} - {o})) * cos(3 * ({lat} + {o})))"""


def _steps(start: str, name: str, *columns: tuple[str, str]) -> str:
    """A table a step, each with one column more (or one replaced)."""
    out, last = [], start
    for i, (column, value) in enumerate(columns):
        others = f"* EXCLUDE ({column})" if column in {c for c, _ in columns[:i]} else "*"
        out.append(f"{name}{i} AS MATERIALIZED (SELECT {others}, {value} AS {column} FROM {last})")
        last = f"{name}{i}"
    return ", ".join([*out, f"{name} AS (SELECT * FROM {last})"])


def _shift_sql(source: tuple[float, float], target: tuple[float, float], sign: int) -> list[tuple[str, str]]:
    """``lat, lon`` in radians of one ellipsoid to the other's, by way of Cartesian coordinates."""
    tx, ty, tz, ppm, rx, ry, rz = (sign * v for v in projection.SHIFT)
    rx, ry, rz = (v / 3600 * 3.141592653589793 / 180 for v in (rx, ry, rz))
    e1, e2 = (1 - b * b / (a * a) for a, b in (source, target))
    k = 1 + ppm / 1e6
    nu = lambda a, e: f"({a} / sqrt(1 - {e} * pow(sin(lat), 2)))"
    turn = [("lat", f"atan2(zz + {e2} * {nu(target[0], e2)} * sin(lat), pp)")]
    return [
        ("x", f"{nu(source[0], e1)} * cos(lat) * cos(lon)"),
        ("y", f"{nu(source[0], e1)} * cos(lat) * sin(lon)"),
        ("z", f"{1 - e1} * {nu(source[0], e1)} * sin(lat)"),
        ("xx", f"{tx} + {k} * x - {rz} * y + {ry} * z"),
        ("yy", f"{ty} + {rz} * x + {k} * y - {rx} * z"),
        ("zz", f"{tz} - {ry} * x + {rx} * y + {k} * z"),
        ("pp", "sqrt(xx * xx + yy * yy)"),
        ("lon", "atan2(yy, xx)"),
        ("lat", f"atan2(zz, pp * {1 - e2})"),
        *(turn * 8),
    ]


def _radii_sql() -> list[tuple[str, str]]:
    a, b = projection.AIRY
    e = 1 - b * b / (a * a)
    root = f"(1 - {e} * pow(sin(lat), 2))"
    return [("nu", f"{a * projection.SCALE} / sqrt{root}"), ("rho", f"{a * projection.SCALE * (1 - e)} / pow({root}, 1.5)"), ("eta", "nu / rho - 1"), ("t", "tan(lat)")]


def _degrees_sql(start: str, name: str) -> str:
    """``easting, northing`` of ``start`` to ``lat, lon`` in radians."""
    p, f = projection, projection.AIRY[0] * projection.SCALE
    back = [
        ("lat", f"{float(p.LAT0)} + (northing - {p.NORTH0}) / {f}"),
        *([("lat", f"lat + (northing - {p.NORTH0} - {_arc_sql('lat')}) / {f}")] * 8),
        *_radii_sql(),
        ("dx", f"easting - {p.EAST0}"),
        ("lon", f"{float(p.LON0)} + (dx / nu - pow(dx, 3) / (6 * pow(nu, 3)) * (nu / rho + 2 * t * t) + pow(dx, 5) / (120 * pow(nu, 5)) * (5 + 28 * pow(t, 2) + 24 * pow(t, 4)) - pow(dx, 7) / (5040 * pow(nu, 7)) * (61 + 662 * pow(t, 2) + 1320 * pow(t, 4) + 720 * pow(t, 6))) / cos(lat)"),
        ("lat", "lat - t / (2 * rho * nu) * pow(dx, 2) + t / (24 * rho * pow(nu, 3)) * (5 + 3 * t * t + eta - 9 * t * t * eta) * pow(dx, 4) - t / (720 * rho * pow(nu, 5)) * (61 + 90 * t * t + 45 * pow(t, 4)) * pow(dx, 6)"),
    ]
    return _steps(start, name, *back, *_shift_sql(p.AIRY, p.WGS84, -1))


def _grid_sql(start: str, name: str) -> str:
    """``lat, lon`` in radians of ``start`` to ``easting, northing``."""
    p = projection
    forth = [
        ("dl", f"lon - {float(p.LON0)}"),
        ("easting", f"{p.EAST0} + nu * cos(lat) * dl + nu / 6 * pow(cos(lat), 3) * (nu / rho - t * t) * pow(dl, 3) + nu / 120 * pow(cos(lat), 5) * (5 - 18 * t * t + pow(t, 4) + 14 * eta - 58 * t * t * eta) * pow(dl, 5)"),
        ("northing", f"{_arc_sql('lat')} + {p.NORTH0} + nu / 2 * sin(lat) * cos(lat) * pow(dl, 2) + nu / 24 * sin(lat) * pow(cos(lat), 3) * (5 - t * t + 9 * eta) * pow(dl, 4) + nu / 720 * sin(lat) * pow(cos(lat), 5) * (61 - 58 * t * t + pow(t, 4)) * pow(dl, 6)"),
    ]
    # the ellipsoid's own columns, where ``start`` has them as columns
    return _steps(start, name, ("lat", "lat0"), ("lon", "lon0"), *_shift_sql(p.WGS84, p.AIRY, 1), *_radii_sql(), *forth)


@query(f"""WITH {STATIONS}, places AS (SELECT station, easting + 300000 AS easting, northing + 500000 AS northing FROM stations), {_degrees_sql('places', 'there')}, known AS (SELECT station, lat AS lat0, lon AS lon0 FROM there), {_grid_sql('known', 'back')}
SELECT station, round(degrees(lat0), 7) AS lat, round(degrees(lon0), 7) AS lon, round(easting, 0) AS easting, round(northing, 0) AS northing FROM back""")
def g01_g02_projection(spark: SparkSession, d: str) -> DataFrame:
    """Stations on the grid, to degrees and back."""
    places = stations(spark, d).select("station", (F.col("easting") + 300000).alias("easting"), (F.col("northing") + 500000).alias("northing"))
    return projection.with_grid(projection.with_lat_lon(places).select("station", "lat", "lon")).select("station", r("lat", 7), r("lon", 7), r("easting", 0), r("northing", 0))


@query(f"""WITH {STATIONS}, corners AS (SELECT min(easting) + 300000 AS easting, min(northing) + 500000 AS northing FROM stations UNION ALL SELECT max(easting) + 300000, max(northing) + 500000 FROM stations), {_degrees_sql('corners', 'there')}
SELECT round(degrees(max(lat)), 7) AS north, round(degrees(min(lon)), 7) AS west, round(degrees(min(lat)), 7) AS south, round(degrees(max(lon)), 7) AS east FROM there""")
def g04_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    """The box around all stations, in degrees."""
    e = stations(spark, d).agg(F.min("easting"), F.min("northing"), F.max("easting"), F.max("northing")).first()
    box = projection.bounding_box(((e[0] + 300000, e[1] + 500000), (e[2] + 300000, e[3] + 500000)))
    return spark.createDataFrame([tuple(round(x, 7) for x in box)], "north double, west double, south double, east double")


# parts as square cells, 50 a row, and their union by class
_PARTS = "parts AS (SELECT p_partkey, p_partkey % 50 AS i, p_partkey // 50 AS j, p_size % 3 AS kind FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.pmod("p_partkey", F.lit(50)).alias("i"), F.floor(F.col("p_partkey") / 50).alias("j"), F.pmod("p_size", F.lit(3)).alias("kind"))


def _dissolved(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda a, b: F.struct(((F.col("i") + a) * 25.0).alias("x"), ((F.col("j") + b) * 25.0).alias("y"))
    squares = _parts(spark, d).select("kind", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    return polygons.dissolve(squares, ["kind"], stored, 200.0, node=False)


@query(f"""WITH {_PARTS}, sides AS (SELECT p.kind, p.p_partkey, count(q.p_partkey) AS n FROM parts p LEFT JOIN parts q ON q.kind = p.kind AND abs(q.i - p.i) + abs(q.j - p.j) = 1 GROUP BY ALL)
SELECT kind, count(*) * 625.0::DOUBLE AS area, CAST(sum(4 - n) AS BIGINT) * 25.0::DOUBLE AS length FROM sides GROUP BY kind""")
def a30_dissolve(spark: SparkSession, d: str) -> DataFrame:
    """Area and length of the outline of each class's union."""
    whole = _dissolved(spark, d)
    length = polygons.ring_length(F.col("ring")) + polygons.total(F.col("holes"), polygons.ring_length)
    return whole.groupBy("kind").agg(F.sum("area").alias("area"), F.sum(length).alias("length"))


@query(f"WITH {_PARTS} SELECT p_partkey, kind FROM parts")
def a30_dissolved_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's centre lies in the union of its own class, and in no other."""
    centres = _parts(spark, d).select("p_partkey", ((F.col("i") + 0.5) * 25).alias("easting"), ((F.col("j") + 0.5) * 25).alias("northing"))
    return polygons.containing_polygons(centres, _dissolved(spark, d), 200.0).select("p_partkey", "kind")


_PLAIN = "plain AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"


def _matrix(spark: SparkSession, values) -> DataFrame:
    """A matrix as wide as a vector, as rows."""
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for i, row in enumerate(values) for j, v in enumerate(row)], "i int, j int, value double")


@query(f"WITH {_PLAIN} SELECT i::INT - 1 AS i, j::INT - 1 AS j, round(covar_samp(f[i], f[j]), 6) + 0.0 AS value FROM plain, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL")
def g17_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Of all components of all vectors."""
    return _matrix(spark, selection.covariance(_embeddings(spark, d))[1])


@query("SELECT i::INT - 1 AS i, j::INT - 1 AS j, (i = j)::INT::DOUBLE AS value FROM range(1, 65) a(i), range(1, 65) b(j) WHERE (SELECT count(*) FROM embeddings) > 64")
def g17_whitened_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Whitened vectors vary by one in every direction."""
    cov = selection.covariance(selection.whiten(_embeddings(spark, d), ridge=1e-9))[1]
    return _matrix(spark, cov.round(4))


@query("SELECT i::INT - 1 AS i, j::INT - 1 AS j, 0.0::DOUBLE AS value FROM range(1, 13) a(i), range(1, 13) b(j) WHERE i <> j AND (SELECT count(*) FROM embeddings) > 64")
def g18_uncorrelated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores on different principal directions don't vary together."""
    cov = selection.covariance(selection.principal(_embeddings(spark, d)))[1]
    return _matrix(spark, cov.round(6)).where("i <> j")


def _centres_sql(k: int) -> str:
    """Farthest first, a step a table: the vector furthest from all before, the greater name of ties."""
    away = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(p.f[i] - c.f[i], 2))))"
    steps = ["t0 AS (SELECT station, f, 0 AS turn FROM named WHERE station = 'v00')"]
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(i))
        steps.append(f"t{i} AS (SELECT station, f, {i} AS turn FROM (SELECT p.station, p.f, min({away}) AS d FROM named p, ({before}) c WHERE p.station NOT IN (SELECT station FROM ({before})) GROUP BY ALL) ORDER BY d DESC, station DESC LIMIT 1)")
    return f"WITH {_PLAIN}, named AS (SELECT format('v{{:02d}}', vec_id) AS station, f FROM plain), {', '.join(steps)} SELECT station, turn FROM ({' UNION ALL '.join(f'SELECT station, turn FROM t{i}' for i in range(k))})"


@query(_centres_sql(5))
def g21_core_centres(spark: SparkSession, d: str) -> DataFrame:
    """Five centres of all vectors, from the first on."""
    return selection.core_centres(_embeddings(spark, d), 5, "v00")
