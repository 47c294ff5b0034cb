"""Polygons of rings: areas, containment with holes, and the union of polygons that share edges.

A ring is an array of (x, y) that doesn't repeat its first point. A polygon has an outer ring (``ring``) and ``holes``, an array of rings;
polygons of several parts are several rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cell, in_ring

Cut = Callable[[DataFrame], DataFrame]
_RINGS = "array<array<struct<x:double,y:double>>>"


def ring_edges(ring: Column) -> Column:
    """Its sides in order, as structs of ``x1, y1, x2, y2``."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    """Positive if it turns to the left."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def ring_length(ring: Column) -> Column:
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt((e["x2"] - e["x1"]) ** 2 + (e["y2"] - e["y1"]) ** 2))


def total(rings: Column, f: Callable[[Column], Column]) -> Column:
    """Sum of ``f`` over rings; 0 for none and null."""
    return F.aggregate(F.transform(F.coalesce(rings, F.array().cast(_RINGS)), f), F.lit(0.0), lambda s, v: s + v)


def in_polygon_of(x: Column, y: Column, ring: Column, holes: Column) -> Column:
    """Whether a point is in the outer ring and in no hole."""
    return in_ring(x, y, ring) & ~F.exists(F.coalesce(holes, F.array().cast(_RINGS)), lambda h: in_ring(x, y, h))


def _box(ring: str) -> Column:
    """Least and greatest x and y, as a struct ``x0, x1, y0, y1``."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def _boxed(shapes: DataFrame, bucket: float) -> DataFrame:
    """Shapes with the ``_box`` of their ring, once for each bucket ``_bx, _by`` that it meets."""
    span = lambda a, b: F.explode(F.sequence(cell(F.col(f"_box.{a}"), bucket), cell(F.col(f"_box.{b}"), bucket)))
    return shapes.withColumn("_box", _box("ring")).withColumn("_bx", span("x0", "x1")).withColumn("_by", span("y0", "y1"))


def _in_box(x: str, y: str) -> Column:
    return F.col(x).between(F.col("_box.x0"), F.col("_box.x1")) & F.col(y).between(F.col("_box.y0"), F.col("_box.y1"))


def containing_polygons(points: DataFrame, shapes: DataFrame, bucket: float, x: str = "easting", y: str = "northing") -> DataFrame:
    """Left join of points with the polygons (``ring, holes``) that contain them: an equi-join on the buckets of a polygon's box, then the box and the ray test."""
    placed = _boxed(shapes, bucket)
    asked = points.withColumns({"_bx": cell(F.col(x), bucket), "_by": cell(F.col(y), bucket)})
    inside = _in_box(x, y) & in_polygon_of(F.col(x), F.col(y), F.col("ring"), F.col("holes"))
    return asked.join(placed, (asked["_bx"] == placed["_bx"]) & (asked["_by"] == placed["_by"]) & inside, "left").drop("_bx", "_by", "_box", "ring", "holes")


def _segments(shapes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Directed sides of all rings, each with the inside of its polygon to the left."""
    turn = lambda ring, left: F.when((signed_area(ring) > 0) == F.lit(left), ring).otherwise(F.reverse(ring))
    holes = F.coalesce(F.col("holes"), F.array().cast(_RINGS)) if "holes" in shapes.columns else F.array().cast(_RINGS)
    rings = F.concat(F.array(turn(F.col("ring"), True)), F.transform(holes, lambda h: turn(h, False)))
    sides = shapes.where(F.size("ring") > 2).select(*by, F.explode(rings).alias("r")).select(*by, F.explode(ring_edges(F.col("r"))).alias("e"))
    return sides.select(*by, "e.*").where("x1 <> x2 or y1 <> y2")


def _noded(sides: DataFrame, by: Sequence[str], bucket: float) -> DataFrame:
    """Sides, cut where corners of the same union lie on them."""
    corners = sides.select(*by, F.col("x1").alias("_x"), F.col("y1").alias("_y")).distinct().withColumns({"_bx": cell(F.col("_x"), bucket), "_by": cell(F.col("_y"), bucket)})
    numbered = sides.distinct()  # repeats of a side count once
    span = lambda a, b: F.sequence(cell(F.least(a, b), bucket), cell(F.greatest(a, b), bucket))
    spread = numbered.withColumn("_bx", F.explode(span("x1", "x2"))).withColumn("_by", F.explode(span("y1", "y2")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = (F.col("_x") - F.col("x1")) * dx + (F.col("_y") - F.col("y1")) * dy
    on = ((F.col("_x") - F.col("x1")) * dy == (F.col("_y") - F.col("y1")) * dx) & (along > 0) & (along < dx * dx + dy * dy)
    found = spread.join(corners, [*by, "_bx", "_by"]).where(on).groupBy(*by, "x1", "y1", "x2", "y2").agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("_m"))
    joined = numbered.join(found, [*by, "x1", "y1", "x2", "y2"], "left")
    middle = F.transform(F.coalesce("_m", F.array().cast("array<struct<t:double,x:double,y:double>>")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    ends = lambda a, b: F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    path = F.concat(ends("x1", "y1"), middle, ends("x2", "y2"))
    steps = F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return joined.select(*by, F.explode(steps).alias("e")).select(*by, "e.*")


def _boundary(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sides that have the union on one side only: those that occur both ways cancel out; repeats count once."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ordered = sides.select(*by, *(F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))), forward.alias("_f"))
    net = ordered.groupBy(*by, "x1", "y1", "x2", "y2").agg(F.max("_f").alias("_f"), F.min("_f").alias("_l")).where("_f = _l")
    return net.select(*by, *(F.when(F.col("_f"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))))


def _rings(links: DataFrame, cut: Cut) -> DataFrame:
    """``id, ring, place`` of ``id, next``, a permutation: each cycle's least id, and steps from there, both by pointer jumping; none is gathered.

    Each link holds the least id of those it sees ahead and the steps to it; a round doubles how far it sees. Where both halves hold the same id,
    it has come round: the link is done, and its cycle with this round or the next. So a cycle takes the rounds of its own length, not of the longest.
    """
    seen = links.select("id", F.col("next").alias("to"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("done"))
    span, found = 1, []
    while True:
        other = seen.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ring").alias("_ring"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        steps = F.when(F.col("ring") <= F.col("_ring"), F.col("steps")).otherwise(F.col("_steps") + span)
        done = F.col("_done") | (F.col("ring") == F.col("_ring"))
        seen = cut(seen.where("not done").join(other, "to").select("id", F.col("_to").alias("to"), F.least("ring", "_ring").alias("ring"), steps.alias("steps"), done.alias("done")))
        found.append(seen.where("done").select("id", "ring", F.when(F.col("id") == F.col("ring"), F.lit(-(2**62))).otherwise(-F.col("steps")).alias("place")))
        span *= 2
        if not seen.where("not done").limit(1).count():
            return reduce(DataFrame.union, found)


def _straightened(ring: Column) -> Column:
    """Without points that lie on a straight line between their neighbours."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, F.pmod(i, n) + 1)
    bends = lambda p, i: (p["x"] - at(i - 1)["x"]) * (at(i + 1)["y"] - p["y"]) != (p["y"] - at(i - 1)["y"]) * (at(i + 1)["x"] - p["x"])
    return F.filter(ring, bends)


def dissolve(shapes: DataFrame, by: Sequence[str], cut: Cut, bucket: float, node: bool = True) -> DataFrame:
    """``by, part, ring, holes, area``: the union of all polygons of each ``by``, one row a part, corners on straight lines left out.

    For polygons that don't overlap but meet along sides, as cells of a mesh, districts or zones. Rings become directed sides;
    those that occur both ways lie within the union and cancel; the rest are linked, each to the next one furthest to the left, and followed
    round by pointer jumping. A ring that touches itself is parted there, so parts and holes that meet in a corner stay apart. With
    ``node`` sides are first cut where corners lie exactly on them, so neighbours needn't have the same corners; ``bucket`` is the size of the
    grid for that and for finding the part around each hole. Repeated polygons count once. ``cut`` cuts lineage.

    Null and short rings are left out; null ``by`` are one group. Only a finished ring, which is one row, is ever gathered.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    groups = shapes.select(*(F.to_json(F.struct(c)).alias(k) for c, k in zip(by, keys)), *by, "ring", *(["holes"] if "holes" in shapes.columns else []))  # null-safe keys
    names = groups.groupBy(*keys).agg(*(F.first(c).alias(c) for c in by))
    sides = _segments(groups.where(F.col("ring").isNotNull()), keys)
    sides = cut(_noded(sides, keys, bucket)) if node else sides
    edges = cut(_boundary(sides, keys).withColumn("id", F.monotonically_increasing_id()))
    out = edges.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), (F.col("x2") - F.col("x1")).alias("_dx"), (F.col("y2") - F.col("y1")).alias("_dy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(dx * F.col("_dy") - dy * F.col("_dx"), dx * F.col("_dx") + dy * F.col("_dy"))
    links = cut(edges.join(out, [*keys, "x2", "y2"]).groupBy("id").agg(F.max_by("next", turn).alias("next"), (F.count(F.lit(1)) > 1).alias("fork")))
    placed = cut(edges.join(_rings(links, cut), "id"))
    # where a ring comes to a corner again, it is parted: the way in of one visit goes on as the visit before did
    visits = placed.select("id", "ring", "place", "x1", "y1").join(links.where("fork").select(F.col("id").alias("_in"), F.col("next").alias("id")), "id")
    corner = Window.partitionBy("ring", "x1", "y1")
    again = visits.withColumn("_n", F.count(F.lit(1)).over(corner)).where("_n > 1")
    before = F.coalesce(F.lag("id").over(corner.orderBy("place")), F.last("id").over(corner.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    again = cut(again.select(F.col("_in").alias("id"), before.alias("_next"), "ring"))
    if again.limit(1).count():  # only these rings are followed anew
        touched = again.select("ring").distinct()
        old = cut(placed.join(touched, "ring", "left_semi"))
        parted = old.select("id").join(links, "id").join(again.drop("ring"), "id", "left").select("id", F.coalesce("_next", "next").alias("next"))
        placed = placed.join(touched, "ring", "left_anti").unionByName(old.drop("ring", "place").join(_rings(cut(parted), cut), "id"))
    points = F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"))))
    rings = placed.groupBy(*keys, "ring").agg(F.transform(points, lambda s: s["p"]).alias("points"))
    rings = cut(rings.select(*keys, F.col("ring").alias("part"), _straightened(F.col("points")).alias("ring")).withColumn("area", signed_area(F.col("ring"))))
    outer = rings.where("area > 0")
    side = ring_edges(F.col("ring"))[0]
    near = lambda a, b, c, d, s: (side[a] + side[b]) / 2 + s * (side[c] - side[d]) * 1e-6  # noqa: E731  a point just to the left of a side: in the part around the hole
    holes = rings.where("area < 0").select(*keys, F.col("part").alias("_hole"), F.col("ring").alias("_ring"), near("x1", "x2", "y2", "y1", -1).alias("_px"), near("y1", "y2", "x2", "x1", 1).alias("_py"))
    around = _boxed(outer, bucket)
    asked = holes.withColumns({"_bx": cell(F.col("_px"), bucket), "_by": cell(F.col("_py"), bucket)})
    within = asked.join(around, [*keys, "_bx", "_by"]).where(_in_box("_px", "_py") & in_ring(F.col("_px"), F.col("_py"), F.col("ring")))
    owner = within.groupBy("_hole").agg(F.min_by("part", "area").alias("part"), F.first("_ring").alias("_ring"))
    held = owner.groupBy("part").agg(F.collect_list("_ring").alias("holes"))
    whole = outer.join(held, "part", "left").withColumn("holes", F.coalesce("holes", F.array().cast(_RINGS)))
    whole = whole.withColumn("area", F.col("area") + total(F.col("holes"), signed_area))
    return whole.join(names, keys).select(*by, "part", "ring", "holes", "area")
