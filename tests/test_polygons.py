"""Unions of polygons against flood fill, and GeoJSON of several parts."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from rillwork.operators import polygons
from rillwork.plans.registry import stored
from rillwork.sources import tables

SHAPE = "kind string, ring array<struct<x: double, y: double>>"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def filled(cells, eight=False):
    """Connected sets of cells; across corners too with ``eight``."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            i, j = todo.pop()
            part.add((i, j))
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    near = (i + di, j + dj)
                    if near in left and (di == 0 or dj == 0 or eight):
                        left.discard(near)
                        todo.append(near)
        out.append(part)
    return out


def even_odd(x, y, rings):
    return sum((p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"] for r in rings for p, q in zip(r, [*r[1:], r[0]])) % 2 == 1


def test_union_of_cells_equals_flood_fill(spark):
    draw = random.Random(6)
    n = 14
    cells = {(i, j): draw.choice("aaaab") for i in range(n) for j in range(n)}
    shapes = [(k, box(i, j, i + 1, j + 1)) for (i, j), k in cells.items()]
    shapes += shapes[:5] + [(None, box(40, 40, 41, 41)), ("a", None), ("a", box(0, 0, 1, 1)[:2])]
    turned = [(k, r[::-1] if r and m % 3 == 0 else r) for m, (k, r) in enumerate(shapes)]
    got = polygons.dissolve(spark.createDataFrame(turned, SHAPE), ["kind"], stored, 3.0).collect()
    for kind in "ab":
        mine = [r.asDict(recursive=True) for r in got if r["kind"] == kind]
        own = {c for c, k in cells.items() if k == kind}
        parts = filled(own)
        assert sorted(r["area"] for r in mine) == sorted(float(len(p)) for p in parts)
        outside = {(i, j) for i in range(-1, n + 1) for j in range(-1, n + 1)} - own
        holes = [h for h in filled(outside) if (-1, -1) not in h]  # cells that meet in a corner only are holes of their own
        corner = [h for h in filled(outside, True) if (-1, -1) not in h]
        assert len(corner) <= sum(len(r["holes"]) for r in mine) <= len(holes)
        for part in parts:
            (home,) = [r for r in mine if r["area"] == len(part) and all(even_odd(i + 0.5, j + 0.5, [r["ring"], *r["holes"]]) for i, j in part)]
            assert not any(even_odd(i + 0.5, j + 0.5, [home["ring"], *home["holes"]]) for i, j in (own | outside) - part)
            for ring in [home["ring"], *home["holes"]]:
                corners = [(p["x"], p["y"]) for p in ring]
                assert len(set(corners)) == len(corners)  # no ring touches itself
    assert [r["area"] for r in got if r["kind"] is None] == [1.0]


def test_neighbours_need_not_have_the_same_corners(spark):
    """A long bar over three boxes, and a frame around a hole within which lies an island."""
    shapes = [("bar", box(0, 1, 6, 2)), ("bar", box(0, 0, 1, 1)), ("bar", box(1, 0, 4, 1)), ("bar", box(4, 0, 6, 1))]
    shapes += [("frame", box(0, 0, 10, 2)), ("frame", box(0, 8, 10, 10)), ("frame", box(0, 2, 2, 8)), ("frame", box(8, 2, 10, 8)), ("frame", box(4, 4, 6, 6))]
    df = spark.createDataFrame(shapes, SHAPE)
    got = polygons.dissolve(df, ["kind"], stored, 2.5)
    bar, = got.where("kind = 'bar'").collect()
    assert bar["area"] == 12 and sorted((p["x"], p["y"]) for p in bar["ring"]) == [(0, 0), (0, 2), (6, 0), (6, 2)]
    island, frame = got.where("kind = 'frame'").orderBy("area").collect()
    assert (island["area"], frame["area"]) == (4, 64) and len(frame["holes"]) == 1 and not island["holes"]
    again = polygons.dissolve(got.where("kind = 'frame'"), ["kind"], stored, 2.5)  # polygons with holes go in as well
    assert sorted(r["area"] for r in again.collect()) == [4, 64]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 5.0), (4, 11.0, 1.0)], "id int, easting double, northing double")
    inside = polygons.containing_polygons(points, got.where("kind = 'frame'"), 2.5).select("id", "area")
    assert sorted(map(tuple, inside.collect()), key=str) == [(1, 64.0), (2, None), (3, 4.0), (4, None)]
    assert polygons.dissolve(df.where("false"), ["kind"], stored, 1.0).count() == 0


def test_all_parts_and_holes_of_geojson(spark, tmp_path):
    closed = lambda *b: [[p["x"], p["y"]] for p in [*box(*b), box(*b)[0]]]
    shapes = [("one", "Polygon", [closed(0, 0, 9, 9), closed(1, 1, 2, 2)]), ("two", "MultiPolygon", [[closed(10, 0, 12, 2)], [closed(20, 0, 29, 9), closed(21, 1, 22, 2), closed(25, 5, 26, 6)]]), ("point", "Point", [1, 2])]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]})
    (tmp_path / "ew1").mkdir()
    (tmp_path / "ew1" / "x_bedrock.geojson").write_text(text)
    read = tables.read_geojson(spark, str(tmp_path / "ew1" / "x_bedrock.geojson"), ["name"])
    folder = tables.read_vectors(spark, str(tmp_path), "ew.*", "_bedrock.geojson", ["name"])
    for df in (read, folder):
        area = polygons.signed_area(F.col("ring")) - polygons.total(F.col("holes"), polygons.signed_area)
        got = sorted((r["name"], r["part"], r["n"], r["a"]) for r in df.select("name", "part", F.size("holes").alias("n"), area.alias("a")).collect())
        assert got == [("one", 0, 1, 80.0), ("two", 0, 0, 4.0), ("two", 1, 2, 79.0)]


def test_short_rings_are_followed_no_longer_than_they_are(spark):
    """Each round stores only links of rings that aren't done."""
    draw, lengths, ids, after, stored_rows = random.Random(3), [4] * 200 + [1, 2, 3, 64, 65], list(range(0, 4000, 4)), {}, []
    draw.shuffle(ids)
    cycles = [[ids.pop() for _ in range(n)] for n in lengths]
    for c in cycles:
        after.update(zip(c, [*c[1:], c[0]]))

    def cut(df):
        out = stored(df)
        stored_rows.append(out.count())
        return out

    got = polygons._rings(spark.createDataFrame(list(after.items()), "id long, next long"), cut).collect()
    assert len(got) == len(after)
    for c in cycles:
        first = c.index(min(c))
        assert [r["id"] for r in sorted((r for r in got if r["ring"] == min(c)), key=lambda r: r["place"])] == c[first:] + c[:first]
    assert sum(stored_rows) < 5 * len(after)
