"""Operators that work by cells and blocks, against plain computations."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import donors, features, metrics, spatial
from rillwork.plans.registry import stored

POINT = "node_id int, easting double, northing double"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def brute_nearest(points, targets, k, itself):
    out = []
    for s, x, y in points:
        found = sorted((((X - x) ** 2 + (Y - y) ** 2) ** 0.5, t) for t, X, Y in targets if itself or t != s)
        out += [(s, t, round(d, 6), i) for i, (d, t) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("shape", ["even", "clusters", "line", "one place", "few"])
def test_nearest_points(spark, shape, itself):
    draw = random.Random(3)
    n = 3 if shape == "few" else 160
    if shape == "clusters":  # most in spots of a millionth of the whole, some far away, repeats
        spots = [(draw.uniform(0, 1e6), draw.uniform(0, 1e6)) for _ in range(5)]
        places = [(x + draw.gauss(0, 1), y + draw.gauss(0, 1)) for x, y in (draw.choice(spots) for _ in range(n - 20))] + [(1e9, -1e9), (5.0, 5.0)] * 10
    elif shape == "line":
        places = [(float(i * i), 7.0) for i in range(n)]
    elif shape == "one place":
        places = [(3.0, 4.0)] * n
    else:
        places = [(draw.uniform(-50, 50), draw.uniform(0, 9)) for _ in range(n)]
    points = [(i, x, y) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame([*points, (9000, None, 1.0)], POINT)
    for k in (1, 5):
        got = spatial.nearest_points(df, k, itself=itself)
        assert sorted((r["src"], r["dst"], round(r["distance"], 6), r["rank"]) for r in got.collect()) == brute_nearest(points, points, k, itself)
    text = plan(got)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_nearest_of_other_points(spark):
    draw = random.Random(4)
    points = [(i, draw.uniform(-9000, 9000), draw.uniform(-10, 10)) for i in range(30)]
    targets = [(i, draw.uniform(0, 10), draw.uniform(0, 10)) for i in range(100)]
    a, b = (spark.createDataFrame(p, POINT) for p in (points, targets))
    got = spatial.nearest_points(a, 3, itself=True, targets=b)
    assert sorted((r["src"], r["dst"], round(r["distance"], 6), r["rank"]) for r in got.collect()) == brute_nearest(points, targets, 3, True)
    assert spatial.nearest_points(a, 3, targets=b.where("false")).count() == 0 and spatial.nearest_points(a.where("false"), 3, targets=b).count() == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "int"])
def test_pair_correlations_by_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(donors, "STATIONS", 4)
    monkeypatch.setattr(donors, "TIMES", 16)
    rng = np.random.default_rng(6)
    n, days = 13, 70
    common = rng.normal(size=days)
    values = 1e6 + common * rng.uniform(-1, 2, (n, 1)) + rng.normal(size=(n, days)) * 0.5
    values[3] = 42.0  # never varies
    values[rng.random((n, days)) < 0.3] = np.nan
    values[5, 10:] = np.nan
    rows = [(f"s{i:02}", d, float(v)) for (i, d), v in np.ndenumerate(values) if not np.isnan(v)] + [("s00", 3, None), (None, 4, 1.0)]
    df = spark.createDataFrame(rows, "station string, d int, value double")
    day = {"date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")), "timestamp": F.to_timestamp(F.date_add(F.lit("2000-01-01").cast("date"), F.col("d"))), "int": F.col("d")}[kind]
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in donors.pair_correlations(df.withColumn("day", day), 20).collect()}
    want = {}
    for i in range(n):
        for j in range(i + 1, n):
            both = ~np.isnan(values[i]) & ~np.isnan(values[j])
            if both.any():
                x, y = values[i, both], values[j, both]
                r = np.corrcoef(x, y)[0, 1] if len(x) >= 20 and x.std() > 0 and y.std() > 0 else None
                want[f"s{i:02}", f"s{j:02}"] = int(both.sum()), None if r is None else max(0.0, r)
    assert got.keys() == want.keys()
    for k, (m, r) in want.items():
        assert got[k][0] == m and (got[k][1] is None) == (r is None) and (r is None or abs(got[k][1] - r) < 1e-9)
    assert donors.pair_correlations(df.withColumn("day", day).where("false")).count() == 0


def test_best_lag_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK", 64)
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for name, n, shift in (("a", 500, 17), ("b", 130, -23), ("c", 40, 3), ("d", 6, 0)):
        x = rng.normal(size=n + 100)
        a, b = x[50 : 50 + n].copy(), x[50 - shift : 50 - shift + n] + rng.normal(size=n) * 0.3
        a[rng.random(n) < 0.1] = np.nan
        scores = {}
        for lag in range(-30, 31):
            pairs = [(a[i], b[i + lag]) for i in range(n) if 0 <= i + lag < n and not np.isnan(a[i]) and not np.isnan(b[i + lag])]
            if len(pairs) >= 3:
                u, v = np.array(pairs).T
                if u.std() > 0 and v.std() > 0:
                    scores[lag] = (np.corrcoef(u, v)[0, 1], len(pairs))
        best = max(scores, key=lambda g: (round(scores[g][0], 9), -g))
        want[name] = (best, *scores[best])
        rows += [(name, i, None if np.isnan(p) else float(p), float(q) + 500) for i, (p, q) in enumerate(zip(a, b))]
    rows += [("flat", i, 1.0, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, t int, a double, b double").repartition(5)
    got = {r["g"]: (r["lag"], r["r"], r["n"]) for r in metrics.best_lag(df, "a", "b", ["g"], "t", 30).collect()}
    assert got.keys() == want.keys() and got["a"][0] == 17 and got["b"][0] == -23
    for k, (lag, r, n) in want.items():
        assert got[k][0] == lag and got[k][2] == n and abs(got[k][1] - r) < 1e-9


@pytest.mark.parametrize("keep", [0.5, 0.9, 0.999])
@pytest.mark.parametrize("cut", [None, stored])
def test_memory_of_long_series(spark, monkeypatch, keep, cut):
    monkeypatch.setattr(features, "MEMORY_ROWS", 100)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g, n in (("long", 4000), ("short", 3), (None, 250)):
        memory = 0.0
        for t in range(n):
            v = None if rng.random() < 0.1 else float(rng.normal() * 100)
            memory = memory if v is None else keep * memory + (1 - keep) * v
            rows.append((g, t, v))
            want[g, t] = memory
    df = spark.createDataFrame(rows, "station string, day int, value double").repartition(3)
    got = features.running_memory(df, "value", keep, cut=cut)
    assert got.columns == ["station", "day", "value", "memory"]
    held = {(r["station"], r["day"]): r["memory"] for r in got.collect()}
    assert held.keys() == want.keys() and max(abs(held[k] - v) for k, v in want.items()) < 1e-9


def test_nearest_points_of_a_strip_meet_few(spark):
    """Points along a line, a cluster and many at one place: finer levels than an even square needs keep candidates few."""
    rng = np.random.default_rng(8)
    places = [(float(i % 3), float(i * 50)) for i in range(4000)] + [(float(x), float(y)) for x, y in rng.normal(size=(300, 2))] + [(1e5, 1e5)] * 30
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "node_id long, easting double, northing double")
    got = spatial.nearest_points(df, 3, itself=True)
    rows = got.collect()
    p = np.array(places)
    for i in (0, 1, 2000, 3999, 4100, 4310):
        d = np.hypot(*(p - p[i]).T)
        want = sorted(range(len(p)), key=lambda j: (d[j], j))[:3]
        assert [r["dst"] for r in sorted((r for r in rows if r["src"] == i), key=lambda r: r["rank"])] == want
    assert len(rows) == 3 * len(p)
    held = spark.createDataFrame([(0, 256 * i, 1) for i in range(4000)] + [(9, 9, 30)], "ix long, iy long, n long")  # places of a strip, and many at one
    assert 8 <= spatial._finest(held) <= 10


def test_station_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(donors, "PAIRS", 100, raising=False)
    rows = [(f"s{i:02}", i * 3.0, i * 4.0, 54.0, -3.0) for i in range(40)]
    stations = spark.createDataFrame(rows, "station string, easting double, northing double, lat double, lon double").coalesce(1)
    got = donors.station_distances(stations)
    assert got.rdd.getNumPartitions() == 16
    assert sorted((r["a"], r["b"], r["distance_m"]) for r in got.collect()) == [(f"s{i:02}", f"s{j:02}", (j - i) * 5.0) for i in range(40) for j in range(i + 1, 40)]
