"""Operators against plain computations, and their odd cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.functions import projection
from rillwork.functions import scalars as S
from rillwork.operators import assembly, calendars, cleaning, donors, features, gaps, metrics, model_terms, preparation, selection, spatial
from rillwork.plans.registry import daily, series
from rillwork.sources import config, sinks, tables


def days(spark, values, station="a", start="2024-01-01"):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([(station, first + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "station string, day date, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("station", "day").collect()]


def test_weekly_bins_close_on_monday(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, k),) for k in range(1, 15)], "d date")
    got = {r["d"]: r["b"] for r in d.select("d", calendars.bin_of(F.col("d"), "weekly").alias("b")).collect()}
    want = pd.Series(1, index=pd.date_range("2024-01-01", "2024-01-14")).resample("W-MON").sum()
    assert sorted({b for b in got.values()}) == [t.date() for t in want.index]
    assert got[dt.date(2024, 1, 1)] == dt.date(2024, 1, 1) and got[dt.date(2024, 1, 2)] == dt.date(2024, 1, 8)


def test_calendar_lengths(spark):
    assert calendars.calendar(spark, "2014-01-01", "2024-12-31").count() == 4018
    assert calendars.calendar(spark, "2014-01-02", "2014-01-05", "weekly").count() == 0
    with pytest.raises(ValueError):
        calendars.bin_of(F.lit(None), "hourly")


def test_resample_without_rows_or_values(spark):
    empty = spark.createDataFrame([], "station string, ts timestamp, value double, quality string")
    assert calendars.resample(empty, "daily", modes=["quality"]).count() == 0
    nulls = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None, None)], empty.schema)
    row = calendars.resample(nulls, "daily", modes=["quality"]).first()
    assert row["value"] is None and row["quality"] is None


def test_monotone_filling_stays_between_neighbours(spark):
    values = [1, None, None, 4, 3, None, 3, None, 10, None]
    out = column(gaps.fill_monotone(days(spark, values)), "filled")
    assert out[-1] is None and all(1 <= v <= 10 for v in out[:-1]) and [out[0], out[3], out[4], out[8]] == [1, 4, 3, 10]
    assert out[1] < out[2] < 4 and out[5] == pytest.approx(3)
    assert column(gaps.fill_monotone(days(spark, [1, None, 3])), "filled") == pytest.approx([1, 2, 3])
    assert column(gaps.fill_monotone(days(spark, [None, None])), "filled") == [None, None]


def test_spline_repeats_a_cubic():
    x = np.array([0.0, 1, 3, 4, 7, 9])
    cubic = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    at = np.linspace(0, 9, 31)
    assert gaps.spline_values(x, cubic(x), at) == pytest.approx(cubic(at))
    assert gaps.spline_values(x[:2], x[:2], at[:3]) == pytest.approx(at[:3])


def test_short_gaps_leave_edges_and_long_ones(spark):
    out = gaps.fill_short_gaps(days(spark, [None, 1, None, 3, None, None, None, 7, None]), 2, "linear")
    assert column(out, "value") == [None, 1, 2, 3, None, None, None, 7, None]
    assert column(out, "data_type").count("interpolated_short") == 1


def test_queue_and_its_off_by_one(spark):
    base = days(spark, [1, None, 3, None, None, None, 7])
    after = gaps.fill_short_gaps(base, 1, "linear")
    assert gaps.long_gap_queue(base, after).first()["longest"] == 3
    one = days(spark, [1, None, 3, None])
    assert gaps.long_gap_queue(one, gaps.fill_short_gaps(one, 1, "linear"), off_by_one=True).count() == 0


def test_hampel_finds_a_spike_but_not_at_the_edge(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, 60)
    values[30], values[1] = 50, 50
    flags = column(cleaning.hampel(days(spark, values), 20, 5.0, time="day"), "hampel")
    assert flags[30] and not flags[1] and sum(flags) == 1


def test_rolling_median_equals_pandas(spark, sf_dir):
    rows = calendars.reindex(daily(spark, sf_dir), common=True)
    got = cleaning.rolling_median(rows, time="day").toPandas().sort_values(["station", "day"])
    want = got.groupby("station")["value"].transform(lambda v: v.rolling(30, min_periods=10).median())
    assert np.allclose(got["median"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_rules_in_order(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, k), float(k), "Good") for k in range(1, 5)], "station string, ts timestamp, value double, quality string")
    t = lambda k: dt.datetime(2024, 1, k)
    rules = cleaning.rule_table(spark, [(1, "a", "null", t(4), t(4), None), (2, "a", "shift", t(1), t(2), 10.0), (3, "a", "mirror", t(1), t(2), 1.0), (4, "b", "null", t(1), t(4), None)])
    out = {r["ts"].day: (r["value"], r["quality"]) for r in cleaning.apply_rules(rows, rules).collect()}
    assert out == {1: (13.0, "Good"), 2: (12.0, "Good"), 3: (3.0, "Good"), 4: (None, "Missing")}


def test_two_pass_imputation_meets_both_edges(spark):
    a = days(spark, [1, 2, None, None, None, 6, 7], "a")
    b = days(spark, [11, 12, 13, 14, 15, 16, 17], "b")
    scores = spark.createDataFrame([("a", "b", 0.9)], "station string, donor string, score double")
    out = donors.impute(a.union(b), scores)
    mine = out.where("station = 'a'")
    assert column(mine, "value") == pytest.approx([1, 2, 2, 4, 6, 6, 7])
    assert column(mine, "data_type") == ["raw"] * 2 + ["imputed_long"] * 3 + ["raw"] * 2
    one = donors.impute(a.union(b), scores, two_pass=False).where("station = 'a'")
    assert column(one, "value") == pytest.approx([1, 2, 3, 4, 5, 6, 7])


def test_imputation_in_order_uses_imputed_donors(spark):
    a, b, c = days(spark, [1, None, 3], "a"), days(spark, [2, None, 4], "b"), days(spark, [5, 6, 7], "c")
    scores = spark.createDataFrame([("b", "c", 0.9), ("a", "b", 0.9)], "station string, donor string, score double")
    rows = a.union(b).union(c)
    chained = donors.impute_in_order(rows, scores, ["b", "a"], lambda x: x.checkpoint(), two_pass=False)
    assert column(chained.where("station = 'a'"), "value") == pytest.approx([1, 2, 3])
    assert column(donors.impute(rows, scores, two_pass=False).where("station = 'a'"), "value")[1] is None


def test_validation_is_perfect_on_a_line(spark):
    line = days(spark, range(60))
    chosen = donors.synthetic_gaps(line, spark.createDataFrame([("a", 7)], "station string, length int"), (7, 9), around=2)
    assert chosen.count() == 1
    fill = lambda x: gaps.fill_linear(x, name="_f").withColumn("value", F.col("_f")).drop("_f")
    row = donors.validate(line, chosen, fill).first()
    assert row["n"] == 7 and row["mae"] == pytest.approx(0)


def test_scores_of_degenerate_series(spark):
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, y double, p double")
    row = metrics.errors(flat, "y", "p", ["g"]).first()
    assert row["nse"] is None and row["r"] is None and row["kge"] is None and row["mae"] == 1.5
    assert metrics.errors(flat.limit(0), "y", "p", ["g"]).count() == 0


def test_lag_is_found(spark):
    v = np.random.default_rng(2).normal(size=80)
    rows = spark.createDataFrame([("g", i, float(v[i]), float(v[i - 4]) if i >= 4 else None) for i in range(80)], "g string, t int, a double, b double")
    assert metrics.best_lag(rows, "a", "b", ["g"], "t", 10).first()["lag"] == 4


def test_splits_are_whole_and_disjoint(spark):
    names = spark.createDataFrame([(f"s{i}",) for i in range(14)], "station string")
    split = preparation.split_stations(names, (77, 15, 8), 55, ["s3"])
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 11, "val": 2, "test": 1}
    assert split.where("station = 's3'").first()["split"] == "test"
    assert preparation.split_faults(split, names).count() == 0
    assert preparation.split_faults(split.where("station <> 's3'"), names).first()["fault"] == "none"
    with pytest.raises(ValueError):
        preparation.split_sizes(10, 50, 20, 20)


def test_column_groups_must_be_complete():
    assert preparation.column_groups(["a", "b"], {"x": ["a"], "y": ["b", "c"]}) == {"x": ["a"], "y": ["b"]}
    with pytest.raises(ValueError):
        preparation.column_groups(["a", "z"], {"x": ["a"]})


def test_touching_is_symmetric_and_radius_agrees_with_brute_force(spark):
    nodes = spatial.mesh(spark, (0, 0, 4000, 3000))
    pairs = {(r["src"], r["dst"]) for r in spatial.touching(nodes).collect()}
    assert nodes.count() == 12 and all((b, a) in pairs for a, b in pairs) and len(pairs) == 2 * (3 * 3 + 4 * 2 + 2 * 3 * 2)
    pts = nodes.toPandas()
    want = {(int(a), int(b)) for a, x, y in pts[["node_id", "easting", "northing"]].to_numpy() for b, u, v in pts[["node_id", "easting", "northing"]].to_numpy() if 0 < np.hypot(x - u, y - v) <= 1500}
    assert {(r["src"], r["dst"]) for r in spatial.within_radius(nodes, 1500.0).collect()} == want


def test_slope_of_a_plane(spark):
    dem = spark.createDataFrame([(i, j, 3.0 * i) for i in range(4) for j in range(4)], "ix int, iy int, z double")
    out = spatial.slope_aspect(dem, 3.0).toPandas()
    assert len(out) == 4 and np.allclose(out["slope"], 45) and np.allclose(out["aspect_sin"], -1) and np.allclose(out["slope_dx"], -1)


def test_whitened_vectors_have_unit_covariance(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.1]])
    rows = spark.createDataFrame([(f"s{i}", [float(x) for x in v]) for i, v in enumerate(data)], "station string, features array<double>")
    out = np.array([r["features"] for r in selection.whiten(rows, ridge=0.0).collect()])
    assert np.cov(out.T) == pytest.approx(np.eye(3), abs=1e-6)
    reduced = np.array([r["features"] for r in selection.principal(rows, share=0.9, least=1).collect()])
    assert reduced.shape[1] < 3


def test_grid_agrees_with_the_published_example():
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    east, north = projection.to_grid(lat, lon)
    assert (float(east), float(north)) == pytest.approx((651409.903, 313177.270), abs=0.01)
    assert tuple(map(float, projection.from_grid(651409.903, 313177.270))) == pytest.approx((lat, lon), abs=1e-7)
    back = projection.wgs84_to_grid(*projection.grid_to_wgs84([350000.0], [550000.0]))
    assert (back[0][0], back[1][0]) == pytest.approx((350000, 550000), abs=0.1)


def test_grid_references(spark):
    d = spark.createDataFrame([("NY123456",), ("NY 1 2",), ("NY123",)], "ref string")
    e, n = S.grid_easting_northing(F.col("ref"), F.lit(300000), F.lit(500000))
    got = [(r["e"], r["n"]) for r in d.select(e.alias("e"), n.alias("n")).collect()]
    assert got == [(312300, 545600), (310000, 520000), (None, None)]


def test_stable_bucket(spark):
    names = ["a", "north_field", "Übersee", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(S.stable_bucket(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in got] == [int(hashlib.md5(n.encode()).hexdigest(), 16) % 10000 for n in names]


def test_sources(spark, tmp_path):
    (tmp_path / "a_trimmed.csv").write_text("station_name,date,dateTime,value,quality,measure\n Ren Wick ,2024-01-01,2024-01-01T00:00:00,NaN,Good,m\nB,2024-01-01,bad,x,Good,m\n")
    got = tables.read_readings(spark, str(tmp_path / "a_trimmed.csv")).collect()
    assert got[0]["station"] == "ren_wick" and got[0]["value"] is None and got[1]["ts"] is None
    assert tables.read_many(spark, str(tmp_path), tables.READINGS).first()["file"] == "a_trimmed.csv"
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    shape = tables.read_geojson(spark, str(tmp_path / "g.json"), ["name"])
    assert len(shape.first()["ring"]) == 3 and shape.select(sinks.geometry_text(F.col("ring"))).first()[0].startswith("POLYGON ((0.0 0.0")
    (tmp_path / "r.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2\n-9 4\n")
    assert {(r["x"], r["y"]): r["value"] for r in tables.read_ascii_grid(spark, str(tmp_path / "r.asc")).collect()} == {(12.5, 27.5): 1, (17.5, 27.5): 2, (17.5, 22.5): 4}


def test_paged_source(spark):
    class Fake(tables.PagedReadings):
        @staticmethod
        def fetch(url):
            offset = int(url.rpartition("=")[2])
            return [{"dateTime": f"2024-01-{i + 1:02}", "value": i, "quality": "Good"} for i in range(offset, min(offset + 3, 7))]

        @classmethod
        def name(cls):
            return "fake_readings"

    spark.dataSource.register(Fake)
    rows = spark.read.format("fake_readings").option("uris", "http://x/m, notauri").option("limit", 3).load()
    assert sorted(r["value"] for r in rows.collect()) == list(range(7))


def test_stations_are_found_and_their_readings_downloaded(spark, tmp_path):
    class Stations(tables.StationList):
        @staticmethod
        def fetch(url):
            assert "dist=5" in url and "observedProperty=level" in url
            found = [{"notation": f"s{k}", "label": f"S{k}", "measures": [{"@id": f"http://x/m{k}"}]} for k in (1, 2)]
            return found if "lat=1.5" in url and "long=-2" in url else []

        @classmethod
        def name(cls):
            return "fake_stations"

    def page(url):
        if "/m2/" in url:
            raise OSError("gone")
        return [{"dateTime": "2024-01-01T00:00:00", "date": "2024-01-01", "value": 1, "quality": "Good"}]

    spark.dataSource.register(Stations)
    found = tables.station_details(spark.read.format("fake_stations").options(base="http://x", places="1.5:-2, 3:4", dist="5", parameter="level").load())
    assert {(r["station"], r["station_name"], r["measure_uri"]) for r in found.collect()} == {("s1", "S1", "http://x/m1"), ("s2", "S2", "http://x/m2")}
    for _ in range(2):
        kept = tables.download(spark, found, str(tmp_path / "kept"), fetch=page)
        assert [(r["measure"], r["value"]) for r in kept.collect()] == [("http://x/m1", 1.0)]


def test_memory_holds_the_whole_weight(spark):
    n, keep = 3000, 0.99
    df = spark.range(n).select(F.lit("a").alias("station"), F.col("id").alias("day"), (F.col("id") % 7).cast("double").alias("value"))
    got = features.running_memory(df, "value", keep).where(F.col("day") == n - 1).first()["memory"]
    memory = 0.0
    for i in range(n):
        memory = keep * memory + (1 - keep) * (i % 7)
    assert got == pytest.approx(memory, abs=1e-9)


def test_box_of_corners():
    north, west, south, east = projection.bounding_box(((400000, 300000), (410000, 320000)))
    lat, lon = projection.grid_to_wgs84([400000, 410000], [300000, 320000])
    assert south == pytest.approx(lat[0]) and west == pytest.approx(lon[0]) and north == pytest.approx(lat[1]) and east == pytest.approx(lon[1])


def test_sinks_and_settings(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_csv(d, str(tmp_path / "c"))
    sinks.write_csv(d, str(tmp_path / "c"), append=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    sinks.write_parquet(d, str(tmp_path / "p"), by="v")
    assert (tmp_path / "p" / "v=a").exists()
    assert sinks.content_hash(d) == sinks.content_hash(d.orderBy(F.desc("k"))) != sinks.content_hash(d.limit(1))
    assert json.loads(sinks.manifest({"d": d}, seed=55))["seed"] == 55
    assert config.settings({"root": "/r", "sub": {"x": "{root}/y", "z": ["{root}", 3]}}) == {"root": "/r", "sub": {"x": "/r/y", "z": ["/r", 3]}}


def test_stacking_and_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "t int, v string"), spark.createDataFrame([(1, "y"), (2, None)], "t int, v string")
    assert {r["t"]: r["v"] for r in assembly.stacked([a, b], "t").collect()} == {1: "x", 2: None}
    assert assembly.with_columns(a, [("t", "long"), ("w", "double")]).first().asDict() == {"t": 1, "w": None}


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    from rillwork.plans import catalog

    plan = catalog.QUERIES["f04_f06_f07_f11_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan or "GreaterThanOrEqual(o_totalprice" in plan
    whole = series(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in whole


def test_recurrent_state_is_carried_in_order(spark):
    rows = spark.createDataFrame([("a", k, [float(k)]) for k in (3, 1, 2)] + [("b", 1, [1.0])], "station string, day int, x array<double>")
    w, u, b = np.ones((4, 1)), np.full((4, 1), 0.5), np.zeros(4)
    got = {(r["station"], r["day"]): r["hidden"][0] for r in model_terms.recurrent(rows, "x", w, u, b).collect()}
    h = c = np.zeros(1)
    for k in (1, 2, 3):
        h, c = model_terms.lstm_step(np.array([float(k)]), h, c, w, u, b)
        assert got["a", k] == pytest.approx(h[0])
    assert got["b", 1] == got["a", 1]
