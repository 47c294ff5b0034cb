"""Distances in the plane over an area that is taller than the threshold, as the query's SQL has them."""

from __future__ import annotations

import duckdb
import pytest

from rillwork.operators import donors
from rillwork.plans import catalog

from .compare import rows


@pytest.mark.parametrize("name", ["j17_station_distances", "j17_station_distances_wide"])
def test_tall_areas_equal_the_sql(spark, tmp_path, name):
    """s4 and s43204 are 4320000.015 m apart, which prints as a half but lies below it."""
    path = str(tmp_path / "supplier.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS s_suppkey, 0.0::DOUBLE AS s_acctbal FROM (SELECT range AS k FROM range(0, 60000, 499) UNION SELECT unnest([4, 43204]))) TO '{path}'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    ours = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(ours) == 123 * 122 // 2 and rows(ours) == rows(con.execute(catalog.ORACLE[name]).df())


def test_sides_that_decide(spark):
    tall = spark.createDataFrame([("a", 0, 0, 50.0, 0.0), ("b", 30_000, 40_000, 60.0, 0.0)], "station string, easting int, northing int, lat double, lon double")
    distance = lambda **k: donors.station_distances(tall, 35_000.0, **k).first()["distance_m"]
    assert distance(sides=["easting"]) == 50_000.0 < 1_000_000 < distance() == distance(sides=["northing"])
    assert donors.station_distances(tall, 35_000.0).count() == 1 and donors.wide_area(tall.limit(0)).first()["wide"] is None
