"""Places where the grid's series passes the pole: there the last bit of a sine decides the result."""

from __future__ import annotations

import duckdb
import numpy as np

from rillwork.functions import projection
from rillwork.plans import catalog

from .compare import rows


def test_places_near_the_pole_equal_the_sql(spark, tmp_path):
    path = str(tmp_path / "supplier.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS s_suppkey, 0.0::DOUBLE AS s_acctbal FROM range(39500, 39900)) TO '{path}'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    ours = catalog.QUERIES["g01_g02_projection"](spark, str(tmp_path)).toPandas()
    assert rows(ours) == rows(con.execute(catalog.ORACLE["g01_g02_projection"]).df())


def test_values_without_a_place():
    odd = [np.nan, np.inf, -np.inf, 1e300, 400000.0]
    lat, lon = projection.grid_to_wgs84(odd, [500000.0] * 5)
    assert np.isnan(lat[:3]).all() and np.isfinite([lat[4], lon[4]]).all()
    assert np.isnan(projection.wgs84_to_grid([np.nan, np.inf], [0.0, 0.0])[1]).all()
    assert all(v.size == 0 for v in projection.grid_to_wgs84([], []))
