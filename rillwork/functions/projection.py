"""British National Grid and geographic coordinates: transverse Mercator series and a Helmert shift.

Published formulas of the Ordnance Survey's guide to coordinate systems; the shift is good to about 5 m.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: ellipsoids (semi-axes, m), projection, and shift from WGS84 to OSGB36 (m, ppm, seconds)
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.3141)
SCALE, LAT0, LON0, NORTH0, EAST0 = 0.9996012717, math.radians(49.0), math.radians(-2.0), -100000.0, 400000.0
SHIFT = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)


def _each(function: Callable[..., float], beyond: Callable) -> Callable:
    """A function of the C library for each value of arrays: numpy's own differ in the last bit, by processor, and near the pole that bit decides
    the result. ``beyond`` serves where Python's refuses a value."""

    def one(*values: float) -> float:
        try:
            return function(*values)
        except (ValueError, OverflowError):
            with np.errstate(all="ignore"):
                return float(beyond(*values))

    return np.vectorize(one, otypes=[float])


_sin, _cos, _tan, _atan2, _pow = (_each(*f) for f in ((math.sin, np.sin), (math.cos, np.cos), (math.tan, np.tan), (math.atan2, np.arctan2), (math.pow, np.power)))


def _arc(lat: np.ndarray) -> np.ndarray:
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 2.625 * n**3) * _sin(d) * _cos(s)
        + 1.875 * (n**2 + n**3) * _sin(2 * d) * _cos(2 * s)
        - 35 / 24 * n**3 * _sin(3 * d) * _cos(3 * s)
    )
    return b * SCALE * terms


def _radii(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    root = 1 - e2 * _pow(_sin(lat), 2)
    nu, rho = a * SCALE / np.sqrt(root), a * SCALE * (1 - e2) / _pow(root, 1.5)
    return nu, rho, nu / rho - 1


def _to_grid(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dl = lon - LON0
    nu, rho, eta = _radii(lat)
    s, c, t = _sin(lat), _cos(lat), _tan(lat)
    t4 = _pow(t, 4)
    north = _arc(lat) + NORTH0 + nu / 2 * s * c * _pow(dl, 2) + nu / 24 * s * _pow(c, 3) * (5 - t * t + 9 * eta) * _pow(dl, 4) + nu / 720 * s * _pow(c, 5) * (61 - 58 * t * t + t4) * _pow(dl, 6)
    east = EAST0 + nu * c * dl + nu / 6 * _pow(c, 3) * (nu / rho - t * t) * _pow(dl, 3) + nu / 120 * _pow(c, 5) * (5 - 18 * t * t + t4 + 14 * eta - 58 * t * t * eta) * _pow(dl, 5)
    return east, north


def _from_grid(easting, northing) -> tuple[np.ndarray, np.ndarray]:
    e, n = np.asarray(easting, float) - EAST0, np.asarray(northing, float)
    lat = LAT0 + (n - NORTH0) / (AIRY[0] * SCALE)
    for _ in range(8):
        lat = lat + (n - NORTH0 - _arc(lat)) / (AIRY[0] * SCALE)
    nu, rho, eta = _radii(lat)
    t, c = _tan(lat), _cos(lat)
    t2, t4, t6 = _pow(t, 2), _pow(t, 4), _pow(t, 6)
    nu3, nu5, nu7 = _pow(nu, 3), _pow(nu, 5), _pow(nu, 7)
    out = lat - t / (2 * rho * nu) * _pow(e, 2) + t / (24 * rho * nu3) * (5 + 3 * t * t + eta - 9 * t * t * eta) * _pow(e, 4) - t / (720 * rho * nu5) * (61 + 90 * t * t + 45 * t4) * _pow(e, 6)
    lon = LON0 + (e / nu - _pow(e, 3) / (6 * nu3) * (nu / rho + 2 * t * t) + _pow(e, 5) / (120 * nu5) * (5 + 28 * t2 + 24 * t4) - _pow(e, 7) / (5040 * nu7) * (61 + 662 * t2 + 1320 * t4 + 720 * t6)) / c
    return out, lon


def _shifted(lat: np.ndarray, lon: np.ndarray, source, target, sign: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = source
    e2 = 1 - b * b / (a * a)
    nu = a / np.sqrt(1 - e2 * _pow(_sin(lat), 2))
    x, y, z = nu * _cos(lat) * _cos(lon), nu * _cos(lat) * _sin(lon), (1 - e2) * nu * _sin(lat)
    tx, ty, tz, ppm, *turn = (sign * v for v in SHIFT)
    rx, ry, rz = (v / 3600 * math.pi / 180 for v in turn)
    k = 1 + ppm / 1e6
    x, y, z = tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z
    a, b = target
    e2 = 1 - b * b / (a * a)
    p = np.sqrt(x * x + y * y)
    lat = _atan2(z, p * (1 - e2))
    for _ in range(8):
        nu = a / np.sqrt(1 - e2 * _pow(_sin(lat), 2))
        lat = _atan2(z + e2 * nu * _sin(lat), p)
    return lat, _atan2(y, x)


def _radians(*degrees) -> list[np.ndarray]:
    return [np.radians(np.asarray(v, float)) for v in degrees]


def _degrees(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(lat), np.degrees(lon)


def to_grid(lat_deg, lon_deg) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing from OSGB36 degrees."""
    return _to_grid(*_radians(lat_deg, lon_deg))


def from_grid(easting, northing) -> tuple[np.ndarray, np.ndarray]:
    """OSGB36 degrees from easting and northing."""
    return _degrees(*_from_grid(easting, northing))


def grid_to_wgs84(easting, northing) -> tuple[np.ndarray, np.ndarray]:
    return _degrees(*_shifted(*_from_grid(easting, northing), AIRY, WGS84, -1.0))


def wgs84_to_grid(lat, lon) -> tuple[np.ndarray, np.ndarray]:
    return _to_grid(*_shifted(*_radians(lat, lon), WGS84, AIRY, 1.0))


def _projected(df: DataFrame, inputs: tuple[str, str], outputs: tuple[str, str], function) -> DataFrame:
    kept = [f for f in df.schema if f.name not in outputs]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{o}` double" for o in outputs)])

    def run(parts):
        for part in parts:
            a, b = function(part[inputs[0]], part[inputs[1]])
            yield part[[f.name for f in kept]].assign(**{outputs[0]: pd.Series(a, index=part.index), outputs[1]: pd.Series(b, index=part.index)})

    return df.mapInPandas(run, schema)


def with_lat_lon(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Adds WGS84 ``lat, lon``."""
    return _projected(df, (easting, northing), ("lat", "lon"), grid_to_wgs84)


def with_grid(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``easting, northing``."""
    return _projected(df, (lat, lon), ("easting", "northing"), wgs84_to_grid)


def bounding_box(corners: tuple[tuple[float, float], tuple[float, float]]) -> tuple[float, float, float, float]:
    """North, west, south, east in degrees of the box with these grid corners."""
    lat, lon = grid_to_wgs84([c[0] for c in corners], [c[1] for c in corners])
    return float(lat.max()), float(lon.min()), float(lat.min()), float(lon.max())
