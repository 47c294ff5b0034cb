"""Scalar expressions: names, numbers, dates, hashes and coordinates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0


def normal_name(c: Column) -> Column:
    """Lower case, trimmed, blanks as underscores."""
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def title_name(c: Column) -> Column:
    return F.initcap(F.trim(c))


def last_segment(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, -1)


def file_token(c: Column) -> Column:
    """A number as part of a file name: the point becomes a hyphen."""
    return F.replace(c.cast("string"), F.lit("."), F.lit("-"))


def to_number(c: Column) -> Column:
    """Double, or null where the text is no finite number."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def to_time(c: Column) -> Column:
    return c.try_cast("timestamp")


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Bounded value; null stays null (``greatest`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Nearly equal, or both null."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def mapped(c: Column, values: Mapping, default=None, keep: bool = False) -> Column:
    """Lookup in a literal map; ``keep`` leaves unmatched values, else they become ``default``."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, c if keep else F.lit(default))


def mean_of_available(*columns: Column) -> Column:
    """Mean of those that are not null; null if all are."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, total / count)


def priority_class(values: Column, order: Sequence[str], many: int = 3, mixed: str = "Mixed") -> Column:
    """One class for a list: ``mixed`` from ``many`` entries on, else the first of ``order`` that it holds."""
    out = F.when(F.size(values) >= many, F.lit(mixed))
    for name in order:
        out = out.when(F.array_contains(values, name), F.lit(name))
    return out


def stable_bucket(c: Column, buckets: int = 10000) -> Column:
    """The MD5 of a name as one 128-bit number, modulo ``buckets``."""
    half = lambda start: F.conv(F.substring(F.md5(c.cast("binary")), start, 16), 16, 10).cast("decimal(20,0)")
    scale = (1 << 64) % buckets
    high, low = F.pmod(half(1), F.lit(buckets)), F.pmod(half(17), F.lit(buckets))
    return ((high * scale + low) % buckets).cast("long")


def day_of_year_365(d: Column) -> Column:
    """Day of the year with 29 February counted as 28 February's successor's twin: 1 to 365."""
    n = F.dayofyear(d)
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29
    return F.when(leap & (n >= 60), n - 1).otherwise(n)


def season(d: Column, period: float = 365.25) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.dayofyear(d) / period
    return F.sin(angle), F.cos(angle)


def season_of_month(d: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.month(d) / 12
    return F.sin(angle), F.cos(angle)


def spread(x: str | Column) -> Column:
    """Population spread as an aggregate, 0 where all values are equal: merged from several tasks, ``stddev_pop`` may leave 1e-17 there."""
    return F.when(F.max(x) - F.min(x) == 0, 0.0).otherwise(F.stddev_pop(x))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null where either side doesn't vary (``corr`` would divide by zero)."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a)) if isinstance(a, str) else a for a, b in ((x, y), (y, x)))
    return F.try_divide(F.covar_pop(x, y), spread(x) * spread(y))


def decay_score(correlation: Column, distance_m: Column, k: float = 0.05) -> Column:
    """Correlation fading with distance in km; 0 where either is missing or 0."""
    value = correlation * F.exp(-k * distance_m / 1000)
    return F.when(correlation.isNull() | distance_m.isNull() | (correlation == 0) | (distance_m == 0), 0.0).otherwise(value)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The root of the sum of squares as such: ``hypot`` may differ from it in the last bit."""
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def cell_area(lat: Column, dlat: float, dlon: float) -> Column:
    """Area in m2 of a cell centred at ``lat``, degrees, on the sphere."""
    top, bottom = F.radians(lat + dlat / 2), F.radians(lat - dlat / 2)
    return EARTH_RADIUS_M**2 * math.radians(dlon) * (F.sin(top) - F.sin(bottom))


def grid_easting_northing(ref: Column, base_e: Column, base_n: Column) -> tuple[Column, Column]:
    """Metres from a reference's digits (any even number) and its square's base."""
    digits = F.regexp_replace(F.upper(ref), "[^0-9]", "")
    half = F.floor(F.length(digits) / 2).cast("int")
    even = F.length(digits) % 2 == 0
    part = lambda start: F.rpad(F.substring(digits, start, half), 5, "0").try_cast("long")
    return F.when(even, base_e + part(F.lit(1))), F.when(even, base_n + part(half + 1))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def box_cox(c: Column, lam: Column | float, shift: float = 1.0) -> Column:
    """``((c + shift)^lam - 1) / lam``, or the logarithm at 0."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    x = c + shift
    return F.when(lam == 0, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def box_cox_inverse(c: Column, lam: Column | float, shift: float = 1.0) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lam == 0, F.exp(c)).otherwise(F.pow(lam * c + 1, 1 / lam)) - shift
