"""Runs of missing values and their filling along a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(key: str, time: str):
    return Window.partitionBy(key).orderBy(time)


def _held(held: Column, key: str, time: str, nearest: int = 0) -> tuple[Column, Column]:
    """The last non-null ``held`` up to a row and the first from it on, or, with ``nearest`` -1, strictly before and after.

    The second looks back along the reversed series: a frame that reaches forward to the end would be walked anew for each row.
    """
    before = _along(key, time).rowsBetween(Window.unboundedPreceding, nearest)
    behind = Window.partitionBy(key).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, nearest)
    return F.last(held, ignorenulls=True).over(before), F.last(held, ignorenulls=True).over(behind)


def runs(df: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Adds ``run`` (number of the stretch of present or missing values) and ``missing``."""
    w = _along(key, time)
    missing = F.col(value).isNull()
    change = F.coalesce((missing != F.lag(missing).over(w)).cast("int"), F.lit(1))
    return df.withColumn("missing", missing).withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def gap_runs(df: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``key, run, start, end, n, touches_edge`` of each stretch of missing values in a regular series."""
    w = Window.partitionBy(key)
    marked = runs(df, key, time, value).withColumns({"_first": F.min(time).over(w), "_last": F.max(time).over(w)})
    return (
        marked.where("missing")
        .groupBy(key, "run")
        .agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), F.max((F.col(time) == F.col("_first")) | (F.col(time) == F.col("_last"))).alias("touches_edge"))
    )


def day_segments(df: DataFrame, key: str = "station", time: str = "day", longest: int | None = None) -> DataFrame:
    """``key, start, end, n``: stretches of rows a day apart; those over ``longest`` days are left out."""
    island = F.date_sub(F.col(time), F.row_number().over(_along(key, time)))
    out = df.select(key, time).withColumn("_island", island).groupBy(key, "_island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")
    return out.where(F.col("n") <= longest) if longest else out


def neighbours(df: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Adds the last value before and the first after each row, and their times."""
    before, after = _held(F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v"))), key, time, -1)
    out = df.withColumns({"_p": before, "_n": after})
    return out.withColumns({"prev_value": F.col("_p.v"), "prev_time": F.col("_p.t"), "next_value": F.col("_n.v"), "next_time": F.col("_n.t")}).drop("_p", "_n")


def fill_linear(df: DataFrame, key: str = "station", time: str = "day", value: str = "value", both: bool = False, name: str = "filled") -> DataFrame:
    """Adds ``name``: by place between neighbours; after the last value that value, before the first null (its value if ``both``)."""
    w = _along(key, time)
    numbered = df.withColumn("_i", F.row_number().over(w))
    before, after = _held(F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))), key, time)
    placed = numbered.withColumns({"_p": before, "_n": after})
    share = F.try_divide((F.col("_i") - F.col("_p.i")).cast("double"), (F.col("_n.i") - F.col("_p.i")).cast("double"))
    between = F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v"))
    out = F.coalesce(F.col(value), between, F.col("_p.v"), *([F.col("_n.v")] if both else []))
    return placed.withColumn(name, out).drop("_i", "_p", "_n")


def _edge_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """One-sided three-point slope at an end, kept in sign and within three times the secant."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(m0), 0.0).when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0).otherwise(d)


def fill_monotone(df: DataFrame, key: str = "station", time: str = "day", value: str = "value", name: str = "filled") -> DataFrame:
    """Adds ``name``: monotone cubic interpolation over days between values; outside them null.

    Slopes are weighted harmonic means of the secants (Fritsch and Butland, 1984), so only two neighbours on either side of a
    gap are looked at and a window suffices. With two values it is the line through them.
    """
    points = df.where(F.col(value).isNotNull()).select(key, F.col(time).alias("_t"), F.datediff(F.col(time), F.lit("1970-01-01")).cast("double").alias("_x"), F.col(value).cast("double").alias("_y"))
    w = Window.partitionBy(key).orderBy("_t")
    x, y = F.col("_x"), F.col("_y")
    gap = lambda k: F.lead(x, k).over(w) - (F.lead(x, k - 1).over(w) if k > 1 else x) if k > 0 else (F.lag(x, -k).over(w) if k else x) - F.lag(x, 1 - k).over(w)
    rise = lambda k: F.lead(y, k).over(w) - (F.lead(y, k - 1).over(w) if k > 1 else y) if k > 0 else (F.lag(y, -k).over(w) if k else y) - F.lag(y, 1 - k).over(w)
    # h and m: lengths and secants of the two intervals after (1, 2) and before (0, -1) a point
    points = points.withColumns({"_h1": gap(1), "_h2": gap(2), "_h0": gap(0), "_hb": gap(-1)})
    points = points.withColumns({"_m1": rise(1) / F.col("_h1"), "_m2": rise(2) / F.col("_h2"), "_m0": rise(0) / F.col("_h0"), "_mb": rise(-1) / F.col("_hb")})
    h0, h1, m0, m1 = (F.col(c) for c in ("_h0", "_h1", "_m0", "_m1"))
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(m0 * m1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / m0 + w2 / m1))
    slope = (
        F.when(m0.isNull() & m1.isNull(), 0.0)
        .when(m0.isNull(), F.when(F.col("_m2").isNull(), m1).otherwise(_edge_slope(h1, F.col("_h2"), m1, F.col("_m2"))))
        .when(m1.isNull(), F.when(F.col("_mb").isNull(), m0).otherwise(_edge_slope(h0, F.col("_hb"), m0, F.col("_mb"))))
        .otherwise(inner)
    )
    knots = points.select(key, F.col("_t").alias(time), F.struct(x.alias("x"), y.alias("y"), slope.alias("d")).alias("_knot"))
    before, after = _held(F.col("_knot"), key, time)
    placed = df.join(knots, [key, time], "left").withColumns({"_p": before, "_n": after})
    h = F.col("_n.x") - F.col("_p.x")
    s = F.try_divide(F.datediff(F.col(time), F.lit("1970-01-01")) - F.col("_p.x"), h)
    cubic = (2 * s**3 - 3 * s**2 + 1) * F.col("_p.y") + (s**3 - 2 * s**2 + s) * h * F.col("_p.d") + (3 * s**2 - 2 * s**3) * F.col("_n.y") + (s**3 - s**2) * h * F.col("_n.d")
    return placed.withColumn(name, F.coalesce(F.col(value).cast("double"), cubic)).drop("_knot", "_p", "_n")


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points, with a continuous third derivative at the second and last but one (not-a-knot)."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]) if n else np.full(len(at), np.nan)
    h = np.diff(x)
    secant = np.diff(y) / h
    lower, middle, upper, right = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    lower[1:-1], middle[1:-1], upper[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * secant[:-1] + h[:-1] * secant[1:])
    middle[0], upper[0] = h[1], h[0] + h[1]
    right[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * secant[0] + h[0] ** 2 * secant[1]) / (h[0] + h[1])
    middle[-1], lower[-1] = h[-2], h[-1] + h[-2]
    right[-1] = (h[-1] ** 2 * secant[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * secant[-1]) / (h[-1] + h[-2])
    slope = right.copy()
    for i in range(1, n):  # elimination along the band
        factor = lower[i] / middle[i - 1]
        middle[i] -= factor * upper[i - 1]
        slope[i] -= factor * slope[i - 1]
    slope[-1] /= middle[-1]
    for i in range(n - 2, -1, -1):
        slope[i] = (slope[i] - upper[i] * slope[i + 1]) / middle[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    c2 = (3 * secant[k] - 2 * slope[k] - slope[k + 1]) / h[k]
    c3 = (slope[k] + slope[k + 1] - 2 * secant[k]) / h[k] ** 2
    return y[k] + t * (slope[k] + t * (c2 + t * c3))


def fill_spline(df: DataFrame, key: str = "station", time: str = "day", value: str = "value", name: str = "filled") -> DataFrame:
    """Adds ``name``: cubic spline between values, outside them null. One series is one task's."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time)
        x = pd.to_datetime(part[time]).to_numpy("datetime64[D]").astype(float)
        y = part[value].to_numpy(float)
        known = ~np.isnan(y)
        out = y.copy()
        if known.sum() >= 2:
            holes = ~known & (x >= x[known].min()) & (x <= x[known].max())
            out[holes] = spline_values(x[known], y[known], x[holes])
        return part.assign(**{name: out})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(key).applyInPandas(fill, f"{columns}, {name} double")


METHODS = {"linear": fill_linear, "pchip": fill_monotone, "spline": fill_spline}


def interpolate(df: DataFrame, method: str = "pchip", **columns) -> DataFrame:
    """By ``linear``, ``spline`` or, for any other name, ``pchip``."""
    return METHODS.get(method, fill_monotone)(df, **columns)


def fill_short_gaps(df: DataFrame, longest: int = 25, method: str = "pchip", key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Fills inner gaps of at most ``longest`` rows; adds ``data_type``: ``interpolated_short`` or ``raw``.

    Series with fewer than two values stay as they are.
    """
    filled = interpolate(runs(df, key, time, value), method, key=key, time=time, value=value, name="_filled")
    per_run, whole = Window.partitionBy(key, "run"), Window.partitionBy(key)
    marked = filled.withColumns({"_n": F.count(F.lit(1)).over(per_run), "_last_run": F.max("run").over(whole), "_known": F.count(value).over(whole)})
    inner = F.col("missing") & (F.col("_n") <= longest) & (F.col("run") > 1) & (F.col("run") < F.col("_last_run")) & (F.col("_known") >= 2)
    out = marked.withColumn("data_type", F.when(inner, "interpolated_short").otherwise("raw")).withColumn(value, F.when(inner, F.col("_filled")).otherwise(F.col(value)))
    return out.select(*df.columns, "data_type")


def long_gap_queue(before: DataFrame, after: DataFrame, key: str = "station", time: str = "day", value: str = "value", off_by_one: bool = False) -> DataFrame:
    """``key, missing, filled, longest``: series that still have gaps after the short ones were filled.

    ``off_by_one`` leaves out those with a single hole left.
    """
    counts = before.groupBy(key).agg(F.count(F.when(F.col(value).isNull(), 1)).alias("missing"))
    filled = after.groupBy(key).agg(F.count(F.when(F.col("data_type") == "interpolated_short", 1)).alias("filled"))
    rest = gap_runs(after, key, time, value).groupBy(key).agg(F.max("n").alias("longest"))
    joined = counts.join(filled, key).join(rest, key)
    return joined.where(F.col("filled") + (1 if off_by_one else 0) < F.col("missing"))


def imputable_holes(df: DataFrame, longest: int = 200, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``key, time`` of the missing rows to impute: all if at most ``longest``, else those in runs of at most that."""
    marked = runs(df, key, time, value).where("missing")
    sized = marked.withColumns({"_all": F.count(F.lit(1)).over(Window.partitionBy(key)), "_n": F.count(F.lit(1)).over(Window.partitionBy(key, "run"))})
    return sized.where((F.col("_all") <= longest) | (F.col("_n") <= longest)).select(key, time)
