"""Calendars, bins and resampling of station series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREQUENCIES = {"daily": "D", "weekly": "W-MON", "monthly": "MS"}
_STEPS = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month"}


def bin_of(ts: Column, frequency: str) -> Column:
    """The bin's label: the day; the Monday that closes Tuesday to Monday; the first of the month."""
    day = F.to_date(ts)
    if frequency == "daily":
        return day
    if frequency == "weekly":
        return F.date_add(F.trunc(F.date_sub(day, 1), "week"), 7)
    if frequency == "monthly":
        return F.trunc(day, "month")
    raise ValueError(f"frequency must be one of {', '.join(FREQUENCIES)}, not {frequency!r}")


def steps_between(start: Column, end: Column, frequency: str) -> Column:
    """Labels of all bins from the first label not before ``start`` to the last not after ``end``; null if none."""
    first = {"daily": start, "weekly": bin_of(start, "weekly"), "monthly": F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))}
    if frequency not in first:
        raise ValueError(f"frequency must be one of {', '.join(FREQUENCIES)}, not {frequency!r}")
    begin = first[frequency]
    return F.when(begin <= end, F.sequence(begin, end, F.expr(f"interval {_STEPS[frequency]}")))


def calendar(spark: SparkSession, start: str, end: str, frequency: str = "daily", name: str = "day") -> DataFrame:
    one = spark.range(1)
    return one.select(F.explode(steps_between(F.lit(start).cast("date"), F.lit(end).cast("date"), frequency)).alias(name))


def first_by(value: str, time: str) -> Column:
    """The first non-null value by time."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(time)))


def resample(df: DataFrame, frequency: str, key: str = "station", time: str = "ts", value: str = "value", modes: Sequence[str] = (), firsts: Sequence[str] = (), name: str = "day") -> DataFrame:
    """One row for each key and bin: mean value, most frequent of ``modes`` (least of ties), first of ``firsts``."""
    return df.groupBy(key, bin_of(F.col(time), frequency).alias(name)).agg(
        F.avg(value).alias(value),
        *(F.mode(m, True).alias(m) for m in modes),
        *(first_by(f, time).alias(f) for f in firsts),
    )


def resample_sum(df: DataFrame, frequency: str, value: str, time: str = "ts", key: Sequence[str] = (), name: str = "day") -> DataFrame:
    return df.groupBy(*key, bin_of(F.col(time), frequency).alias(name)).agg(F.sum(value).alias(value))


def reindex(df: DataFrame, frequency: str = "daily", key: str = "station", time: str = "day", start: str | None = None, end: str | None = None, common: bool = False) -> DataFrame:
    """Every bin of the calendar for every key; columns are null where ``df`` has no row.

    The calendar runs from ``start`` to ``end``, or each key's own first to last bin, or, if ``common``, those of all keys.
    """
    spans = df.groupBy(key).agg(F.min(time).alias("_start"), F.max(time).alias("_end"))
    if common:
        whole = spans.agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))  # one row
        spans = spans.select(key).crossJoin(F.broadcast(whole))
    low = F.lit(start).cast("date") if start else F.col("_start")
    high = F.lit(end).cast("date") if end else F.col("_end")
    frame = spans.select(key, F.explode(steps_between(low, high, frequency)).alias(time))
    return frame.join(df, [key, time], "left")
