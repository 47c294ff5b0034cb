"""Gating and cleaning of station readings."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .order import Cut, numbered

RULE_SCHEMA = "seq int, station string, op string, start timestamp, end timestamp, amount double"


def gate_by_count(df: DataFrame, more_than: int, key: str = "station") -> DataFrame:
    """Rows of keys that have more than so many rows."""
    large = df.groupBy(key).count().where(F.col("count") > more_than).select(key)
    return df.join(large, key, "left_semi")


def rule_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    """Corrections ``(seq, station, op, start, end, amount)``; bounds count as within."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def apply_rules(df: DataFrame, rules: DataFrame, key: str = "station", time: str = "ts", value: str = "value", quality: str = "quality") -> DataFrame:
    """``shift`` adds the amount, ``mirror`` reflects a range at its own mean and adds the amount, ``null`` removes.

    Shifts come first, then mirrors, then removals, which also set the quality to ``Missing``. A rule's rows are found by its
    station, so the join is on equal keys with the range as a filter.
    """
    ranked = rules.select(F.col("station").alias("_station"), "op", F.col("start").alias("_from"), F.col("end").alias("_to"), "amount", F.struct("seq", "station", "start").alias("_rule"))
    inside = (F.col(key) == F.col("_station")) & F.col(time).between(F.col("_from"), F.col("_to"))
    hits = df.select(key, time, value).join(ranked, inside)
    shifts = hits.groupBy(key, time).agg(
        F.coalesce(F.sum(F.when(F.col("op") == "shift", F.col("amount"))), F.lit(0.0)).alias("_shift"),
        F.max(F.when(F.col("op") == "mirror", F.struct("_rule", "amount"))).alias("_mirror"),
        F.max((F.col("op") == "null").cast("int")).alias("_null"),
    )
    joined = df.join(shifts, [key, time], "left").withColumn(value, F.col(value) + F.coalesce("_shift", F.lit(0.0)))
    mean = F.avg(F.when(F.col("_mirror").isNotNull(), F.col(value))).over(Window.partitionBy(key, "_mirror._rule"))
    joined = joined.withColumn(value, F.when(F.col("_mirror").isNotNull(), 2 * mean - F.col(value) + F.col("_mirror.amount")).otherwise(F.col(value)))
    gone = F.coalesce(F.col("_null"), F.lit(0)) == 1
    out = joined.withColumn(value, F.when(~gone, F.col(value)))
    if quality in df.columns:
        out = out.withColumn(quality, F.when(gone, "Missing").otherwise(F.col(quality)))
    return out.select(df.columns)


def quartile_bounds(df: DataFrame, k: float = 5.0, key: str = "station", value: str = "value") -> DataFrame:
    """``key, low, high``: the quartiles less and plus ``k`` times their distance (exact, interpolated)."""
    q = df.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select(key, (F.col("q")[0] - k * spread).alias("low"), (F.col("q")[1] + k * spread).alias("high"))


def quartile_gate(df: DataFrame, k: float = 5.0, key: str = "station", value: str = "value") -> DataFrame:
    """Values outside their key's bounds become null."""
    joined = df.join(quartile_bounds(df, k, key, value), key, "left")
    return joined.withColumn(value, F.when(F.col(value).between(F.col("low"), F.col("high")), F.col(value))).select(df.columns)


def rolling_median(df: DataFrame, window: int = 30, least: int = 10, key: str = "station", time: str = "ts", value: str = "value", name: str = "median") -> DataFrame:
    """Adds the median of the last ``window`` rows where at least ``least`` of them have a value."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-(window - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def segment_end_flags(df: DataFrame, window: int = 30, least: int = 10, threshold: float = 0.3, key: str = "station", time: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``segment_end``: off the rolling median by more than the threshold and followed by a gap within two rows."""
    w = Window.partitionBy(key).orderBy(time)
    gap = F.lead(value, 1).over(w).isNull() | F.lead(value, 2).over(w).isNull()
    out = rolling_median(df, window, least, key, time, value, "_median")
    off = F.coalesce(F.abs(F.col(value) - F.col("_median")) > threshold, F.lit(False))
    return out.withColumn("segment_end", off & gap).drop("_median")


#: Rows of a block of ``hampel``, besides half a window on each side.
HAMPEL_ROWS = 1 << 14
#: Values of windows that are sorted together.
HAMPEL_VALUES = 1 << 20


def _middle(ordered: np.ndarray) -> np.ndarray:
    """Medians of rows whose numbers are ascending, NaN last and left out; NaN for none."""
    n = np.count_nonzero(~np.isnan(ordered), axis=1)[:, None]
    low, high = (np.take_along_axis(ordered, np.maximum(k, 0), axis=1)[:, 0] for k in ((n - 1) // 2, n // 2))
    return np.where(n[:, 0] > 0, (low + high) / 2, np.nan)


def window_medians(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of each full window of ``width`` values, NaN left out."""
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    medians, deviations = np.empty(len(windows)), np.empty(len(windows))
    step = max(1, HAMPEL_VALUES // width)
    for k in range(0, len(windows), step):
        held = np.sort(windows[k : k + step], axis=1)
        medians[k : k + step] = _middle(held)
        deviations[k : k + step] = _middle(np.sort(np.abs(held - medians[k : k + step, None]), axis=1))
    return medians, deviations


def hampel(df: DataFrame, window: int = 250, sigmas: float = 10.0, key: str = "station", time: str = "ts", value: str = "value", cut: Cut | None = None) -> DataFrame:
    """Adds ``hampel`` (flag) and ``hampel_value``: outliers replaced by the median of the rows around.

    Half a window lies on each side; rows nearer than that to either end are never outliers. The spread is 1.4826 times the median
    absolute deviation. Nulls and NaN count in the window but not in the medians.

    A series is cut into blocks of ``HAMPEL_ROWS``, each with the rows of half a window around it, so a task's memory doesn't
    depend on a series' length, and no row carries its window. With ``cut``, which stores rows, a series is numbered by all tasks.
    """
    half = window // 2
    rows = numbered(df, time, [key], "_i", cut)
    block = lambda i: F.floor(i / HAMPEL_ROWS)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.greatest(block(F.col("_i") - half), F.lit(0)), block(F.col("_i") + half))))

    def flag(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        v = np.asarray(table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
        i = table.column("_i").to_numpy()
        out, median = np.zeros(len(v), bool), np.full(len(v), np.nan)
        if len(v) > 2 * half:
            middle = slice(half, len(v) - half)
            median[middle], spread = window_medians(v, 2 * half + 1)
            with np.errstate(invalid="ignore"):
                out[middle] = np.abs(v[middle] - median[middle]) > sigmas * (1.4826 * spread)
        own = pa.array(i // HAMPEL_ROWS == table.column("_block").to_numpy())
        shown = pa.array(np.where(out, median, v), from_pandas=True)
        return table.drop_columns(["_i", "_block"]).append_column("hampel", pa.array(out)).append_column("hampel_value", shown).filter(own)

    schema = StructType([*df.schema.fields, StructField("hampel", BooleanType()), StructField("hampel_value", DoubleType())])
    return rows.groupBy(key, "_block").applyInArrow(flag, schema)


def fuse_outliers(df: DataFrame, value: str = "value", quality: str = "quality", good: str = "Good") -> DataFrame:
    """Needs ``hampel, hampel_value, segment_end``. Good readings stay; so do those with both flags; one flag acts."""
    open_ = F.coalesce(F.col(quality) != good, F.lit(True))
    only_hampel, only_end = F.col("hampel") & ~F.col("segment_end"), F.col("segment_end") & ~F.col("hampel")
    fused = F.when(open_ & only_hampel, F.col("hampel_value")).when(open_ & only_end, F.lit(None)).otherwise(F.col(value))
    return df.withColumn(value, fused)


def clean(df: DataFrame, rules: DataFrame | None = None, window: int = 250, sigmas: float = 10.0, key: str = "station", time: str = "ts", value: str = "value", quality: str = "quality", cut: Cut | None = None) -> DataFrame:
    """Corrections by rule, the quartile gate, then the two outlier tests on the gated series, fused."""
    out = apply_rules(df, rules, key, time, value, quality) if rules is not None else df
    out = quartile_gate(out, key=key, value=value)
    out = hampel(segment_end_flags(out, key=key, time=time, value=value), window, sigmas, key, time, value, cut)
    return fuse_outliers(out, value, quality).drop("hampel", "hampel_value", "segment_end")
