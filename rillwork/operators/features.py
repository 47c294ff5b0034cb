"""Features along a series and over calendars."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import box_cox, season, season_of_month
from .calendars import bin_of
from .order import Cut, numbered


def lags(df: DataFrame, value: str, upto: int = 7, by: Sequence[str] = ("station",), time: str = "day", prefix: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumns({f"{prefix or value}_lag{i}": F.lag(value, i).over(w) for i in range(1, upto + 1)})


def rolling_days(df: DataFrame, value: str, days: Sequence[int] = (30, 60), by: Sequence[str] = (), time: str = "day") -> DataFrame:
    """Means over the last so many days, the row's own included, however many rows those hold."""
    w = Window.partitionBy(*by).orderBy(F.unix_date(time).cast("long"))
    return df.withColumns({f"rolling_{d}": F.avg(value).over(w.rangeBetween(-(d - 1), 0)) for d in days})


def with_season(df: DataFrame, time: str = "day", monthly: bool = False) -> DataFrame:
    s, c = (season_of_month if monthly else season)(F.col(time))
    return df.withColumns({"season_sin": s, "season_cos": c})


def level_and_dip(df: DataFrame, value: str = "value", key: str = "station", time: str = "day") -> DataFrame:
    """Adds the key's mean and how far its first row (null or not) lies from it."""
    w = Window.partitionBy(key)
    first = F.first(value).over(w.orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({"level_mean": F.avg(value).over(w), "level_dip": first - F.avg(value).over(w)})


def trim(df: DataFrame, start: str, end: str, time: str = "day") -> DataFrame:
    """Rows from start to end, both included."""
    return df.where(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def final_labels(df: DataFrame, quality: str = "quality", data_type: str = "data_type") -> DataFrame:
    """Missing qualities become ``Unchecked`` for raw rows and ``Missing`` for others."""
    return df.withColumn(quality, F.when(F.col(quality).isNull() & (F.col(data_type) == "raw"), "Unchecked").when(F.col(quality).isNull(), "Missing").otherwise(F.col(quality)))


def power_fit(df: DataFrame, value: str, low: float = -2.0, high: float = 2.0, step: float = 0.01, shift: float = 1.0) -> DataFrame:
    """One row ``lambda, log_likelihood``: the Box-Cox power, on a grid, of the greatest profile likelihood for ``value + shift``.

    All grid points are summed in one pass over the rows; rows that are null or not positive after the shift don't count. Values are taken
    over their geometric mean, which a pass before finds: the powers of great values less 1 would keep no digits for low lambdas.
    """
    x = F.col(value) + shift
    rows = df.where(x > 0).select(F.log(x).alias("l"))
    centred = rows.crossJoin(F.broadcast(rows.agg(F.avg("l").alias("c")))).select("l", (F.col("l") - F.col("c")).alias("z"))
    grid = [round(low + step * i, 10) for i in range(round((high - low) / step) + 1)]
    spreads = F.array(*(F.var_pop(F.col("z") if p == 0 else F.expm1(F.col("z") * p) / p) for p in grid))
    moments = centred.agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("s"), F.sum("z").alias("z"), spreads.alias("v"), (F.max("l") > F.min("l")).alias("varied")).where("varied")
    each = moments.select("n", "s", "z", F.posexplode("v").alias("i", "var")).withColumn("lambda", F.round(F.lit(low) + F.lit(step) * F.col("i"), 10))
    likelihood = F.col("lambda") * F.col("z") - F.col("s") - F.col("n") / 2 * F.log("var")
    scored = each.where("var > 0").select("lambda", likelihood.alias("log_likelihood"))
    return scored.orderBy(F.desc("log_likelihood"), "lambda").limit(1)


def skewness(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Population skewness."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skew"))


def rainfall_block(daily: DataFrame, lam: float, frequency: str = "daily", value: str = "rainfall", time: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """``time, rainfall, rolling_30, rolling_60, rainfall_lag1..7``: rolling means of raw values, lags of transformed ones.

    Other frequencies sum the values of a bin and take its first rolling means.
    """
    rolled = rolling_days(daily, value, time=time)
    if frequency != "daily":
        rolled = rolled.groupBy(bin_of(F.col(time), frequency).alias("_bin")).agg(
            F.sum(value).alias(value), F.min_by("rolling_30", time).alias("rolling_30"), F.min_by("rolling_60", time).alias("rolling_60")
        ).withColumnRenamed("_bin", time)
    out = lags(rolled.withColumn(value, box_cox(F.col(value), lam)), value, by=(), time=time, prefix="rainfall")
    return trim(out, start, end, time) if start and end else out


#: Rows of a block of ``running_memory``, at most.
MEMORY_ROWS = 1 << 16


def running_memory(df: DataFrame, value: str, keep: float = 0.9, by: Sequence[str] = ("station",), time: str = "day", cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``memory``: ``keep * memory + (1 - keep) * value`` from 0 on; rows without a value leave it as it is.

    A row maps memory affinely, and such maps compose, so a series is cut into blocks of rows: within a block weights of powers of
    ``keep`` turn the recurrence into a running sum, a block's map is its power of ``keep`` and its last value, and the maps of the blocks
    before, composed in order, give what a block begins with. A row holds a few numbers. With ``cut``, which stores the rows, a
    series of any length is dealt to tasks by time; without, a series is in one task. Either way one task sees a series' blocks, a row each.
    """
    if not 0 < keep < 1:
        return df.withColumn("memory", F.when(F.lit(keep <= 0), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0)))
    size = max(1, min(MEMORY_ROWS, int(460 / -math.log(keep))))  # keep ** -size stays below 1e200
    rows = df.withColumn("_part", F.lit(0)) if cut is None else cut(df.repartitionByRange(*by, time).withColumn("_part", F.spark_partition_id()))
    count = F.count(value).over(Window.partitionBy(*by, "_part").orderBy(time)) - 1  # values up to here
    block, pos = F.greatest(F.floor(F.col("_n") / size), F.lit(0)), F.greatest(F.col("_n"), F.lit(-1))
    rows = rows.withColumn("_n", count).withColumns({"_block": F.shiftleft(F.col("_part").cast("long"), 32) + block, "_pos": pos - block * size})
    within = Window.partitionBy(*by, "_block").orderBy(time)
    weighed = F.sum(F.coalesce(F.col(value) * F.pow(F.lit(1 / keep), F.col("_pos")), F.lit(0.0))).over(within)
    rows = rows.withColumn("_own", (1 - keep) * weighed * F.pow(F.lit(keep), F.greatest("_pos", F.lit(0))))
    maps = rows.groupBy(*by, "_block").agg(F.max_by("_own", "_pos").alias("_end"), (F.max("_pos") + 1).alias("_rows"))

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        start, m = [], 0.0
        for end, n in zip(table.column("_end").to_pylist(), table.column("_rows").to_pylist()):
            start.append(m)
            m = m * keep**n + end
        return table.select([*by, "_block"]).append_column("_start", pa.array(start))

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    begins = maps.groupBy(*by).applyInArrow(compose, ", ".join([*kinds, "_block bigint", "_start double"]))
    begins = begins.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_block").alias("_b"), "_start")
    same = functools.reduce(lambda p, q: p & q, [*(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by), F.col("_block") == F.col("_b")])
    return rows.join(begins, same).withColumn("memory", F.col("_own") + F.col("_start") * F.pow(F.lit(keep), F.col("_pos") + 1)).select(*df.columns, "memory")


def differences(df: DataFrame, value: str, by: Sequence[str] = ("station",), time: str = "day") -> DataFrame:
    """Adds the first and second difference in time."""
    w = Window.partitionBy(*by).orderBy(time)
    once = df.withColumn("diff1", F.col(value) - F.lag(value).over(w))
    return once.withColumn("diff2", F.col("diff1") - F.lag("diff1").over(w))


def supervised_windows(df: DataFrame, value: str, length: int = 7, horizon: int = 1, by: Sequence[str] = ("station",), time: str = "day") -> DataFrame:
    """``by, time, inputs`` (array of ``length``)``, target``: full windows with a target only."""
    w = Window.partitionBy(*by).orderBy(time)
    out = df.withColumns({"inputs": F.collect_list(value).over(w.rowsBetween(-(length - 1), 0)), "target": F.lead(value, horizon).over(w)})
    return out.where((F.size("inputs") == length) & F.col("target").isNotNull()).select(*by, time, "inputs", "target")


def ramp(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Adds ``ramp``: 0 at a group's first row to 1 at its last; 1 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1
    return df.withColumn("ramp", F.when(n == 1, 1.0).otherwise(i / (n - 1)))


def streamflow_block(readings: DataFrame, days: int, start: str, positional: bool = False, time: str = "day", value: str = "flow", threshold: float = 0.01, cut: Cut | None = None) -> DataFrame:
    """``day, flow`` in m3 a day from m3/s: by date, or, if ``positional``, the n-th reading on the calendar's n-th day.

    Missing days are filled along the line if they are fewer than ``threshold`` of all. The calendar, ``days`` rows, is filled by one task.
    """
    from .gaps import fill_linear

    daily = readings.select(F.to_date(time).alias(time), (F.col(value) * 86400).alias(value))
    spark = readings.sparkSession
    frame = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias(time), (F.col("id") + 1).alias("_i"))
    if positional:
        placed = numbered(daily, time, (), "_n", cut).select((F.col("_n") + 1).alias("_i"), value)
        joined = frame.join(placed, "_i", "left").drop("_i")
    else:
        joined = frame.drop("_i").join(daily.groupBy(time).agg(F.avg(value).alias(value)), time, "left")
    filled = fill_linear(joined.withColumn("_one", F.lit(1)), "_one", time, value, name="_filled")
    few = F.avg(F.col(value).isNull().cast("double")).over(Window.partitionBy("_one")) < threshold
    return filled.select(time, F.when(few, F.col("_filled")).otherwise(F.col(value)).alias(value))
