"""Reference predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_of_year_365
from .spatial import nearest_points


def climatology(df: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``station, doy, level, curve, shape``: mean level, mean by day of the year (1 to 365), and their difference."""
    level = F.avg(value).over(Window.partitionBy(key))
    rows = df.withColumns({"doy": day_of_year_365(F.col(time)), "level": level})
    out = rows.groupBy(key, "doy").agg(F.avg(value).alias("curve"), F.first("level", ignorenulls=True).alias("level"))
    return out.withColumn("shape", F.col("curve") - F.col("level"))


def mean_shape(curves: DataFrame) -> DataFrame:
    """``doy, shape``: over all stations."""
    return curves.groupBy("doy").agg(F.avg("shape").alias("shape"))


def inverse_distance(stations: DataFrame, values: DataFrame, k: int = 5, power: float = 2.0, key: str = "station", value: str = "level") -> DataFrame:
    """``station, estimate`` from the ``k`` nearest others' values, weighed by distance to the minus ``power``."""
    near = nearest_points(stations, k, key=key).join(values.select(F.col(key).alias("dst"), F.col(value).alias("_v")), "dst")
    weight = F.pow(F.greatest("distance", F.lit(1e-9)), F.lit(-power))
    return near.groupBy(F.col("src").alias(key)).agg((F.sum(weight * F.col("_v")) / F.sum(weight)).alias("estimate"))


def regional_seasonal(stations: DataFrame, curves: DataFrame, k: int = 5, power: float = 2.0, key: str = "station") -> DataFrame:
    """``station, doy, prediction``: level and shape both from the ``k`` nearest others."""
    near = nearest_points(stations, k, key=key).withColumn("_w", F.pow(F.greatest("distance", F.lit(1e-9)), F.lit(-power)))
    levels = curves.groupBy(F.col(key).alias("dst")).agg(F.first("level").alias("_level"))
    level = near.join(levels, "dst").groupBy("src").agg((F.sum(F.col("_w") * F.col("_level")) / F.sum("_w")).alias("level"))
    shape = near.join(curves.select(F.col(key).alias("dst"), "doy", "shape"), "dst").groupBy("src", "doy").agg((F.sum(F.col("_w") * F.col("shape")) / F.sum("_w")).alias("shape"))
    return shape.join(level, "src").select(F.col("src").alias(key), "doy", (F.col("level") + F.col("shape")).alias("prediction"))


def persistence(df: DataFrame, curves: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Adds ``prediction``: the row before's value, else the climatology of the day."""
    w = Window.partitionBy(key).orderBy(time)
    joined = df.withColumn("doy", day_of_year_365(F.col(time))).join(curves.select(key, "doy", "curve"), [key, "doy"], "left")
    return joined.withColumn("prediction", F.coalesce(F.lag(value).over(w), F.col("curve"))).drop("curve")
