"""Collects queries with the SQL that DuckDB checks them by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name) if name else out


def saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the cluster's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the cluster's shared folder and read back. In a loop this costs less than ``saved``, which carries what Spark knows
    of a plan's columns from round to round."""
    place = f"{shared_root(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as station readings."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("station"), "ts", "value", F.col("event_type").alias("quality"), "event_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as six long daily series."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("station"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("value"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one daily driver series."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("rainfall"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations on a plane."""
    s = table(spark, sf_dir, "supplier")
    x, y = F.pmod("s_suppkey", F.lit(10)), F.floor(F.col("s_suppkey") / 10)
    return s.select(F.col("s_suppkey").alias("node_id"), F.concat(F.lit("s"), "s_suppkey").alias("station"), (x * 1000 + 137.0 + F.pmod("s_suppkey", F.lit(7)) * 90).alias("easting"), (y * 1000 + 211.0 + F.pmod("s_suppkey", F.lit(5)) * 110).alias("northing"), F.col("s_acctbal").alias("level"))


READINGS = "readings AS (SELECT 'u' || user_id AS station, ts, value, event_type AS quality, event_id FROM events)"
DAILY = READINGS + ", daily AS (SELECT station, CAST(ts AS DATE) AS day, avg(value) AS value FROM readings GROUP BY ALL)"
REGULAR = (
    DAILY
    + """, cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
  regular AS (SELECT k.station, cal.day, d.value FROM (SELECT DISTINCT station FROM daily) k CROSS JOIN cal LEFT JOIN daily d USING (station, day))"""
)
SERIES = "series AS (SELECT l_returnflag || l_linestatus AS station, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"
SERIES_REGULAR = (
    SERIES
    + """, cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM series),
  regular AS (SELECT k.station, cal.day, d.value FROM (SELECT DISTINCT station FROM series) k CROSS JOIN cal LEFT JOIN series d USING (station, day))"""
)
RAIN = "rain AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS rainfall FROM orders GROUP BY ALL)"
STATIONS = "stations AS (SELECT s_suppkey AS node_id, 's' || s_suppkey AS station, s_suppkey % 10 * 1000 + 137.0::DOUBLE + s_suppkey % 7 * 90 AS easting, s_suppkey // 10 * 1000 + 211.0::DOUBLE + s_suppkey % 5 * 110 AS northing, s_acctbal AS level FROM supplier)"
