"""Gridded archives: written from the tables to the shared folder by the library's sinks, and read again by its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import geotiff, grib, netcdf, retrieval, tables
from .registry import query, r, shared_root, table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/archives/{uuid.uuid4().hex}/{name}"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the cells of a grid, 50 a row."""
    p = table(spark, d, "part")
    return p.select((F.pmod("p_partkey", F.lit(50)) * 25 + 12.5).alias("x"), (F.floor(F.col("p_partkey") / 50) * 25 + 12.5).alias("y"), F.col("p_size").cast("double").alias("value"))


_CELLS = "cells AS (SELECT p_partkey % 50 * 25 + 12.5::DOUBLE AS x, p_partkey // 50 * 25 + 12.5::DOUBLE AS y, p_size::DOUBLE AS value FROM part)"


@query(f"WITH {_CELLS} SELECT x, y, value FROM cells")
def s14_geotiff(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "sizes")
    geotiff.write_geotiff(_cells(spark, d), place, 25.0, tile=32, rows=8)
    return geotiff.read_geotiff(spark, place).select("x", "y", "value")


@query(f"WITH {_CELLS} SELECT x, y, value FROM cells WHERE x > 300 AND x <= 700 AND y BETWEEN 100 AND 900")
def s14_geotiff_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Only strips that meet the bounds are opened."""
    place = _place(spark, "sizes")
    geotiff.write_geotiff(_cells(spark, d), place, 25.0, tile=32, rows=8, deflate=False)
    return geotiff.read_geotiff(spark, place).where("x > 300 and x <= 700 and y between 100 and 900").select("x", "y", "value")


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a grid over days: line number by return flag."""
    li = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 10.0).when(F.col("l_returnflag") == "N", 20.0).otherwise(30.0)
    return li.groupBy(F.to_timestamp(F.to_date("l_shipdate")).alias("time"), F.col("l_linenumber").cast("double").alias("y"), flag.alias("x")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


_PRICES = "SELECT CAST(l_shipdate AS DATE) AS day, l_linenumber::DOUBLE AS y, CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END::DOUBLE AS x, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL"


@query(_PRICES)
def s12_k07_netcdf_months(spark: SparkSession, d: str) -> DataFrame:
    """A NetCDF file a month, of which each gives the days of its own month."""
    place = _place(spark, "prices")
    netcdf.write_netcdf(_prices(spark, d), place, "prices", "price")
    read = tables.of_own_month(netcdf.read_netcdf(spark, place, "price"), prefix="prices")
    return read.select(F.to_date("time").alias("day"), "y", "x", r("value", 2))


@query(f"SELECT * FROM ({_PRICES}) WHERE day >= DATE '1995-03-10' AND day < DATE '1996-03-10' AND y <= 3 AND x = 20")
def s12_netcdf_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Steps and rows of the grid outside the bounds aren't read."""
    place = _place(spark, "prices")
    netcdf.write_netcdf(_prices(spark, d), place, "prices", "price")
    read = netcdf.read_netcdf(spark, place).where("time >= timestamp'1995-03-10 00:00:00' and time < timestamp'1996-03-10 00:00:00' and y <= 3 and x = 20")
    return read.select(F.to_date("time").alias("day"), "y", "x", r("value", 2))


@query(_PRICES)
def s13_grib_months(spark: SparkSession, d: str) -> DataFrame:
    """A GRIB file a month; a damaged file is passed over."""
    place = _place(spark, "prices")
    grib.write_grib(_prices(spark, d), place, "era_prices")
    read = tables.of_own_month(grib.read_grib(spark, place, skip_damaged=True), prefix="era")
    return read.select(F.to_date("time").alias("day"), "y", "x", r("value", 2))


@query(_PRICES)
def s10_archive_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Months that an archive holds, each retrieved once by ledgered tasks; a second run finds nothing to do."""
    remote, place = _place(spark, "remote"), _place(spark, "retrieved")
    netcdf.write_netcdf(_prices(spark, d), remote, "prices", "price")
    span = table(spark, d, "lineitem").agg(F.min("l_shipdate").cast("date").cast("string"), F.max("l_shipdate").cast("date").cast("string")).first()
    months = retrieval.archive_months(spark, *span, remote, "prices", ".nc")
    for _ in range(2):
        retrieval.retrieve(months, place, retrieval.fetch_file)
    files = [r["path"] for r in retrieval.retrieved_files(spark, place).collect()]  # a row a month
    return netcdf.read_netcdf(spark, files, "price").select(F.to_date("time").alias("day"), "y", "x", r("value", 2))


#: Consecutive events that one station of the service holds.
_HELD = 50_000


def _station() -> Column:
    return F.floor(F.col("event_id") / _HELD).alias("station")


def _service(spark: SparkSession, d: str) -> str:
    """Readings of each station and kind of event in a folder of their own, as a landed copy of the service; more events are more measures."""
    place = _place(spark, "service")
    e = table(spark, d, "events").select(_station(), "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("dateTime"), F.to_date("ts").cast("string").alias("date"), "value", F.lit("Good").alias("quality"))
    e.repartition("station").write.partitionBy("station", "event_type").parquet(place)
    return place


_READ = "SELECT event_type AS measure, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS \"dateTime\", round(value, 6) AS value FROM events"


def _measures(spark: SparkSession, d: str, service: str) -> DataFrame:
    kinds = table(spark, d, "events").select(_station(), "event_type").distinct()
    return kinds.select(F.concat(F.lit(service + "/station="), "station", F.lit("/event_type="), "event_type").alias("measure_uri"))


def _readings(df: DataFrame) -> DataFrame:
    return df.select(F.element_at(F.split("measure", "="), -1).alias("measure"), "dateTime", r("value"))


@query(_READ)
def s06_s07_download(spark: SparkSession, d: str) -> DataFrame:
    """All pages of every measure; a second download adds nothing."""
    place, measures = _place(spark, "readings"), _measures(spark, d, _service(spark, d))
    for _ in range(2):
        out = tables.download(spark, measures, place, limit=700, fetch=tables.replay)
    return _readings(out)


@query(f"WITH span AS (SELECT CAST(min(ts) AS DATE) + 3 AS first, CAST(min(ts) AS DATE) + 20 AS last FROM events) {_READ}, span WHERE CAST(ts AS DATE) BETWEEN first AND last + 1")
def s09_flow_readings(spark: SparkSession, d: str) -> DataFrame:
    """Flows of a span of days, with the day after its last."""
    first = table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("d")).select(F.date_add("d", 3).cast("string"), F.date_add("d", 20).cast("string")).first()
    out = tables.download(spark, _measures(spark, d, _service(spark, d)), _place(spark, "flows"), start=first[0], end=first[1], limit=700, flow=True, fetch=tables.replay)
    return _readings(out)


@query("SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS station_name, CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 5 > 0 THEN 'm' || s_suppkey END AS measure_uri FROM supplier")
def s03_s04_station_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stations of a landed service, looked up by id; a missing station, or one whose measures fail, is null."""
    place = _place(spark, "stations")
    s = table(spark, d, "supplier")
    station = F.to_json(F.struct(F.concat(F.lit(place + "/id="), "s_suppkey").alias("@id"), F.col("s_name").alias("label")))
    answers = s.where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("id"), station.alias("station"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("m"), "s_suppkey")).alias("measure"))
    answers = answers.withColumn("ids", F.floor(F.col("id") / tables.IDS))
    answers.repartition("ids").write.partitionBy("ids").parquet(place)
    asked = s.select(F.col("s_suppkey").alias("station_id")).repartitionByRange("station_id").sortWithinPartitions("station_id")
    found = tables.look_up_stations(asked, place, fetch=tables.replay_station)
    return tables.station_details(found).select("station_id", "station_name", "measure_uri")
