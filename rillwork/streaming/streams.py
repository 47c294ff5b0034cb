"""Streams of readings: windows, sessions, and state by station."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import shared_root

READING = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Readings from Parquet files as they land, ``files`` a batch."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # as a pattern, since the source takes a plain path for a folder
    rows = spark.readStream.schema(READING).option("maxFilesPerTrigger", files).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return rows.select(F.concat(F.lit("u"), "user_id").alias("station"), "ts", "value", F.col("event_type").alias("quality"), "event_id")


def tumbling(rows: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``station, start, n, value`` (mean) of each window; rows later than ``late`` are dropped, and a window is final then."""
    out = rows.withWatermark("ts", late).groupBy("station", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return out.select("station", F.col("w.start").alias("start"), "n", "value")


def sliding(rows: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy("station", F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return out.select("station", F.col("w.start").alias("start"), "n", "value")


def sessions(rows: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """``station, start, end, n``: stretches without a pause of ``gap``; ``end`` is the last reading plus the gap."""
    out = rows.withWatermark("ts", late).groupBy("station", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """The readings without repeats of an ``event_id`` within the delay."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def memories(rows: DataFrame, keep: float = 0.9) -> DataFrame:
    """``station, ts, memory, last``: for each batch and station, the running memory and last value after it.

    The state is one pair of numbers a station; a batch's readings are taken in order of time.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, last, when = state.get if state.exists else (0.0, None, None)
        rows_ = pd.concat(parts).sort_values(["ts", "event_id"])
        for ts, value in zip(rows_["ts"], rows_["value"]):
            if value == value:
                memory, last, when = keep * memory + (1 - keep) * value, value, ts
        state.update((float(memory), None if last is None else float(last), None if when is None else pd.Timestamp(when).to_pydatetime()))
        yield pd.DataFrame({"station": [key[0]], "ts": [when], "memory": [memory], "last": [last]})

    return rows.groupBy("station").applyInPandasWithState(update, "station string, ts timestamp, memory double, last double", "memory double, last double, ts timestamp", "update", "NoTimeout")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table of Parquet files in the shared folder.

    In modes other than append each batch writes a folder of its number, which a batch that is tried again overwrites: every
    batch's rows are there once. Of complete mode the last batch's rows are the result.
    """
    spark = stream.sparkSession
    place = f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{place}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/rows")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows" if mode == "complete" else f"{place}/rows/batch={batch}")

    writer.foreachBatch(keep).start().awaitTermination()
    if _unwritten(spark, f"{place}/rows"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(f"{place}/rows")


def _unwritten(spark: SparkSession, place: str) -> bool:
    """No batch has been written there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
