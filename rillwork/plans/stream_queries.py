"""Streams over the events, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams
from .registry import READINGS, query, r

_FINAL = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return streams.read_stream(spark, f"{d}/events.parquet")


@query(f"WITH {READINGS}, w AS (SELECT station, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS value FROM readings GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= {_FINAL}")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_once(streams.tumbling(_rows(spark, d))).select("station", "start", "n", r("value"))


@query(f"""WITH {READINGS}, w AS (SELECT station, date_trunc('day', ts) - i * INTERVAL 1 DAY AS start, count(*) AS n, round(avg(value), 6) AS value FROM readings, range(3) t(i) GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 3 DAYS <= {_FINAL}""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_once(streams.sliding(_rows(spark, d)))
    return out.select("station", "start", "n", r("value"))


@query(f"""WITH {READINGS}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY station ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS c FROM readings), s AS (SELECT *, sum(c) OVER (PARTITION BY station ORDER BY ts) AS k FROM m),
  w AS (SELECT station, min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS n FROM s GROUP BY station, k) SELECT * FROM w WHERE "end" <= {_FINAL}""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_once(streams.sessions(_rows(spark, d), "12 hours"))


@query(f"WITH {READINGS} SELECT event_id, station, value FROM readings")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_once(streams.first_seen(_rows(spark, d))).select("event_id", "station", "value")


@query(f"""WITH {READINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC, event_id DESC) AS k FROM readings)
SELECT station, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, k - 1) * value) * 0.7310585786::DOUBLE, 6) AS memory, arg_min(value, k) AS last FROM n GROUP BY station""")
def stream_memories(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_once(streams.memories(_rows(spark, d)), "update")
    last = out.groupBy("station").agg(F.max_by(F.struct("memory", "last"), "ts").alias("x"))
    return last.select("station", F.round(F.col("x.memory") * 0.7310585786, 6).alias("memory"), "x.last")
