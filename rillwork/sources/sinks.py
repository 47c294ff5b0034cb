"""Writers."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, append: bool = False, by: str | None = None) -> None:
    """With a header; ``by`` writes a folder a value."""
    writer = df.write.mode("append" if append else "overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, append: bool = False, by: str | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def geometry_text(ring: Column) -> Column:
    """Polygon as WKT from an array of (x, y)."""
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def content_hash(df: DataFrame) -> str:
    """SHA-256 of a table's rows in any order: the sum of the rows' 64-bit hashes, its count and its schema."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    said = json.dumps([df.schema.json(), row["n"], str(row["h"])])
    return df.sparkSession.range(1).select(F.sha2(F.lit(said), 256)).first()[0]


def manifest(inputs: dict[str, DataFrame], **facts) -> str:
    """JSON of what went into a run: content hashes, facts (seeds, splits, versions), time."""
    return json.dumps({"inputs": {k: content_hash(v) for k, v in sorted(inputs.items())}, **facts, "at": datetime.now(timezone.utc).isoformat()}, sort_keys=True, default=str)


def write_parameters(rows: DataFrame, path: str) -> None:
    """Appends fitted parameters (``name, value``) with the time of writing; nothing is overwritten."""
    rows.select("name", F.col("value").cast("string").alias("value"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """``name, value``: what was written last for each name."""
    return spark.read.parquet(path).groupBy("name").agg(F.max_by("value", "at").alias("value"))
