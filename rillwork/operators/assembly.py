"""The node by timestep fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_calendar(calendar: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node at every timestep."""
    return calendar.crossJoin(nodes)


def left_chain(base: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left joins on the same key; small parts are broadcast by their known size."""
    for part in parts:
        base = base.join(part, on, "left")
    return base


def merge_series(calendar: DataFrame, parts: Sequence[DataFrame], time: str = "day") -> DataFrame:
    """The calendar with each part's columns, matched by day."""
    return left_chain(calendar, [p.withColumn(time, F.to_date(time)) for p in parts], time)


def fact_table(calendar: DataFrame, nodes: DataFrame, statics: Sequence[DataFrame], series: Sequence[DataFrame], target: DataFrame, time: str = "day") -> DataFrame:
    """Statics by node, series by day, the target by both. Static and series sides are joined before the product is built, so
    the large table meets the target only."""
    left = left_chain(nodes, statics, "node_id")
    right = merge_series(calendar, series, time)
    return cross_calendar(right, left).join(target, [time, "node_id"], "left")


def reordered(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns that exist, then the rest."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def with_columns(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly these columns and types; missing ones are null."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema))


def stacked(parts: Sequence[DataFrame], time: str | Sequence[str]) -> DataFrame:
    """Union of series; of rows with equal times the earliest part's stays."""
    keys = [time] if isinstance(time, str) else list(time)
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    rest = [c for c in whole.columns if c not in (*keys, "_part")]
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_part").alias("_r")).select(*keys, "_r.*")
