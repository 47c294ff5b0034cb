"""Edges between nodes and what they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import spread
from .spatial import touching, within_radius

EPSILON = 1e-6
ATTRIBUTES = ("distance", "elev_diff", "slope_dx", "slope_dy", "dir_score")


def edge_set(nodes: DataFrame, stations: DataFrame, radius: float = 25000.0) -> DataFrame:
    """``src, dst``: touching cells and stations within the radius, without repeats."""
    return touching(nodes).union(within_radius(stations, radius).select("src", "dst")).distinct()


def edge_attributes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, distance, elev_diff`` (source less target)``, slope_dx, slope_dy`` (of the source)``, dir_score``: cosine between the
    source's downhill direction and the edge's."""
    cols = ("easting", "northing", "elevation", "slope_dx", "slope_dy")
    s, d = (nodes.select(F.col("node_id").alias(k), *(F.col(c).alias(f"_{k}_{c}") for c in cols)) for k in ("src", "dst"))
    both = edges.join(s, "src").join(d, "dst")
    dx, dy = F.col("_dst_easting") - F.col("_src_easting"), F.col("_dst_northing") - F.col("_src_northing")
    sx, sy = F.col("_src_slope_dx"), F.col("_src_slope_dy")
    distance = F.sqrt(dx * dx + dy * dy)
    cosine = (dx * sx + dy * sy) / (distance * F.sqrt(sx * sx + sy * sy) + EPSILON)
    return both.select("src", "dst", distance.alias("distance"), (F.col("_src_elevation") - F.col("_dst_elevation")).alias("elev_diff"), sx.alias("slope_dx"), sy.alias("slope_dy"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)).alias("dir_score"))


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mean, scale``: population spread, 1 where that is 0; nulls don't count."""
    row = F.array(*(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), spread(c).alias("scale")) for c in columns))
    out = df.agg(row.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def standardised(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less mean over scale, as floats. ``fitted`` has one row a feature and becomes one row here."""
    wide = fitted.agg(*(F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_s_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(wide))
    return joined.withColumns({c: ((F.col(c) - F.col(f"_s_{c}.mean")) / F.col(f"_s_{c}.scale")).cast("float") for c in columns}).drop(*(f"_s_{c}" for c in columns))


def attention(edges: DataFrame, scores: str = "score", value: str = "value") -> DataFrame:
    """``dst, out``: values of the sources, weighed by the softmax of the scores over each target's edges."""
    top = F.max(scores).over(Window.partitionBy("dst"))
    weights = edges.withColumn("_w", F.exp(F.col(scores) - top))
    return weights.groupBy("dst").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("out"))
