"""Relational parts of a spatio-temporal model: gates, modulation, losses. Training itself is out of scope."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid


def gated(a: Column, b: Column, logit: Column, floor: float = 0.15) -> Column:
    """``alpha * a + (1 - alpha) * b`` with ``alpha = floor + (1 - floor) * sigmoid(logit)``."""
    alpha = floor + (1 - floor) * sigmoid(logit)
    return alpha * a + (1 - alpha) * b


def modulated(h: Column, gamma: Column, beta: Column) -> Column:
    return gamma * h + beta


def peak_weights(df: DataFrame, y: str, slope: float = 0.8, cap: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``weight``: ``1 + slope * |y - median| / IQR`` up to the cap; 1 where the IQR is 0."""
    q = df.groupBy(*by).agg(F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    joined = df.join(q, list(by)) if by else df.crossJoin(F.broadcast(q))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    weight = F.when(iqr > 0, F.least(F.lit(cap), 1 + slope * F.abs(F.col(y) - F.col("_q")[1]) / iqr)).otherwise(1.0)
    return joined.withColumn("weight", weight).drop("_q")


def loss_terms(df: DataFrame, y: str, estimate: str, residual: str, gate: str, by: Sequence[str], time: str) -> DataFrame:
    """``weighted_mse, rate, curvature, residual_smooth, gate_mean, gate_entropy`` for each group; needs ``weight``."""
    w = Window.partitionBy(*by).orderBy(time)
    e = F.col(estimate) - F.col(y)
    rows = df.withColumns({"_d": e - F.lag(e).over(w), "_r": F.col(residual) - F.lag(residual).over(w)})
    rows = rows.withColumn("_c", F.col("_d") - F.lag("_d").over(w))
    g = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(gate)))
    return rows.groupBy(*by).agg(
        (F.sum(F.col("weight") * e * e) / F.sum("weight")).alias("weighted_mse"),
        F.avg(F.col("_d") ** 2).alias("rate"),
        F.avg(F.col("_c") ** 2).alias("curvature"),
        F.avg(F.col("_r") ** 2).alias("residual_smooth"),
        F.avg(gate).alias("gate_mean"),
        F.avg(-(g * F.log(g) + (1 - g) * F.log(1 - g))).alias("gate_entropy"),
    )


def lstm_step(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next ``(h, c)``; rows of ``w, u, b`` are the input, forget, cell and output gates, one below the other."""
    i, f, g, o = np.split(w @ x + u @ h + b, 4)
    unit = lambda z: 1 / (1 + np.exp(-z))
    c = unit(f) * c + unit(i) * np.tanh(g)
    return unit(o) * np.tanh(c), c


def recurrent(df: DataFrame, vector: str, w: np.ndarray, u: np.ndarray, b: np.ndarray, key: str = "station", time: str = "day") -> DataFrame:
    """``key, time, hidden``: the recurrent state after each row, from 0 at a key's first; one key is one task's."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time)
        h = c = np.zeros(len(b) // 4)
        out = []
        for x in part[vector]:
            h, c = lstm_step(np.asarray(x, float), h, c, w, u, b)
            out.append(h.tolist())
        return pd.DataFrame({key: part[key], time: part[time], "hidden": out})

    return df.groupBy(key).applyInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{time}` {df.schema[time].dataType.simpleString()}, hidden array<double>")
