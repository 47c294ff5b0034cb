"""Places of rows in time."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def numbered(df: DataFrame, time: str, by: Sequence[str] = (), name: str = "i", cut: Cut | None = None) -> DataFrame:
    """Adds ``name``: a row's place, from 0, in its group in order of ``time``; null keys are a group, and rows of equal time come in any order.

    With ``cut``, which stores rows, a group of any length is dealt to tasks by time. Only a group that goes on from one task to the
    next needs what came before, so at most a row a task is broadcast. Without, a group is in one task.
    """
    if cut is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1).cast("long"))
    rows = cut(df.repartitionByRange(*by, time).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.sum("_n").over(upto)).where(F.col("_before") > 0)
    starts = starts.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_part").alias("_p"), "_before")
    same = functools.reduce(lambda p, q: p & q, [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by)])
    here = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(time)) - 1
    placed = rows.withColumn("_here", here).join(F.broadcast(starts), same, "left")
    return placed.select(*df.columns, (F.col("_here") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
