"""Values that are all equal, merged from several tasks: their spread is 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.functions.scalars import correlation
from rillwork.operators import graphs, metrics


def test_equal_values_in_several_tasks_do_not_vary(spark):
    df = spark.range(0, 98, 1, 2).withColumns({"one": F.lit(1.0), "x": F.col("id").cast("double")})
    one, x, empty = graphs.scaler(df.withColumn("none", F.lit(None).cast("double")), ["one", "x", "none"]).collect()
    assert (one["mean"], one["scale"]) == (1.0, 1.0)
    assert abs(x["scale"] - ((98**2 - 1) / 12) ** 0.5) < 1e-9 and empty["scale"] is None
    flat = metrics.errors(df, "one", "x").first()
    assert flat["nse"] is flat["r"] is flat["alpha"] is flat["kge"] is None
    assert metrics.errors(df, "x", "one").first()["alpha"] == 0
    assert df.agg(correlation("one", "x")).first()[0] is None
