"""The columns of stations: fitted to training rows only, sentinels left alone."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rillwork.operators import preparation


def test_target_block(spark):
    rows = [
        (1, 1, 1.0, "good", 10.0, "a"),
        (2, 1, 3.0, "bad", 30.0, "a"),
        (3, 1, None, None, None, "a"),  # a training row without values: its missing category counts
        (1, 2, 100.0, "new", 50.0, "b"),  # for validation: never fitted to
        (2, 2, None, "good", None, "b"),
        (1, 3, 7.0, "good", 20.0, "c"),  # no station
        (2, 3, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "t int, node_id int, lag1 double, quality string, target double, other string")
    got = preparation.target_block(df, F.col("node_id") == 1, F.col("node_id") < 3, ["lag1", "absent"], ["quality", "gone"], "target")
    flags = ["quality___MISSING_CAT__", "quality_bad", "quality_good"]
    assert got.columns == ["t", "node_id", "other", "lag1", *flags, "target"]
    assert {t for c, t in got.dtypes if c in ("lag1", "target", *flags)} == {"float"}
    held = {(r["node_id"], r["t"]): r for r in got.collect()}
    assert len(held) == 7
    lag = {k: r["lag1"] for k, r in held.items()}
    assert lag[1, 1] == -1 and lag[1, 2] == 1 and lag[1, 3] == -999 and lag[2, 1] == 98 and lag[2, 2] == -999
    assert lag[3, 1] == 7 and lag[3, 2] == -999  # rows without a station aren't standardised
    target = {k: r["target"] for k, r in held.items()}
    assert target[1, 1] == -1 and target[2, 1] == 3 and target[3, 1] == 0 and target[1, 3] is None and not math.isnan(target[1, 2])
    said = {k: tuple(r[c] for c in flags) for k, r in held.items()}
    assert said[1, 1] == (0, 0, 1) and said[1, 2] == (0, 1, 0) and said[1, 3] == (1, 0, 0) and said[2, 1] == (0, 0, 0) and said[2, 2] == (0, 0, 1) and said[3, 1] == said[3, 2] == (0, 0, 0)


def test_target_block_without_features(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "node_id int, target double")
    got = preparation.target_block(df, F.lit(True), F.lit(True), [], [], "target").orderBy("node_id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (2, None)]
