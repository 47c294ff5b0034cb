"""Places of rows, windows over blocks, and results of streams by batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.operators import cleaning, features
from rillwork.operators.order import numbered
from rillwork.plans.registry import stored
from rillwork.streaming import streams


def slow_hampel(v: np.ndarray, window: int, sigmas: float) -> tuple[list, list]:
    half, flags, out = window // 2, [], []
    for i, x in enumerate(v):
        near = v[i - half : i + half + 1] if half <= i < len(v) - half else np.empty(0)
        near = near[~np.isnan(near)]
        hit = False
        if len(near):
            middle = np.median(near)
            hit = bool(abs(x - middle) > sigmas * 1.4826 * np.median(np.abs(near - middle)))
        flags.append(hit)
        out.append(middle if hit else x)
    return flags, out


@pytest.mark.parametrize("cut", [None, stored])
def test_hampel_over_blocks_equals_windows_one_by_one(spark, monkeypatch, cut):
    monkeypatch.setattr(cleaning, "HAMPEL_ROWS", 16)
    monkeypatch.setattr(cleaning, "HAMPEL_VALUES", 40)
    rng = np.random.default_rng(3)
    data = {}
    for name, n in (("a", 200), ("b", 33), ("c", 5), (None, 40)):
        v = rng.normal(0, 1, n)
        v[rng.random(n) < 0.2] = np.nan
        v[rng.random(n) < 0.1] += 30
        data[name] = v
    data["d"] = np.full(30, np.nan)
    rows = [(k, i, None if np.isnan(x) else float(x), "kept") for k, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "station string, day int, value double, block string").repartition(5)
    got = cleaning.hampel(df, 10, 3.0, time="day", cut=cut)
    assert got.columns == [*df.columns, "hampel", "hampel_value"]
    got = got.collect()
    assert len(got) == len(rows)
    for k, v in data.items():
        mine = sorted((r for r in got if r["station"] == k), key=lambda r: r["day"])
        flags, out = slow_hampel(v, 10, 3.0)
        assert [r["hampel"] for r in mine] == flags
        assert [np.nan if r["hampel_value"] is None else r["hampel_value"] for r in mine] == pytest.approx(out, nan_ok=True)
    assert sum(r["hampel"] for r in got) > 5


def test_hampel_of_no_rows(spark):
    assert cleaning.hampel(spark.createDataFrame([], "station string, ts timestamp, value double")).count() == 0


def test_numbered_goes_on_from_task_to_task(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("station"), F.xxhash64("id").alias("day"))
    for cut in (None, stored):
        got = numbered(df.repartition(8), "day", ["station"], "i", cut).toPandas()
        assert len(got) == 5000
        for _, part in got.groupby("station", dropna=False):
            assert part.sort_values("day")["i"].tolist() == list(range(len(part)))


def test_numbered_without_groups_has_no_single_task_over_rows(spark):
    got = numbered(spark.range(3000).select((-F.col("id")).alias("day")).repartition(6), "day", name="place", cut=stored)
    assert sorted((r["place"], r["day"]) for r in got.collect()) == [(i, i - 2999) for i in range(3000)]


def test_positional_flow_takes_readings_in_order(spark):
    days = pd.date_range("2020-01-01", periods=40)[::2]
    df = spark.createDataFrame(pd.DataFrame({"day": days, "flow": np.arange(20.0)}))
    for cut in (None, stored):
        got = features.streamflow_block(df, 20, "2021-01-01", positional=True, cut=cut).orderBy("day").collect()
        assert [r["flow"] for r in got] == [x * 86400 for x in range(20)]


def test_update_and_complete_streams_are_tables(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, i % 2) for i in range(10)], "id int, k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id int, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("k").count()
    assert {(r["k"], r["count"]) for r in streams.run_once(read(), "complete").collect()} == {(0, 15), (1, 15)}
    assert sorted((r["k"], r["count"]) for r in streams.run_once(read(), "update").collect()) == [(k, n) for k in (0, 1) for n in (5, 10, 15)]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("id int, k int").parquet(str(tmp_path / "none")).groupBy("k").count()
    assert streams.run_once(empty, "update").count() == 0
