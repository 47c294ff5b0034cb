"""Moments, ranks, centres and queues of stations that no one task holds, against plain computations."""

from __future__ import annotations

import contextlib
import io
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import donors, selection
from rillwork.plans.registry import stored

VECTORS = "station string, features array<double>"


def test_moments_of_partitions_add_up(spark, monkeypatch):
    monkeypatch.setattr(selection, "MERGED", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) * [1, 10, 0.1, 3, 2] + 1e7
    rows = [(f"s{i}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("part", [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    for parts in (1, 7):
        mean, cov, n = selection.covariance(df.repartition(parts))
        assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-12) and np.allclose(cov, np.cov(x.T), rtol=1e-6)
    assert selection.covariance(df.where("false"))[2] == 0
    assert selection.moments(df.repartition(7)).count() == 1


@pytest.mark.parametrize("spread", [3, 40, 10**6])
def test_mid_ranks_and_spearman(spark, spread):
    draw = random.Random(spread)
    pairs = [(draw.randrange(spread), draw.randrange(spread)) for _ in range(400)] + [(0, 1)] * 200 + [(None, 1), (2, None)]
    df = spark.createDataFrame(pairs, "x int, y int").repartition(6)
    ranks = {r["x"]: r["rank"] for r in selection.mid_ranks(df, "x", stored).collect()}
    held = sorted(x for x, _ in pairs if x is not None)
    assert ranks == {x: held.index(x) + 1 + (held.count(x) - 1) / 2 for x in set(held)}
    both = [(x, y) for x, y in pairs if x is not None and y is not None]
    rank = lambda v: [sorted(v).index(a) + 1 + (v.count(a) - 1) / 2 for a in v]
    want = np.corrcoef(rank([x for x, _ in both]), rank([y for _, y in both]))[0, 1]
    out = selection.spearman(df, "x", "y", stored)
    got = out.first()
    assert got["n"] == len(both) and abs(got["rho"] - want) < 1e-12
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        selection.mid_ranks(df, "x", stored).explain()
    assert "SinglePartition" not in text.getvalue()


def test_spearman_without_variation_or_rows(spark):
    flat = spark.createDataFrame([(1, i) for i in range(5)], "x int, y int")
    assert tuple(selection.spearman(flat, "x", "y", stored).first()) == (None, 5)


def test_core_centres_are_near_the_best(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(6, 3)) * 50
    x = np.concatenate([spots[i % 6] + rng.normal(size=3) for i in range(300)]).reshape(-1, 3)
    df = spark.createDataFrame([(f"s{i:03}", v.tolist()) for i, v in enumerate(x)] + [("s999", None)], VECTORS)
    radius = lambda rows: np.min([np.linalg.norm(x - x[r], axis=1) for r in rows], axis=0).max()
    whole = selection.farthest_first([f"s{i:03}" for i in range(300)], x, np.zeros((300, 1)), 6, 0, -1.0)
    for block in (4096, 40, 7):
        got = selection.core_centres(df.repartition(5), 6, "s000", block=block).orderBy("turn").collect()
        rows = [int(r["station"][1:]) for r in got]
        assert len(set(rows)) == 6 and rows[0] == 0
        assert radius(rows) <= 2 * radius(whole)  # four times the best: the greedy choice is at most twice it
        if block == 4096:
            assert rows == whole
        found = selection.centre_radius(df, spark.createDataFrame(got)).first()
        assert abs(found["r_max"] - radius(rows)) < 1e-9
    small = x[:12]
    best = min(max(np.linalg.norm(small[:, None] - small[list(c)], axis=2).min(axis=1)) for c in itertools.combinations(range(12), 3))
    got = selection.core_centres(df.where("station < 's012'"), 3, "s000", block=4).collect()
    assert max(np.linalg.norm(small[:, None] - small[[int(r["station"][1:]) for r in got]], axis=2).min(axis=1)) <= 4 * best + 1e-9


def test_core_centres_keep_apart(spark):
    rows = [(f"s{i}", [float(i * i)], float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, VECTORS + ", km double")
    got = [r["station"] for r in selection.core_centres(df, 3, "s0", buffer=4.0, place=["km"]).orderBy("turn").collect()]
    assert got == ["s0", "s9", "s5"]  # s6, further in surroundings, lies within 4 km of s9
    assert selection.core_centres(df, 99, "s0", buffer=4.0, place=["km"]).count() == 10


def test_levels_fill_as_one_after_another(spark):
    draw = random.Random(9)
    order = [f"s{i}" for i in range(8)]
    uses = [("s1", "s0"), ("s0", "s1"), ("s2", "s1"), ("s5", "s2"), ("s3", "s7"), ("s4", "s7"), ("s7", "s6"), ("s6", "s5")]
    levels = donors.fill_levels(uses, order)
    assert levels == [["s0", "s3", "s4"], ["s1"], ["s2"], ["s5"], ["s6"], ["s7"]]
    assert donors.fill_levels([("s1", "other")], ["s0", "s1", "s2"]) == [["s0", "s1", "s2"]] and donors.fill_levels([], []) == []
    rows = [(s, d, None if draw.random() < 0.25 and 0 < d < 39 else 10.0 * i + d % 7 + draw.random()) for i, s in enumerate(order) for d in range(40)]
    df = spark.createDataFrame(rows, "station string, d int, value double").select("station", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"), "value")
    scores = spark.createDataFrame([(a, b, 0.4 + 0.05 * i) for i, (a, b) in enumerate(uses)], "station string, donor string, score double")
    one = df.withColumn("data_type", F.lit("raw"))
    for s in order:
        one = stored(donors.impute(one, scores.where(F.col("station") == s)))
    steps = []
    both = donors.impute_in_order(df, scores, order, lambda t: steps.append(1) or stored(t))
    said = lambda t: sorted((r["station"], r["day"], None if r["value"] is None else round(r["value"], 9), r["data_type"]) for r in t.collect())
    assert said(both) == said(one) and len(steps) == len(levels)


def test_core_centres_are_those_of_one_block(spark):
    """Farthest first over all stations, however few a task looks at; ties go to the greater name."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8)).round(1)
    x[400:] = x[:100]
    names = [f"s{i:03}" for i in range(500)]
    df = spark.createDataFrame(list(zip(names, x.tolist())), VECTORS)
    whole = selection.farthest_first(names, x, np.zeros((500, 1)), 12, 0, -1.0)
    got = selection.core_centres(df.repartition(7), 12, "s000", block=16).orderBy("turn").collect()
    assert [r["station"] for r in got] == [names[i] for i in whole] and any(i >= 400 for i in whole)
