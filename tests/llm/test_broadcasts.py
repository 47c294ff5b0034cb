"""What Spark takes for small after an explode isn't broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.llm import components, jaccard_dedup, scratch, simhash_dedup
from rillwork.llm.scratch import write_table


def test_postings_are_not_broadcast(spark):
    """However small the fingerprints are; beyond Spark's limit they wouldn't be anyway."""
    prints = write_table(spark.range(2000).select(F.xxhash64("id").alias("bits")), "prints")
    linked = simhash_dedup.links(prints)
    linked.collect()
    assert "BroadcastExchange" not in linked._jdf.queryExecution().executedPlan().toString()


def test_bands_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(edges, *names):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components.components(edges, *names)

    monkeypatch.setattr(jaccard_dedup, "components", seen)
    docs = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(20)),) for i in range(50)] * 2, "text string")
    assert jaccard_dedup.near_duplicates(docs).count() == 0
    assert "Generate" in plans[0] and "BroadcastExchange" not in plans[0]


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    """Only the groups of a large share of the rows are, however small the table's file is."""
    monkeypatch.setattr(scratch, "FEW", 100)
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    for least, broadcasts in ((0, 2), (1, 1)):
        groups = rows.where(F.col("k") < 100 + least).groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("v"))
        joined = scratch.join_groups(rows, groups, {"k": "g"}, "n")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") == broadcasts
        assert joined.where("v is not null").count() == 5 * (100 + least) and joined.where("v != k").isEmpty()
