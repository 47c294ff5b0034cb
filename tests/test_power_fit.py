"""The Box-Cox fit against arithmetic of 50 digits."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from rillwork.operators import features


def exact(values, lam):
    with localcontext() as c:
        c.prec = 50
        p, logs = Decimal(str(lam)), [(Decimal(v) + 1).ln() for v in values]
        y = [((p * g).exp() - 1) / p if p else g for g in logs]
        mean = sum(y) / len(y)
        return float((p - 1) * sum(logs) - len(y) * (sum((v - mean) ** 2 for v in y) / len(y)).ln() / 2)


def test_great_values_of_little_spread_and_a_low_power(spark):
    values = [9.4e8 / (1 + 0.0005 * math.sin(i * i)) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = features.power_fit(df, "v", -1.0, -0.98).first()
    best = max((exact(values, lam), -lam) for lam in (-1.0, -0.99, -0.98))
    assert got["lambda"] == -best[1] and abs(got["log_likelihood"] - best[0]) < 1e-6
    assert abs(features.power_fit(df, "v", 0.0, 0.0).first()["log_likelihood"] - exact(values, 0)) < 1e-6
    assert features.power_fit(spark.range(0, 98, 1, 2).selectExpr("0.1d AS v"), "v", -1.0, -0.98).count() == 0
