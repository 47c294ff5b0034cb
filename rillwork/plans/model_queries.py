"""Scaling, encoding, splits, masks, scores and loss terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs, metrics, model_terms, preparation
from .registry import SERIES, query, r, series, stored, table

_PRED = SERIES + ", pred AS (SELECT station, day, value AS y, lag(value) OVER (PARTITION BY station ORDER BY day) AS p FROM series)"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    """Long series with yesterday's value as the prediction."""
    return series(spark, d).select("station", "day", F.col("value").alias("y"), F.lag("value").over(Window.partitionBy("station").orderBy("day")).alias("p"))


_ERRORS = """SELECT station, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(avg(pow(p - y, 2)), 6) AS mse, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(p - y), 6) AS bias,
  round(1 - avg(pow(p - y, 2)) / var_pop(y), 6) AS nse, round(corr(y, p), 6) AS r, round(stddev_pop(p) / stddev_pop(y), 6) AS alpha, round(avg(p) / avg(y), 6) AS beta,
  round(1 - sqrt(pow(corr(y, p) - 1, 2) + pow(stddev_pop(p) / stddev_pop(y) - 1, 2) + pow(avg(p) / avg(y) - 1, 2)), 6) AS kge"""


@query(f"WITH {_PRED} {_ERRORS} FROM pred WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY station")
def e01_e02_e03_e04_errors(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.errors(_pred(spark, d), "y", "p", ["station"])
    return out.select("station", "n", *(r(c) for c in ("mae", "mse", "rmse", "bias", "nse", "r", "alpha", "beta", "kge")))


@query(f"WITH {_PRED}, a AS (SELECT station, y, p - (avg(p) OVER (PARTITION BY station) - avg(y) OVER (PARTITION BY station)) AS p FROM pred) {_ERRORS} FROM a WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY station".replace("round(avg(p - y), 6) AS bias", "round(avg(p - y), 4) + 0.0 AS bias"))
def e05_offset_adjusted(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.errors(metrics.offset_adjusted(_pred(spark, d), "y", "p", ["station"]), "y", "p", ["station"])
    return out.select("station", "n", r("mae"), r("mse"), r("rmse"), (F.round("bias", 4) + 0.0).alias("bias"), *(r(c) for c in ("nse", "r", "alpha", "beta", "kge")))


@query(f"WITH {_PRED}, f AS (SELECT *, first_value(p - y IGNORE NULLS) OVER (PARTITION BY station ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o FROM pred) SELECT station, day, round(p - o, 6) + 0.0 AS p FROM f")
def w16_first_point(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_point_aligned(_pred(spark, d), "y", "p", ["station"], "day").select("station", "day", (F.round("p", 6) + 0.0).alias("p"))


@query(f"WITH {_PRED} SELECT station, round(avg((abs(p - y) <= 0.3)::INT), 6) AS within_0_3, round(avg((abs(p - y) <= 0.5)::INT), 6) AS within_0_5, round(avg((abs(p - y) <= 1.0)::INT), 6) AS within_1_0 FROM pred WHERE p IS NOT NULL GROUP BY station")
def e10_tolerance_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tolerance_shares(_pred(spark, d), "y", "p", by=["station"]).select("station", r("within_0_3"), r("within_0_5"), r("within_1_0"))


def _multi(k: int) -> str:
    return f"b{k} AS (SELECT {k} AS block_days, station, avg(y) AS y, avg(p) AS p FROM (SELECT *, (row_number() OVER (PARTITION BY station ORDER BY day) - 1) // {k} AS b FROM pred) GROUP BY station, b HAVING count(*) = {k})"


@query(f"WITH {_PRED}, {', '.join(_multi(k) for k in (1, 7, 30))}, a AS (SELECT * FROM b1 UNION ALL SELECT * FROM b7 UNION ALL SELECT * FROM b30) SELECT block_days, station, count(*) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(1 - avg(pow(p - y, 2)) / var_pop(y), 6) AS nse FROM a WHERE p IS NOT NULL GROUP BY ALL")
def e08_resolutions(spark: SparkSession, d: str) -> DataFrame:
    rows, out = _pred(spark, d), None
    for k in (1, 7, 30):
        part = metrics.errors(metrics.block_means(rows, k, ["y", "p"], ["station"], "day"), "y", "p", ["station"]).select(F.lit(k).alias("block_days"), "station", "n", r("rmse"), r("nse"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_PRED} SELECT station, round(sum(abs(p - y)) / sum(abs(y)), 6) AS share FROM pred GROUP BY station")
def e09_contribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contribution(_pred(spark, d).withColumn("part", F.col("p") - F.col("y")), "part", "y", ["station"]).select("station", r("share"))


@query(f"WITH {_PRED} SELECT station, day, round(y * 2.5 + 100, 6) AS y FROM pred QUALIFY row_number() OVER (PARTITION BY station ORDER BY day) > 30")
def e06_e07_inverse_burn_in(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.after_burn_in(_pred(spark, d), 30, ["station"], "day")
    return out.select("station", "day", r(metrics.inverse_standard(F.col("y"), F.lit(100.0), F.lit(2.5))).alias("y"))


@query("SELECT 'p_retailprice' AS feature, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS scale FROM part UNION ALL SELECT 'p_size', round(avg(p_size), 6), round(stddev_pop(p_size), 6) FROM part UNION ALL SELECT 'one', 1.0, 1.0")
def a20_k04_scaler(spark: SparkSession, d: str) -> DataFrame:
    out = graphs.scaler(table(spark, d, "part").withColumn("one", F.lit(1.0)), ["p_retailprice", "p_size", "one"])
    return out.select("feature", r("mean"), r("scale"))


@query("WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part) SELECT p_partkey, round((p_retailprice - m) / s, 3) AS price, (p_type = 'ECONOMY')::INT::DOUBLE AS economy, (p_type = 'SMALL')::INT::DOUBLE AS small FROM part, s")
def m01_m02_shared_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), "p_type")
    scaled = graphs.standardised(p, graphs.scaler(p, ["price"]), ["price"])
    out = preparation.one_hot(scaled, {"p_type": ["ECONOMY", "SMALL"]})
    return out.select("p_partkey", F.round(F.col("price").cast("double"), 3).alias("price"), F.col("p_type_ECONOMY").cast("double").alias("economy"), F.col("p_type_SMALL").cast("double").alias("small"))


@query("WITH v AS (SELECT DISTINCT 'p_brand' AS feature, p_brand AS category FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part) SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS idx FROM v")
def m02_categories(spark: SparkSession, d: str) -> DataFrame:
    return preparation.categories(table(spark, d, "part"), ["p_brand", "p_type"])


@query("WITH x AS (SELECT p_partkey, p_partkey % 10 < 7 AS train, CASE WHEN p_partkey % 6 = 0 THEN -999.0 ELSE p_retailprice END AS v FROM part), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x WHERE train AND v <> -999) SELECT p_partkey, CASE WHEN v = -999 THEN -999.0 ELSE round((v - m) / s, 3) END AS v FROM x, s")
def m03_m04_scale_stations(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, -999.0).otherwise(F.col("p_retailprice")).alias("v"))
    out = preparation.scale_stations(x, ["v"], F.col("p_partkey") % 10 < 7)
    return out.select("p_partkey", F.round(F.col("v").cast("double"), 3).alias("v"))


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 8 > 0 THEN p_type END AS t FROM part) SELECT p_partkey, coalesce(p_partkey % 2 = 0 AND t = 'SMALL', false)::INT::DOUBLE AS small, (p_partkey % 2 = 0 AND t IS NULL)::INT::DOUBLE AS missing FROM x")
def m05_station_one_hot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 8 > 0, F.col("p_type")).alias("t"))
    out = preparation.one_hot(x, {"t": ["SMALL", preparation.MISSING]}, F.col("p_partkey") % 2 == 0, missing=True)
    return out.select("p_partkey", F.col("t_SMALL").cast("double").alias("small"), F.col(f"t_{preparation.MISSING}").cast("double").alias("missing"))


_BLOCK = """f AS (SELECT l_suppkey AS node_id, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS q, min(l_returnflag) AS quality, min(l_linestatus) AS kind FROM lineitem GROUP BY ALL),
  g AS (SELECT node_id, day, CASE WHEN dayofyear(day) % 4 > 0 THEN q END AS target, CASE WHEN dayofyear(day) % 5 > 0 THEN quality END AS quality, kind, node_id % 3 > 0 AS station FROM f),
  h AS (SELECT *, station AND node_id % 10 < 7 AS train, CASE WHEN station THEN lag(target) OVER (PARTITION BY node_id ORDER BY day) END AS lag1 FROM g),
  s AS (SELECT avg(lag1) FILTER (train) AS lm, stddev_pop(lag1) FILTER (train) AS ls, avg(target) FILTER (train) AS tm, stddev_pop(target) FILTER (train) AS ts FROM h)"""
_FLAG = "coalesce(station AND coalesce({c}, '__MISSING_CAT__') = '{v}', false)::INT::DOUBLE"


@query(f"""WITH {_BLOCK} SELECT node_id, day, CASE WHEN lag1 IS NULL THEN -999.0 ELSE round((lag1 - lm) / ls, 3) END AS lag1, {_FLAG.format(c='quality', v='A')} AS quality_a, {_FLAG.format(c='quality', v='N')} AS quality_n, {_FLAG.format(c='quality', v='R')} AS quality_r,
  {_FLAG.format(c='quality', v='__MISSING_CAT__')} AS quality_missing, {_FLAG.format(c='kind', v='F')} AS kind_f, {_FLAG.format(c='kind', v='O')} AS kind_o, round((target - tm) / ts, 3) AS target FROM h, s""")
def m06_target_block(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stations but for each third, seven in ten of them for training."""
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("node_id"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("q"), F.min("l_returnflag").alias("quality"), F.min("l_linestatus").alias("kind"))
    station = F.col("node_id") % 3 > 0
    rows = rows.select("node_id", "day", F.when(F.dayofyear("day") % 4 > 0, F.col("q")).alias("target"), F.when(F.dayofyear("day") % 5 > 0, F.col("quality")).alias("quality"), "kind")
    rows = rows.withColumn("lag1", F.when(station, F.lag("target").over(Window.partitionBy("node_id").orderBy("day"))))
    out = preparation.target_block(rows, F.col("node_id") % 10 < 7, station, ["lag1", "lag2"], ["quality", "kind"], "target")
    flags = {"quality_A": "quality_a", "quality_N": "quality_n", "quality_R": "quality_r", f"quality_{preparation.MISSING}": "quality_missing", "kind_F": "kind_f", "kind_O": "kind_o"}
    return out.select("node_id", "day", F.round(F.col("lag1").cast("double"), 3).alias("lag1"), *(F.col(c).cast("double").alias(n) for c, n in flags.items()), F.round(F.col("target").cast("double"), 3).alias("target"))


_SPLIT = "splits AS (SELECT s_name AS station, s_suppkey AS node_id, row_number() OVER (ORDER BY CASE s_name WHEN 'Supplier#000000003' THEN 1 ELSE 2 END, md5('55:' || s_name)) AS k, count(*) OVER () AS n FROM supplier), named AS (SELECT station, node_id, CASE WHEN k <= round_even(n * 8 / 100.0, 0) THEN 'test' WHEN k <= round_even(n * 8 / 100.0, 0) + round_even(n * 15 / 100.0, 0) THEN 'val' ELSE 'train' END AS split FROM splits)"


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return preparation.split_stations(table(spark, d, "supplier").withColumnRenamed("s_name", "station"), (77, 15, 8), 55, ["Supplier#000000003"], cut=stored)


@query(f"WITH {_SPLIT} SELECT station, split FROM named")
def m07_split_stations(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


@query("SELECT s_name AS station, 'none' AS fault FROM supplier WHERE false")
def m07_u05_split_faults(spark: SparkSession, d: str) -> DataFrame:
    return preparation.split_faults(_splits(spark, d), table(spark, d, "supplier").withColumnRenamed("s_name", "station"))


@query(f"""WITH {_SPLIT}, f AS (SELECT l_suppkey AS node_id, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS q FROM lineitem GROUP BY ALL),
  g AS (SELECT *, CASE WHEN dayofyear(day) % 4 > 0 THEN q END AS target, CASE WHEN dayofyear(day) % 7 = 0 THEN 1.0 ELSE 0.0 END AS masked FROM f)
SELECT node_id, day, round(CASE WHEN split IN ('val', 'test') AND target IS NULL THEN -999.0 ELSE q END, 6) AS q, round(coalesce(target, 0), 6) AS y, split = 'train' AS train, split = 'val' AS val, split = 'test' AS test,
  split = 'train' AND target IS NOT NULL AND masked <= 0.5 AS train_effective, split = 'val' AND target IS NOT NULL AND masked <= 0.5 AS val_effective, split = 'test' AND target IS NOT NULL AND masked <= 0.5 AS test_effective FROM g JOIN named USING (node_id)""")
def m08_m09_d13_snapshot_masks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("node_id"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("q"))
    rows = rows.withColumns({"target": F.when(F.dayofyear("day") % 4 > 0, F.col("q")), "masked": F.when(F.dayofyear("day") % 7 == 0, 1.0).otherwise(0.0)})
    nodes = table(spark, d, "supplier").select(F.col("s_name").alias("station"), F.col("s_suppkey").alias("node_id"))
    out = preparation.snapshot_masks(rows, _splits(spark, d).join(nodes, "station"), ["q"], [])
    return out.select("node_id", "day", r("q"), r("y"), "train", "val", "test", "train_effective", "val_effective", "test_effective")


@query("WITH f AS (SELECT l_suppkey AS node_id, round(arg_min(l_tax, (l_shipdate, l_orderkey, l_linenumber)), 6) AS mean FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) SELECT node_id, mean, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM f")
def m10_node_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("day"), F.when(F.col("l_quantity") > 45, F.col("l_quantity")).alias("value"), F.col("l_tax").alias("mean"))
    return preparation.node_means(rows, "value", "mean", cut=stored).select("node_id", r("mean"), "idx")


@query("WITH f AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY ALL) SELECT day, count(*) AS n, min(l_suppkey) AS first, max(l_suppkey) AS last FROM f GROUP BY day")
def m11_d13_snapshots(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rows = li.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("node_id")).agg(F.avg("l_quantity").alias("q"))
    out = preparation.snapshots(rows, ["q"])
    return out.select("day", F.size("nodes").cast("long").alias("n"), F.element_at("nodes", 1)["node_id"].alias("first"), F.element_at("nodes", -1)["node_id"].alias("last"))


_Q = "q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.75) AS b FROM pred)"


@query(f"WITH {_PRED}, {_Q} SELECT station, day, round(least(3, 1 + 0.8 * abs(y - m) / (b - a)), 6) AS weight FROM pred, q")
def n05_peak_weights(spark: SparkSession, d: str) -> DataFrame:
    return model_terms.peak_weights(_pred(spark, d), "y").select("station", "day", r("weight"))


@query(f"""WITH {_PRED}, {_Q}, w AS (SELECT station, day, y, p, least(3, 1 + 0.8 * abs(y - m) / (b - a)) AS w, p - y AS e, y / 60 AS g FROM pred, q WHERE p IS NOT NULL),
  d1 AS (SELECT *, e - lag(e) OVER o AS d, y - lag(y) OVER o AS rr FROM w WINDOW o AS (PARTITION BY station ORDER BY day)), d2 AS (SELECT *, d - lag(d) OVER (PARTITION BY station ORDER BY day) AS c FROM d1)
SELECT station, round(sum(w * e * e) / sum(w), 6) AS weighted_mse, round(avg(d * d), 6) AS rate, round(avg(c * c), 6) AS curvature, round(avg(rr * rr), 6) AS residual_smooth, round(avg(g), 6) AS gate_mean,
  round(avg(-(greatest(1e-6, least(1 - 1e-6, g)) * ln(greatest(1e-6, least(1 - 1e-6, g))) + (1 - greatest(1e-6, least(1 - 1e-6, g))) * ln(1 - greatest(1e-6, least(1 - 1e-6, g))))), 6) AS gate_entropy FROM d2 GROUP BY station""")
def n05_loss_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = model_terms.peak_weights(_pred(spark, d), "y").where(F.col("p").isNotNull()).withColumns({"res": F.col("y"), "g": F.col("y") / 60})
    out = model_terms.loss_terms(rows, "y", "p", "res", "g", ["station"], "day")
    return out.select("station", *(r(c) for c in ("weighted_mse", "rate", "curvature", "residual_smooth", "gate_mean", "gate_entropy")))


@query("WITH x AS (SELECT event_id, value, (0.15 + 0.85 / (1 + exp(-(value - 50) / 20)))::DOUBLE AS a FROM events) SELECT event_id, round(a * value + (1 - a) * 10, 6) AS gated, round(1.5 * value + 2, 6) AS modulated FROM x")
def n03_gate_and_modulation(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r(model_terms.gated(v, F.lit(10.0), (v - 50) / 20)).alias("gated"), r(model_terms.modulated(v, F.lit(1.5), F.lit(2.0))).alias("modulated"))


def _cell() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a cell with two inputs and three hidden numbers."""
    rng = np.random.default_rng(55)
    return rng.normal(size=(12, 2)), rng.normal(size=(12, 3)), rng.normal(size=12)


def _recurrent_sql() -> str:
    """The cell, a day a step: sums of each gate, then the state."""
    w, u, b = (x.round(6).tolist() for x in _cell())
    unit = lambda z: f"(1 / (1 + exp(-({z}))))"
    z = [f"{b[g]} + {w[g][0]} * n.y / 50 + {w[g][1]} * n.p / 50 + {u[g][0]} * s.h0 + {u[g][1]} * s.h1 + {u[g][2]} * s.h2" for g in range(12)]
    c = [f"{unit(z[3 + i])} * s.c{i} + {unit(z[i])} * tanh({z[6 + i]})" for i in range(3)]
    h = [f"{unit(z[9 + i])} * tanh({c[i]})" for i in range(3)]
    zero = ", ".join(f"0.0::DOUBLE AS {x}{i}" for x in "ch" for i in range(3))
    return f"""WITH RECURSIVE {_PRED}, turns AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day) AS k FROM pred WHERE p IS NOT NULL),
  s AS (SELECT station, NULL::DATE AS day, 0::BIGINT AS k, {zero} FROM (SELECT DISTINCT station FROM turns) UNION ALL SELECT n.station, n.day, n.k, {', '.join(c + h)} FROM s JOIN turns n ON n.station = s.station AND n.k = s.k + 1)
SELECT station, day, {', '.join(f'round(h{i}, 6) AS h{i}' for i in range(3))} FROM s WHERE k > 0"""


@query(_recurrent_sql())
def n02_recurrent(spark: SparkSession, d: str) -> DataFrame:
    rows = _pred(spark, d).where(F.col("p").isNotNull()).select("station", "day", F.array(F.col("y") / 50, F.col("p") / 50).alias("x"))
    out = model_terms.recurrent(rows, "x", *(x.round(6) for x in _cell()))
    return out.select("station", "day", *(r(F.col("hidden")[i]).alias(f"h{i}") for i in range(3)))
