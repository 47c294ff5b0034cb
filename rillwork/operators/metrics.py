"""Goodness of predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, spread


def errors(df: DataFrame, truth: str, estimate: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mae, mse, rmse, bias, nse, r, alpha, beta, kge`` over rows with both, for each group.

    NSE is 1 less the squared error over the truth's spread, KGE 1 less the distance of (r, alpha, beta) from 1; null where a
    spread or mean is 0. One aggregation: the truth's spread is its population variance.
    """
    y, p = F.col(truth), F.col(estimate)
    both = df.where(y.isNotNull() & p.isNotNull())
    e = p - y
    agg = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.avg(e).alias("bias"),
        F.var_pop(y).alias("_var"),
        correlation(y, p).alias("r"),
        spread(y).alias("_sy"),
        spread(p).alias("_sp"),
        F.avg(y).alias("_my"),
        F.avg(p).alias("_mp"),
    )
    some = lambda c: F.when(F.col(c) != 0, F.col(c))
    agg = agg.withColumns({
        "rmse": F.sqrt("mse"),
        "nse": 1 - F.col("mse") / F.when(F.col("_sy") != 0, some("_var")),
        "r": F.when((F.col("_sy") > 0) & (F.col("_sp") > 0), F.col("r")),
        "alpha": F.col("_sp") / some("_sy"),
        "beta": F.col("_mp") / some("_my"),
    })
    kge = 1 - F.sqrt(F.pow(F.col("r") - 1, 2) + F.pow(F.col("alpha") - 1, 2) + F.pow(F.col("beta") - 1, 2))
    return agg.withColumn("kge", kge).select(*by, "n", "mae", "mse", "rmse", "bias", "nse", "r", "alpha", "beta", "kge")


def offset_adjusted(df: DataFrame, truth: str, estimate: str, by: Sequence[str]) -> DataFrame:
    """``estimate`` moved so that its group's mean is that of the truth."""
    w = Window.partitionBy(*by)
    return df.withColumn(estimate, F.col(estimate) - (F.avg(estimate).over(w) - F.avg(truth).over(w)))


def first_point_aligned(df: DataFrame, truth: str, estimate: str, by: Sequence[str], time: str) -> DataFrame:
    """``estimate`` moved so that the first row with both agrees."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(estimate, F.col(estimate) - F.first(F.col(estimate) - F.col(truth), ignorenulls=True).over(w))


def tolerance_shares(df: DataFrame, truth: str, estimate: str, tolerances: Sequence[float] = (0.3, 0.5, 1.0), by: Sequence[str] = ()) -> DataFrame:
    """For each group the share of rows whose error is at most each tolerance: ``within_0_3`` and so on."""
    off = F.abs(F.col(estimate) - F.col(truth))
    return df.where(off.isNotNull()).groupBy(*by).agg(*(F.avg((off <= t).cast("double")).alias(f"within_{str(t).replace('.', '_')}") for t in tolerances))


def block_means(df: DataFrame, size: int, columns: Sequence[str], by: Sequence[str], time: str) -> DataFrame:
    """Means over stretches of ``size`` rows each; a last, shorter one is dropped."""
    w = Window.partitionBy(*by).orderBy(time)
    blocks = df.withColumn("block", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return blocks.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(c) for c in columns)).where(F.col("_n") == size).drop("_n")


#: Rows of a chunk of ``best_lag``, at least; a chunk is also at least twice the longest lag.
CHUNK = 4096


def lag_sums(a: np.ndarray, b: np.ndarray, most: int) -> list[np.ndarray]:
    """For each lag from ``-most`` to ``most``, over the places where ``a[i]`` and ``b[i + most + lag]`` are both there: their number, and the sums of
    a, b, a², b² and ab. ``b`` reaches ``most`` further than ``a`` on both sides; NaN is missing. Six correlations by Fourier transforms."""
    n = 1 << (len(a) + len(b)).bit_length()
    ma, mb = (~np.isnan(v) for v in (a, b))
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    left = [np.conj(np.fft.rfft(v, n)) for v in (ma.astype(float), a, a * a)]
    right = [np.fft.rfft(v, n) for v in (mb.astype(float), b, b * b)]
    sums = [np.fft.irfft(left[i] * right[j], n)[: 2 * most + 1] for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))]
    return [np.rint(sums[0]), *sums[1:]]


def best_lag(df: DataFrame, a: str, b: str, by: Sequence[str], time: str, most: int = 300, least: int = 3) -> DataFrame:
    """``lag, r, n`` of the shift of ``b`` against ``a``, in rows, with the largest correlation (least lag of ties).

    Series are cut into chunks that overlap by ``most`` rows either way, so a row goes to two chunks at most; a chunk's sums
    for all lags come from Fourier transforms of values less the series' mean, and are added up over chunks. Correlations are compared to 9 places.
    """
    size = max(CHUNK, 2 * most)
    whole = Window.partitionBy(*by)
    rows = df.select(*by, F.row_number().over(whole.orderBy(time)).alias("_i"), *((F.col(c).cast("double") - F.avg(c).over(whole)).alias(f"_{s}") for c, s in ((a, "a"), (b, "b"))))
    rows = rows.withColumn("_i", F.col("_i") - 1)
    chunk = F.floor(F.col("_i") / size)
    near = F.array_compact(F.array(chunk, F.when(F.col("_i") % size < most, chunk - 1), F.when(F.col("_i") % size >= size - most, chunk + 1)))
    dealt = rows.withColumn("_c", F.explode(near))

    def sums(table: pa.Table) -> pa.Table:
        first = table.column("_c")[0].as_py() * size
        at = table.column("_i").to_numpy() - first + most
        wide_a, wide_b = np.full(size + 2 * most, np.nan), np.full(size + 2 * most, np.nan)
        wide_a[at], wide_b[at] = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b"))
        found = lag_sums(wide_a[most : most + size], wide_b, most)
        keys = {k: pa.array([table.column(k)[0].as_py()] * (2 * most + 1), table.schema.field(k).type) for k in by}
        return pa.table(keys | {"lag": pa.array(np.arange(-most, most + 1), pa.int32())} | {c: pa.array(v) for c, v in zip(("n", "sa", "sb", "saa", "sbb", "sab"), found)})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    moments = ("n", "sa", "sb", "saa", "sbb", "sab")
    parts = dealt.groupBy(*by, "_c").applyInArrow(sums, ", ".join(filter(None, [kinds, "lag int", *(f"{c} double" for c in moments)])))
    scored = parts.groupBy(*by, "lag").agg(*(F.sum(c).alias(c) for c in moments)).where(F.col("n") >= least)
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    varied = lambda s, ss: F.when(spread(s, ss) > 1e-9 * F.col(ss), F.sqrt(spread(s, ss)))
    r = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), varied("sa", "saa") * varied("sb", "sbb"))
    scored = scored.select(*by, "lag", r.alias("r"), F.col("n").cast("long").alias("n")).where(F.col("r").isNotNull())
    best = F.max_by(F.struct("lag", "r", "n"), F.struct(F.bround("r", 9), -F.col("lag")))
    return scored.groupBy(*by).agg(best.alias("_x")).select(*by, "_x.lag", "_x.r", "_x.n")


def inverse_standard(value: Column, mean: Column, scale: Column) -> Column:
    return value * scale + mean


def after_burn_in(df: DataFrame, rows: int, by: Sequence[str], time: str) -> DataFrame:
    """Without the first ``rows`` rows of each group."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(time))).where(F.col("_i") > rows).drop("_i")


def contribution(df: DataFrame, part: str, base: str, by: Sequence[str] = ()) -> DataFrame:
    """``share``: total size of ``part`` over that of ``base``."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.abs(part)), F.sum(F.abs(base))).alias("share"))


def confidence_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``mean, sd`` (of a sample)``, ci`` (1.96 standard errors)``, n``."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("ci"), F.count(value).alias("n"))


def five_numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("most"))
    return out.select(*by, "least", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "most")


def trial_ranking(trials: DataFrame, trial: str, metric: str, config: Sequence[str], order: str, top: int = 10) -> DataFrame:
    """The best trials by least, then mean metric, with the config of each trial's first row."""
    agg = trials.groupBy(trial).agg(F.min(metric).alias("min_val"), F.avg(metric).alias("mean_val"), F.max(metric).alias("max_val"), F.min_by(F.struct(*config), order).alias("_c"))
    return agg.select(trial, "min_val", "mean_val", "max_val", "_c.*").orderBy("min_val", "mean_val", trial).limit(top)


def pivoted(df: DataFrame, rows: str, columns: str, names: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """One column for each of ``names``, mean values rounded half-even."""
    wide = df.groupBy(rows).pivot(columns, list(names)).agg(F.avg(value))
    return wide.select(rows, *(F.bround(n, digits).alias(n) for n in names))
