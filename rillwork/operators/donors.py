"""Long gaps filled from weighted donor stations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decay_score, haversine, planar
from .gaps import gap_runs, imputable_holes, neighbours, runs
from .metrics import errors


def wide_area(stations: DataFrame, threshold_m: float = 50000.0, sides: Sequence[str] = ("easting", "northing")) -> DataFrame:
    """One row ``wide``: whether the stations' bounding box exceeds the threshold on any of ``sides``."""
    return stations.agg(reduce(or_, (F.max(c) - F.min(c) > threshold_m for c in sides)).alias("wide"))


#: Pairs of stations that a task of ``station_distances`` looks at, about.
PAIRS = 10_000_000


def station_distances(stations: DataFrame, threshold_m: float = 50000.0, sides: Sequence[str] = ("easting", "northing")) -> DataFrame:
    """``a, b, distance_m`` of each pair of stations: along the globe over a wide area (by ``sides``), else in the plane; to cm.

    Hundredfold distances are rounded, halves to even, as NumPy does; ``bround`` goes by the decimals that a double prints as.

    Pairs are dealt to tasks by their first station, about ``PAIRS`` a task, and made one by one: time grows with their number, memory with stations.
    """
    wide = F.broadcast(wide_area(stations, threshold_m, sides))  # one row
    a, b = (stations.select(*(F.col(c).alias(f"{c}_{s}") for c in ("station", "easting", "northing", "lat", "lon"))) for s in "ab")
    n = stations.count()
    pairs = a.repartition(max(1, -(-n * n // PAIRS))).join(F.broadcast(b), F.col("station_a") < F.col("station_b")).crossJoin(wide)
    far = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    near = planar(F.col("easting_a"), F.col("northing_a"), F.col("easting_b"), F.col("northing_b"))
    return pairs.select(F.col("station_a").alias("a"), F.col("station_b").alias("b"), (F.rint(F.when(F.col("wide"), far).otherwise(near) * 100) / 100).alias("distance_m"))


#: Stations and times of a block of ``pair_correlations``.
STATIONS, TIMES = 64, 2048


def _moments(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each pair of rows: common entries, and over them the sums of a, b, a², b² and ab. NaN is missing."""
    ma, mb = (~np.isnan(v) for v in (a, b))
    a, b, ma, mb = np.where(ma, a, 0.0), np.where(mb, b, 0.0), ma.astype(np.float64), mb.astype(np.float64)
    return [ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T, a @ b.T]


def pair_correlations(df: DataFrame, least: int = 365, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``a, b, n, r`` of each pair with common times: Pearson's r, null below ``least`` of them or where a side doesn't vary, negative ones 0.

    Values, less their station's mean, are packed into blocks of about ``STATIONS`` stations by ``TIMES`` times, with gaps marked; each block
    meets those of the same times, and six matrix products give the moments of all their pairs at once, which are summed over
    blocks of times. So what is shuffled grows with blocks, not with pairs times days. A station's times should differ; of repeats the mean counts.
    Null stations, times and values are left out.
    """
    known = df.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(time).isNotNull())
    kind = df.schema[time].dataType.simpleString()
    stamp = F.unix_date(time).cast("long") if kind == "date" else F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(time)
    sizes = known.agg(F.countDistinct(key).alias("s"), F.countDistinct(time).alias("t")).first()
    groups, spans = max(1, -(-sizes["s"] // STATIONS)), max(1, -(-sizes["t"] // TIMES))
    means = known.groupBy(F.col(key).alias("s")).agg(F.avg(value).alias("m"))
    rows = known.select(F.col(key).alias("s"), stamp.alias("t"), F.col(value).cast("double").alias("v")).join(means, "s").select("s", "t", (F.col("v") - F.col("m")).alias("v"))
    rows = rows.withColumns({"g": F.pmod(F.xxhash64("s"), F.lit(groups)).cast("int"), "u": F.pmod(F.xxhash64("t"), F.lit(spans)).cast("int")})
    key_type = df.schema[key].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        t, i = np.unique(table.column("t").to_numpy(), return_inverse=True)
        coded = table.column("s").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        j, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        total, count = np.zeros((len(names), len(t))), np.zeros((len(names), len(t)))
        np.add.at(total, (j, i), table.column("v").to_numpy())
        np.add.at(count, (j, i), 1)
        with np.errstate(invalid="ignore"):
            cells = total / np.where(count == 0, np.nan, count)
        one = lambda c: table.column(c)[0].as_py()
        return pa.table({"g": pa.array([one("g")], pa.int32()), "u": pa.array([one("u")], pa.int32()), "names": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "t": pa.array([t.tobytes()]), "cells": pa.array([cells.tobytes()])})

    blocks = rows.groupBy("g", "u").applyInArrow(pack, f"g int, u int, names array<{key_type}>, t binary, cells binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    pairs = blocks.withColumn("o", other).select(F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"), "u", "g", "names", "t", "cells")

    def multiply(table: pa.Table) -> pa.Table:
        held = {}
        for x in table.to_pylist():
            times = np.frombuffer(x["t"], np.int64)
            held[x["g"]] = x["names"], times, np.frombuffer(x["cells"]).reshape(len(x["names"]), len(times))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        out = {c: [] for c in ("a", "b", "n", "sa", "sb", "saa", "sbb", "sab")}
        if p in held and q in held:
            (names_p, t_p, v_p), (names_q, t_q, v_q) = held[p], held[q]
            _, i, j = np.intersect1d(t_p, t_q, assume_unique=True, return_indices=True)
            n, sa, sb, saa, sbb, sab = _moments(v_p[:, i], v_q[:, j])
            for r, c in zip(*np.nonzero(n)):
                a, b = names_p[r], names_q[c]
                if p == q and a >= b:
                    continue
                turn = a > b
                for name, v in zip(out, (b if turn else a, a if turn else b, int(n[r, c]), *((sb, sa) if turn else (sa, sb)), *((sbb, saa) if turn else (saa, sbb)), sab)):
                    out[name].append(v if not isinstance(v, np.ndarray) else float(v[r, c]))
        names = table.schema.field("names").type.value_type
        kinds = {"a": names, "b": names, "n": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()})

    parts = pairs.groupBy("p", "q", "u").applyInArrow(multiply, f"a {key_type}, b {key_type}, n bigint, sa double, sb double, saa double, sbb double, sab double")
    whole = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    varied = lambda s, ss: F.when(spread(s, ss) > 1e-12 * F.col(ss), F.sqrt(spread(s, ss)))
    r = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), varied("sa", "saa") * varied("sb", "sbb"))
    return whole.select("a", "b", "n", F.when(F.col("n") >= least, F.when(r.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))).alias("r"))


def donor_scores(distances: DataFrame, correlations: DataFrame, k: float = 0.05, threshold: float = 0.3) -> DataFrame:
    """``station, donor, score`` both ways, of pairs that reach the threshold."""
    scored = correlations.join(distances, ["a", "b"]).select("a", "b", decay_score(F.col("r"), F.col("distance_m"), k).alias("score"))
    both = scored.select(F.col("a").alias("station"), F.col("b").alias("donor"), "score").union(scored.select("b", "a", "score"))
    return both.where(F.col("score") >= threshold)


def donor_offsets(df: DataFrame, scores: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``scores`` with ``shift``: mean difference of station and donor over common times; 0 without any."""
    known = df.where(F.col(value).isNotNull())
    own, other = (known.select(F.col(key).alias(k), F.col(time).alias("t"), F.col(value).alias(v)) for k, v in (("station", "v"), ("donor", "dv")))
    both = scores.join(own, "station", "left").join(other, ["donor", "t"], "left")
    return both.groupBy("station", "donor", "score").agg(F.coalesce(F.avg(F.col("v") - F.col("dv")), F.lit(0.0)).alias("shift"))


def seasonal_means(df: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    return df.groupBy(key, F.dayofyear(time).alias("doy")).agg(F.avg(value).alias("seasonal"))


def donor_estimates(df: DataFrame, scores: DataFrame, longest: int = 200, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``station, day, estimate`` for each hole to impute of stations with a donor: the donors' weighted mean, shifted to the
    station's level; the station's mean for that day of the year where no donor has a value."""
    holes = imputable_holes(df, longest, key, time, value).select(F.col(key).alias("station"), F.col(time).alias("day"))
    weights = donor_offsets(df, scores, key, time, value)
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("donor"), F.col(time).alias("day"), F.col(value).alias("dv"))
    asked = holes.join(weights, "station").join(known, ["donor", "day"], "left")
    has = F.col("dv").isNotNull()
    weighed = asked.groupBy("station", "day").agg(
        F.try_divide(F.sum(F.when(has, F.col("score") * (F.col("dv") + F.col("shift")))), F.sum(F.when(has, F.col("score")))).alias("by_donors"),
    )
    # a station none of whose donors has a value at any hole is passed over
    some = weighed.withColumn("_some", F.count("by_donors").over(Window.partitionBy("station"))).where("_some > 0")
    curve = seasonal_means(df, key, time, value).select(F.col(key).alias("station"), "doy", "seasonal")
    out = some.withColumn("doy", F.dayofyear("day")).join(curve, ["station", "doy"], "left")
    return out.select("station", "day", F.coalesce("by_donors", "seasonal").alias("estimate"))


def fit_to_edges(df: DataFrame, key: str = "station", time: str = "day", value: str = "value", estimate: str = "estimate") -> DataFrame:
    """Needs the station's series with ``value`` and, at holes, ``estimate``. Adds ``fitted``: each run's estimates moved to its edges.

    Between two values: moved to follow the last, then ramped to meet the next. At the end of a series: so that the first
    follows the last value. At its beginning: so that the last precedes the next value.
    """
    w = Window.partitionBy(key, "run").orderBy(time)
    run = Window.partitionBy(key, "run")
    placed = neighbours(runs(df, key, time, value), key, time, value)
    placed = placed.withColumns({
        "_first": F.first(estimate, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_last": F.last(estimate, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_i": F.row_number().over(w) - 1,
        "_n": F.count(F.lit(1)).over(run),
    })
    moved = F.col(estimate) + F.col("prev_value") - F.col("_first")
    miss = F.col("next_value") - (F.col("_last") + F.col("prev_value") - F.col("_first"))
    ramp = F.when(F.col("_n") == 1, 1.0).otherwise(F.col("_i") / (F.col("_n") - 1))
    fitted = (
        F.when(F.col("prev_value").isNull() & F.col("next_value").isNull(), F.col(estimate))
        .when(F.col("prev_value").isNull(), F.col(estimate) + F.col("next_value") - F.col("_last"))
        .when(F.col("next_value").isNull(), moved)
        .otherwise(moved + ramp * miss)
    )
    return placed.withColumn("fitted", F.when(F.col("missing"), fitted)).drop("_first", "_last", "_i", "_n")


def impute(df: DataFrame, scores: DataFrame, longest: int = 200, two_pass: bool = True, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``df`` with holes filled from donors; ``data_type`` (added if missing) becomes ``imputed_long`` there.

    All stations are filled from observed values only, so the order of stations doesn't matter.
    """
    estimates = donor_estimates(df, scores, longest, key, time, value).select(F.col("station").alias(key), F.col("day").alias(time), "estimate")
    joined = df.join(estimates, [key, time], "left")
    final = fit_to_edges(joined, key, time, value).withColumn("_new", F.col("fitted")) if two_pass else joined.withColumn("_new", F.col("estimate"))
    kind = F.col("data_type") if "data_type" in df.columns else F.lit("raw")
    hit = F.col(value).isNull() & F.col("_new").isNotNull()
    return final.withColumn("data_type", F.when(hit, "imputed_long").otherwise(kind)).withColumn(value, F.coalesce(value, "_new")).select(*[c for c in df.columns if c != "data_type"], "data_type")


def fill_levels(uses: list[tuple[str, str]], order: list[str]) -> list[list[str]]:
    """Stations of ``order`` in levels that are filled together, with the same values as one after another.

    ``uses`` are pairs of a station and a donor of its. A station comes after the donors that the order puts before it, and not after
    those that the order puts behind it, which it must still see unfilled; in one level all are seen as they were.
    """
    place = {s: i for i, s in enumerate(order)}
    after, upto = {s: [] for s in order}, {s: [] for s in order}
    for station, donor in uses:
        if station in place and donor in place and station != donor:
            if place[donor] < place[station]:
                after[station].append(donor)
            else:
                upto[donor].append(station)
    level: dict[str, int] = {}
    for s in order:
        level[s] = max([0, *(level[d] + 1 for d in after[s]), *(level[u] for u in upto[s])])
    return [[s for s in order if level[s] == i] for i in range(1 + max(level.values(), default=-1))]


def impute_in_order(df: DataFrame, scores: DataFrame, order: list[str], save, **options) -> DataFrame:
    """Fills stations one after another, each from all values there are by then, imputed ones too.

    Shifts and seasonal curves are of the values at that time. Stations that don't depend on each other are filled together, level by level of
    the donor graph, so there are as many steps as levels; ``save`` cuts lineage after each (a written table or ``DataFrame.checkpoint``).
    The driver holds the pairs of stations and donors.
    """
    if "data_type" not in df.columns:
        df = df.withColumn("data_type", F.lit("raw"))
    uses = [(r["station"], r["donor"]) for r in scores.select("station", "donor").distinct().collect()]
    for level in fill_levels(uses, order):
        names = df.sparkSession.createDataFrame([(s,) for s in level], scores.select("station").schema)
        df = save(impute(df, scores.join(F.broadcast(names), "station"), **options))
    return df


def seasonal_fix(df: DataFrame, station: str, start: str, end: str, years: int = 6, cap: tuple[str, float] | None = None, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """One station's values from ``start`` to ``end`` become its means by day of the year over the ``years`` before.

    ``cap`` bounds the value of one date. Days without such a mean keep their value.
    """
    first = F.lit(start).cast("date")
    before = df.where((F.col(key) == station) & (F.col(time) < first) & (F.col(time) >= F.add_months(first, -12 * years)))
    curve = before.groupBy(F.dayofyear(time).alias("_doy")).agg(F.avg(value).alias("_mean"))
    joined = df.withColumn("_doy", F.dayofyear(time)).join(curve, "_doy", "left")
    hit = (F.col(key) == station) & F.col(time).between(first, F.lit(end).cast("date"))
    new = F.coalesce(F.when(hit, F.col("_mean")), F.col(value))
    if cap:
        new = F.when((F.col(key) == station) & (F.col(time) == F.lit(cap[0]).cast("date")), F.least(new, F.lit(cap[1]))).otherwise(new)
    return joined.withColumn(value, new).select(df.columns)


def revert_and_mask(filled: DataFrame, truth: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Filled series with known values put back (but zeros); what is still missing is ``masked`` and gets the station's mean."""
    known = truth.select(key, time, F.col(value).alias("_truth"))
    joined = filled.join(known, [key, time], "left").withColumn(value, F.when(F.col("_truth").isNotNull() & (F.col("_truth") != 0), F.col("_truth")).otherwise(F.col(value)))
    masked = F.col(value).isNull()
    out = joined.withColumn("masked", masked).withColumn("data_type", F.when(masked, "masked").otherwise(F.col("data_type")))
    return out.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(key)))).drop("_truth")


def gap_lengths(df: DataFrame, predefined: tuple[int, ...] = (30, 60, 90, 120, 150), longest: int = 200, slack: int = 30, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``station, length``: synthetic gaps to try: up to ``longest`` for stations with a longer real gap, else up to the longest plus slack."""
    actual = gap_runs(df, key, time, value).groupBy(key).agg(F.max("n").alias("actual"))
    all_ = df.select(key).distinct().join(actual, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    tried = all_.withColumn("length", F.explode(F.array(*map(F.lit, predefined))))
    bound = F.when(F.col("actual") > longest, F.lit(longest)).otherwise(F.col("actual") + slack)
    return tried.where(F.col("length") <= bound).select(F.col(key), "length")


def synthetic_gaps(df: DataFrame, lengths: DataFrame, choices: tuple[int, ...] = (30, 60, 90, 120, 150), seed: int = 55, around: int = 10, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``station, length, start, end``: for each of ``lengths`` among ``choices``, the stretch that a seeded hash picks.

    Places are all rows that start a stretch of that length, in a daily series, with no value missing in it nor in ``around`` rows on
    either side: one window a choice counts them, over one sort. The least hash of (seed, station, length, day) wins, so a
    rerun picks the same; a station without a place has no gap.
    """
    w = Window.partitionBy(key).orderBy(time)
    present = F.col(value).isNotNull().cast("int")
    counts = {n: F.sum(present).over(w.rowsBetween(-around, n - 1 + around)) == n + 2 * around for n in choices}
    fitting = F.array_compact(F.array(*(F.when(fits, F.lit(n)) for n, fits in counts.items())))
    starts = df.select(key, F.col(time).alias("start"), fitting.alias("_fits")).withColumn("length", F.explode("_fits")).join(lengths.select(key, "length"), [key, "length"])
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.col("length").cast("string"), F.col("start").cast("string")).cast("binary"))
    chosen = starts.groupBy(key, "length").agg(F.min_by("start", draw).alias("start"))
    return chosen.withColumn("end", F.date_add("start", F.col("length") - 1))


def hide(df: DataFrame, gaps: DataFrame, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """``df`` with values inside the gaps removed and ``truth`` there."""
    marks = gaps.select(F.col(key).alias("_k"), F.explode(F.sequence("start", "end")).alias("_t")).distinct()
    joined = df.join(marks, (F.col(key) == F.col("_k")) & (F.col(time) == F.col("_t")), "left")
    hidden = F.col("_t").isNotNull()
    return joined.withColumn("truth", F.when(hidden, F.col(value))).withColumn(value, F.when(~hidden, F.col(value))).drop("_k", "_t")


def validate(df: DataFrame, gaps: DataFrame, fill, key: str = "station", time: str = "day", value: str = "value") -> DataFrame:
    """Per-station errors of ``fill`` (a function from series to series) on values hidden in ``gaps``."""
    hidden = hide(df, gaps, key, time, value)
    filled = fill(hidden.drop("truth")).select(key, time, F.col(value).alias("estimate"))
    both = hidden.where(F.col("truth").isNotNull()).select(key, time, "truth").join(filled, [key, time])
    return errors(both, "truth", "estimate", [key])
