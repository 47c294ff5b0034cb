"""Scaling, encoding, splits and masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import scaler, standardised
from .order import Cut, numbered

SENTINEL = -999.0
MISSING = "__MISSING_CAT__"


def column_groups(columns: Sequence[str], groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The columns of each group that are there; raises if one belongs to none or to two."""
    found = {g: [c for c in names if c in columns] for g, names in groups.items()}
    flat = [c for names in found.values() for c in names]
    if len(flat) != len(set(flat)) or set(flat) != set(columns):
        raise ValueError(f"unplaced columns: {sorted(set(columns) - set(flat))}; placed twice: {sorted(c for c in set(flat) if flat.count(c) > 1)}")
    return found


def prefixed(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """Columns that start with any of the prefixes, each once, in order."""
    return [c for c in columns if c.startswith(tuple(prefixes))]


def categories(df: DataFrame, columns: Sequence[str], missing: bool = False) -> DataFrame:
    """``feature, category, idx`` of all values, in order; nulls count as a category only if ``missing``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if missing else F.col(c).cast("string")).alias("category")) for c in columns))
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("category is not null").distinct()
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("feature").orderBy("category")) - 1).cast("long"))


def one_hot(df: DataFrame, known: Mapping[str, Sequence[str]], where: Column | None = None, missing: bool = False) -> DataFrame:
    """``feature_category`` columns of 1 and 0 in place of the features; unknown values, and rows outside ``where``, are all 0."""
    flags = {}
    for feature, values in known.items():
        value = F.coalesce(F.col(feature).cast("string"), F.lit(MISSING)) if missing else F.col(feature).cast("string")
        for v in values:
            hit = F.coalesce(value == v, F.lit(False)) & (where if where is not None else F.lit(True))
            flags[f"{feature}_{v}"] = F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0).cast("float")
    return df.withColumns(flags).drop(*known)


def with_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    return df.fillna(sentinel, subset=list(columns))


def scale_stations(df: DataFrame, columns: Sequence[str], train: Column, sentinel: float = SENTINEL) -> DataFrame:
    """Standardised by the training rows' observed values; sentinels are neither counted nor moved."""
    observed = df.select("*", *(F.when(F.col(c) != sentinel, F.col(c)).alias(f"_o_{c}") for c in columns))
    names = [f"_o_{c}" for c in columns]
    scaled = standardised(observed, scaler(observed.where(train), names), names)
    return scaled.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.when(F.col(c).isNotNull(), F.lit(sentinel).cast("float"))) for c in columns}).drop(*names)


def target_block(df: DataFrame, train: Column, station: Column, numeric: Sequence[str], categorical: Sequence[str], target: str, sentinel: float = SENTINEL) -> DataFrame:
    """The columns that belong to stations, made ready in place; other columns stay as they are, and come first.

    ``numeric``: nulls become the sentinel; values of station rows are standardised by those of training rows, sentinels neither counted nor
    moved. ``target``: standardised by the training rows' values, wherever there is one. ``categorical``: one column a value that training
    rows have (a missing one is a value of its own), 1 or 0, all 0 in rows without a station. All of them are floats. ``train`` and ``station`` are
    conditions; nothing but training rows is fitted to. A column that isn't there is passed over.
    """
    numeric, categorical = ([c for c in names if c in df.columns] for names in (numeric, categorical))
    train, station = (F.coalesce(c, F.lit(False)) for c in (train, station))
    rows = df.withColumns({"_train": train & station, "_station": station})
    listed = categories(rows.where("_train"), categorical, missing=True).orderBy("feature", "idx").collect() if categorical else []  # the categories of a few columns
    known = {c: [r["category"] for r in listed if r["feature"] == c] for c in categorical}
    filled = with_sentinel(rows.withColumns({c: F.col(c).cast("double") for c in numeric}), numeric, sentinel) if numeric else rows
    scaled = scale_stations(filled.withColumns({f"_s_{c}": F.col(c) for c in numeric}), [f"_s_{c}" for c in numeric], F.col("_train"), sentinel) if numeric else filled
    own = {c: F.coalesce(F.when(F.col("_station"), F.col(f"_s_{c}")), F.col(c).cast("float"), F.lit(sentinel).cast("float")) for c in numeric}
    fitted = scaler(rows.where("_train"), [target])
    out = standardised(scaled.withColumns(own), fitted, [target])
    out = one_hot(out, known, F.col("_station"), missing=True) if known else out
    flags = [f"{c}_{v}" for c, values in known.items() for v in values]
    others = [c for c in df.columns if c not in {*numeric, *categorical, target}]
    return out.select(*others, *numeric, *flags, target)


def split_sizes(n: int, train: float, validation: float, test: float) -> tuple[int, int, int]:
    """Counts by percentage, rounded half-even; what is left over trains."""
    v, t = round(n * validation / 100), round(n * test / 100)
    if v + t > n or abs(train + validation + test - 100) > 1e-6:
        raise ValueError("shares must make 100 % and fit the stations")
    return n - v - t, v, t


def split_stations(stations: DataFrame, shares: tuple[float, float, float], seed: int, shortlist: Sequence[str] = (), key: str = "station", cut: Cut | None = None) -> DataFrame:
    """``station, split``: the shortlist first, then by a seeded hash, fill test and validation; the rest trains.

    With ``cut``, which stores rows, all tasks rank the stations; without, one does (thousands of rows).
    """
    names = stations.select(key).distinct()
    n = names.count()
    _, v, t = split_sizes(n, *shares)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    prefer = F.array_position(F.array(*map(F.lit, shortlist)), F.col(key).cast("string")) if shortlist else F.lit(0)
    order = F.struct(F.when(prefer > 0, prefer).otherwise(len(shortlist) + 1).alias("first"), draw.alias("draw"))
    ranked = numbered(names.withColumn("_order", order), "_order", name="_r", cut=cut).withColumn("_r", F.col("_r") + 1)
    return ranked.select(key, F.when(F.col("_r") <= t, "test").when(F.col("_r") <= t + v, "val").otherwise("train").alias("split"))


def split_faults(splits: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Stations in several splits or in none; no rows if all is well."""
    many = splits.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").select(key, F.lit("several").alias("fault"))
    none = stations.select(key).distinct().join(splits, key, "left_anti").select(key, F.lit("none").alias("fault"))
    return many.union(none)


def snapshot_masks(df: DataFrame, splits: DataFrame, numeric: Sequence[str], flags: Sequence[str], target: str = "target", masked: str = "masked", node: str = "node_id", sentinel: float = SENTINEL) -> DataFrame:
    """Adds ``y`` (target, null as 0), ``train/val/test`` and, where the target is observed and not made up, their ``_effective``.

    Of validation and test nodes, rows without a target get the sentinel for ``numeric`` and 0 for ``flags``.
    """
    joined = df.join(splits.select(node, "split"), node, "left")
    blind = F.coalesce(F.col("split").isin("val", "test"), F.lit(False)) & F.col(target).isNull()
    out = joined.withColumns({c: F.when(blind, sentinel).otherwise(F.col(c)) for c in numeric} | {c: F.when(blind, 0.0).otherwise(F.col(c)) for c in flags})
    seen = F.col(target).isNotNull() & F.coalesce(F.col(masked) <= 0.5, F.lit(False))
    member = {s: F.coalesce(F.col("split") == s, F.lit(False)) for s in ("train", "val", "test")}
    return out.withColumns(member | {f"{s}_effective": m & seen for s, m in member.items()} | {"y": F.coalesce(F.col(target), F.lit(0.0))}).drop("split")


def snapshots(df: DataFrame, columns: Sequence[str], time: str = "day", node: str = "node_id") -> DataFrame:
    """One row a timestep: its nodes' columns in order of the node."""
    return df.groupBy(time).agg(F.sort_array(F.collect_list(F.struct(node, *columns))).alias("nodes"))


def node_means(df: DataFrame, value: str, mean: str, node: str = "node_id", time: str = "day", cut: Cut | None = None) -> DataFrame:
    """``node_id, idx, mean``: the first non-null ``mean`` of each node that has a ``value``, numbered by node (``cut`` as for ``numbered``)."""
    rows = df.where(F.col(value).isNotNull()).groupBy(node).agg(F.min_by(mean, F.when(F.col(mean).isNotNull(), F.col(time))).alias(mean))
    return numbered(rows, node, name="idx", cut=cut)
