"""Choosing stations by their surroundings: whitening, reduction, permutation tests, coverage.

For station tables: tens to thousands of rows with short vectors. Moments are aggregated by Spark; only matrices as
wide as a vector, or one row a station, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation

#: Partial moments that one task merges.
MERGED = 64


def _moments(vectors: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean, and products of what lies off it."""
    mean = vectors.mean(axis=0)
    return len(vectors), mean, (vectors - mean).T @ (vectors - mean)


def _merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    out = None
    for n, mean, products in parts:
        if out is None:
            out = n, mean, products
            continue
        total, off = out[0] + n, mean - out[1]
        out = total, out[1] + off * n / total, out[2] + products + np.outer(off, off) * out[0] * n / total
    return out


def moments(df: DataFrame, vector: str = "features") -> DataFrame:
    """One row ``n, mean, products`` (none without rows) of a column of equally long vectors: a partial one a task, merged ``MERGED`` at a time, then together.

    What is shuffled is a matrix a task, whatever the rows. Vectors that are null or hold a null or NaN are left out.
    """
    schema = "n bigint, mean array<double>, products array<double>"
    names = ["n", "mean", "products"]

    def rows(out: tuple | None) -> pa.Table:
        held = [] if out is None else [out]
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, ([o[0] for o in held], [o[1] for o in held], [o[2].ravel() for o in held]), kinds)})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                lists = batch.column(0).drop_null()
                if len(lists):
                    width = len(lists[0])
                    whole = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), width)
                    whole = whole[~np.isnan(whole).any(axis=1)]
                    if len(whole):
                        yield _moments(whole)

        yield from rows(_merged(each())).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        parts = ((x["n"], np.array(x["mean"]), np.array(x["products"]).reshape(len(x["mean"]), -1)) for x in table.select(names).to_pylist())
        return rows(_merged(parts))

    parts = df.select(F.col(vector)).mapInArrow(partial, schema)
    some = parts.groupBy(F.floor(F.spark_partition_id() / MERGED).alias("g")).applyInArrow(merge, schema)
    return some.groupBy().applyInArrow(merge, schema)


def covariance(df: DataFrame, vector: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and count of a column of equally long vectors."""
    row = moments(df, vector).first()
    if row is None:
        return np.empty(0), np.empty((0, 0)), 0
    mean = np.array(row["mean"])
    return mean, np.array(row["products"]).reshape(len(mean), -1) / max(row["n"] - 1, 1), row["n"]


def whitener(cov: np.ndarray, ridge: float = 1e-6, shrink: float = 0.0) -> np.ndarray:
    """Inverse square root of the covariance, shrunk towards its mean variance and with a ridge."""
    if len(cov):
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / len(cov) * np.eye(len(cov)) + ridge * np.eye(len(cov))
    values, vectors = np.linalg.eigh(cov)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T


def transformed(df: DataFrame, mean: np.ndarray, matrix: np.ndarray, vector: str = "features") -> DataFrame:
    """``vector`` less mean, times the matrix (rows: outputs)."""
    centred = F.zip_with(vector, F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x - m)
    row = lambda r: F.aggregate(F.zip_with("_c", F.array(*(F.lit(float(w)) for w in r)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_c", centred).withColumn(vector, F.array(*(row(r) for r in matrix))).drop("_c")


def whiten(df: DataFrame, vector: str = "features", ridge: float = 1e-6, shrink: float = 0.0, fit_on: DataFrame | None = None) -> DataFrame:
    mean, cov, _ = covariance(df if fit_on is None else fit_on, vector)
    return transformed(df, mean, whitener(cov, ridge, shrink), vector)


def principal(df: DataFrame, vector: str = "features", share: float = 0.95, least: int = 3, most: int = 12) -> DataFrame:
    """Scores on as many principal directions as hold ``share`` of the variance, between ``least`` and ``most``.

    Directions point so that their largest component is positive.
    """
    mean, cov, _ = covariance(df, vector)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    k = min(max(int(np.searchsorted(held, share - 1e-12)) + 1, least), most, len(values))
    chosen = vectors[:, :k].T
    chosen = chosen * np.sign(chosen[np.arange(k), np.abs(chosen).argmax(axis=1)])[:, None]
    return transformed(df, mean, chosen, vector)


def vector_distances(df: DataFrame, key: str = "station", vector: str = "features") -> DataFrame:
    """``a, b, distance`` of each pair."""
    a, b = (df.select(F.col(key).alias(s), F.col(vector).alias(f"v{s}")) for s in "ab")
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", d.alias("distance"))


def mid_ranks(df: DataFrame, value: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``value, rank`` of each distinct value: its place among all rows, equal values sharing their mean one. Nulls have none.

    Equal values are counted first, so that none lies in two ranges of the sort; each range adds up its own counts, and a total a range offsets
    them. ``cut`` stores the sorted counts; the driver sees a number a range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = cut(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    totals = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.sum("_n").alias("n")).collect())
    offsets = np.cumsum([0, *(n for _, n in totals)]).tolist()
    before = df.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets)], "_part int, _before bigint")
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(value))
    return ordered.withColumn("_upto", inside).join(F.broadcast(before), "_part").select(value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row ``rho, n``: correlation of ranks, equal values sharing their mean rank; rows with both values only.

    Equal pairs are counted before they meet their ranks.
    """
    both = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("_w")))
    spread = both.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_w")))).select("x", "y")
    rank = {c: mid_ranks(spread, c, cut).withColumnRenamed("rank", f"r{c}") for c in ("x", "y")}
    ranked = both.join(rank["x"], "x").join(rank["y"], "y")
    n = F.sum("_w")
    mean = {c: F.sum(F.col(f"r{c}") * F.col("_w")) / n for c in ("x", "y")}
    m = ranked.agg(mean["x"].alias("mx"), mean["y"].alias("my")).first()  # (n + 1) / 2 each
    dx, dy = (F.col(c) - F.lit(v) for c, v in (("rx", m["mx"]), ("ry", m["my"])))
    product = lambda p, q: F.sum(p * q * F.col("_w"))
    return ranked.agg(F.try_divide(product(dx, dy), F.sqrt(product(dx, dx)) * F.sqrt(product(dy, dy))).alias("rho"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def mantel(near: DataFrame, far: DataFrame, permutations: int = 999, seed: int = 55) -> DataFrame:
    """One row ``r, p``: correlation of two distance tables (``a, b, distance``) of the same stations, and how often a renaming does as well.

    A renaming gives each station, in order of name, that of equal place in the order of an MD5 of seed, number and name. All renamings are rows of
    one table, so one join and one aggregation correlate the pairs under each; number 0 leaves the names as they are.
    """
    names = near.select(F.col("a").alias("station")).union(near.select("b")).distinct()
    numbers = names.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    said = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("turn").cast("string"), "station").cast("binary"))
    place = lambda *order: F.row_number().over(Window.partitionBy("turn").orderBy(*order))
    old = numbers.select("turn", "station", place("station").alias("k"))
    new = numbers.select("turn", F.col("station").alias("other"), place(F.when(F.col("turn") == 0, "").otherwise(said), "station").alias("k"))
    renamed = old.join(new, ["turn", "k"])
    ends = {c: renamed.select("turn", F.col("station").alias(c), F.col("other").alias(f"new_{c}")) for c in "ab"}
    both_ways = far.select(F.col("a").alias("new_a"), F.col("b").alias("new_b"), F.col("distance").alias("far")).union(far.select("b", "a", "distance"))
    pairs = near.join(ends["a"], "a").join(ends["b"], ["turn", "b"]).join(both_ways, ["new_a", "new_b"])
    each = pairs.groupBy("turn").agg(correlation("distance", "far").alias("c"))
    seen = each.agg(F.max(F.when(F.col("turn") == 0, F.col("c"))).alias("r"), F.collect_list("c").alias("all"))  # a number a renaming
    return seen.select("r", (F.size(F.filter("all", lambda c: c >= F.col("r") - 1e-12)) / F.lit(permutations + 1.0)).alias("p"))


def two_validations(near: DataFrame, far: DataFrame, buffer: float = 5.0, floor: float = 3.0, relax: float = 0.6) -> DataFrame:
    """``test, validation, rank`` of the two stations nearest in surroundings (``near``: a, b, distance) and at least
    ``buffer`` km away (``far``: a, b, km); where fewer than two are, from ``max(floor, relax * buffer)`` km on."""
    both = near.join(far, ["a", "b"]).select("a", "b", "distance", "km")
    sides = both.select(F.col("a").alias("test"), F.col("b").alias("validation"), "distance", "km").union(both.select("b", "a", "distance", "km"))
    counted = sides.withColumn("_n", F.sum((F.col("km") >= buffer).cast("int")).over(Window.partitionBy("test")))
    bound = F.when(F.col("_n") >= 2, buffer).otherwise(max(floor, relax * buffer))
    ranked = counted.where(F.col("km") >= bound).withColumn("rank", F.row_number().over(Window.partitionBy("test").orderBy("distance", "validation")))
    return ranked.where("rank <= 2").select("test", "validation", "rank")


def k_centres(near: DataFrame, far: DataFrame, k: int, first: str, buffer: float = 5.0, relax: float = 0.8) -> list[str]:
    """Farthest-first centres in surroundings, kept ``buffer`` km apart; the buffer shrinks by ``relax`` where none is left."""
    rows = near.join(far, ["a", "b"]).collect()  # one row a pair of stations
    env, km = {}, {}
    for r in rows:
        for a, b in ((r["a"], r["b"]), (r["b"], r["a"])):
            env[a, b], km[a, b] = r["distance"], r["km"]
    names = sorted({a for a, _ in env})
    chosen = [first]
    while len(chosen) < min(k, len(names)):
        apart = buffer
        rest = [n for n in names if n not in chosen]
        while not (open_ := [n for n in rest if all(km[n, c] >= apart for c in chosen)]):
            apart *= relax
            if apart < 1e-6:
                open_ = rest
                break
        chosen.append(max(open_, key=lambda n: (min(env[n, c] for c in chosen), n)))
    return chosen


#: Stations whose distances ``core_centres`` takes at a time.
BLOCK = 4096


def farthest_first(names: list, vectors: np.ndarray, places: np.ndarray, k: int, first: int, buffer: float, relax: float = 0.8) -> list[int]:
    """Rows of ``k`` centres from row ``first`` on: each time the row furthest from all so far (the greater name of ties) among those ``buffer``
    away from them in place; the buffer shrinks by ``relax`` where there is none."""
    order = np.argsort(np.array(names, dtype=object), kind="stable")
    by_name = np.empty(len(names), np.int64)
    by_name[order] = np.arange(len(names))
    chosen = [first]
    near = np.linalg.norm(vectors - vectors[first], axis=1)
    apart = np.linalg.norm(places - places[first], axis=1)
    while len(chosen) < min(k, len(names)):
        left = np.ones(len(names), bool)
        left[chosen] = False
        limit = buffer
        while not (open_ := left & (apart >= limit)).any():
            limit = limit * relax if limit > 1e-6 else -1.0
        rows = np.flatnonzero(open_)
        rows = rows[near[rows] == near[rows].max()]
        best = int(rows[by_name[rows].argmax()])
        chosen.append(best)
        near = np.minimum(near, np.linalg.norm(vectors - vectors[best], axis=1))
        apart = np.minimum(apart, np.linalg.norm(places - places[best], axis=1))
    return chosen


def _away(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row to its nearest centre, component by component, so that equal rows have equal ones in any batch."""
    nearest = np.full(len(rows), np.inf)
    for centre in centres:
        total = np.zeros(len(rows))
        for i, c in enumerate(centre):
            part = (rows[:, i] - c) ** 2
            total += np.where(np.isnan(part), 0.0, part)  # null components don't count
        np.minimum(nearest, total, out=nearest)
    return np.sqrt(nearest)


def core_centres(df: DataFrame, k: int, first: str, buffer: float = 0.0, block: int = BLOCK, key: str = "station", vector: str = "features", place: Sequence[str] = (), relax: float = 0.8) -> DataFrame:
    """``key, turn`` of ``k`` centres, farthest first from ``first`` (where there is none, the least name) on, ``buffer`` apart by ``place`` (columns) as far as that can be.

    Each turn is a pass over all stations, ``block`` of a task at a time, of which a task passes on its furthest one alone (the greater name of
    ties). So the choice is that of ``farthest_first`` over all, whatever the number of tasks, and nothing is held but the centres; the buffer
    shrinks by ``relax`` where none lies outside it, as far as the widest gap that a pass before has found. Names and vectors should be unique and
    equally long; null vectors are left out.
    """
    held = df.select(key, F.col(vector), *place).where(F.col(vector).isNotNull())
    spark = df.sparkSession
    kind = held.schema[key].dataType
    apart = bool(place) and buffer > 0

    def furthest(chosen: list, centres: np.ndarray, sites: np.ndarray, limit: float) -> tuple | None:
        """The furthest row outside of the limit; with a limit of minus one, that of the widest gap in place."""
        taken = set(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                for start in range(0, batch.num_rows, block):
                    part = batch.slice(start, block)
                    names = part.column(0).to_pylist()
                    open_ = np.array([n not in taken for n in names], bool)
                    gap = np.zeros(len(names))
                    if apart:
                        gap = _away(np.array([part.column(2 + c).to_numpy(zero_copy_only=False) for c in range(len(place))], np.float64).T, sites)
                        open_ &= gap >= limit
                    rows = np.flatnonzero(open_)
                    if not len(rows):
                        continue
                    score = gap if limit < 0 and apart else _away(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1), centres)
                    top = score[rows].max()
                    found = (float(top), max(names[r] for r in rows[score[rows] == top]))
                    best = found if best is None else max(best, found)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], part.schema.field(0).type)], ["d", key])

        found = held.mapInArrow(run, f"d double, `{key}` {kind.simpleString()}").orderBy(F.desc("d"), F.desc(key)).first()
        return None if found is None else tuple(found)

    def row_of(name) -> tuple | None:
        return held.where(F.col(key) == F.lit(name)).first()

    start = row_of(first)
    if start is None:
        least = held.agg(F.min_by(key, F.col(key).cast("string"))).first()[0]
        start = None if least is None else row_of(least)
    chosen, centres, sites = [], [], []
    while start is not None:
        chosen.append(start[key])
        centres.append(start[vector])
        sites.append([start[c] for c in place])
        if len(chosen) >= k:
            break
        limit, asked = (buffer if apart else 0.0), (chosen, np.array(centres, np.float64), np.array(sites, np.float64))
        found = furthest(*asked, limit)
        if found is None and apart:
            gap = furthest(*asked, -1.0)
            while gap is not None and limit > gap[0]:
                limit = limit * relax if limit > 1e-6 else 0.0
            found = None if gap is None else furthest(*asked, limit)
        start = None if found is None else row_of(found[1])
    return spark.createDataFrame(list(zip(chosen, range(len(chosen)))), f"`{key}` {kind.simpleString()}, turn int")


def centre_radius(df: DataFrame, centres: DataFrame, key: str = "station", vector: str = "features") -> DataFrame:
    """One row ``r_max, r_95``: distance of stations to their nearest centre; ``centres`` is a few rows, which are broadcast."""
    held = [np.array(r[vector], np.float64) for r in df.join(F.broadcast(centres.select(key)), key).select(vector).collect()]  # k rows
    shared = df.sparkSession.sparkContext.broadcast(np.array(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch.column(0).to_pylist(), np.float64)
            d = np.min([np.linalg.norm(vectors - c, axis=1) for c in shared.value], axis=0) if len(vectors) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(d)], ["d"])

    away = df.where(F.col(vector).isNotNull()).join(F.broadcast(centres.select(key)), key, "left_anti").select(vector).mapInArrow(run, "d double")
    return away.agg(F.max("d").alias("r_max"), F.percentile("d", F.lit(0.95)).alias("r_95"))


def coverage(near: DataFrame, chosen: list[str]) -> DataFrame:
    """One row ``r_max, r_95``: distance of stations to their nearest centre."""
    sides = near.select(F.col("a").alias("s"), F.col("b").alias("c"), "distance").union(near.select("b", "a", "distance"))
    nearest = sides.where(F.col("c").isin(chosen) & ~F.col("s").isin(chosen)).groupBy("s").agg(F.min("distance").alias("d"))
    return nearest.agg(F.max("d").alias("r_max"), F.percentile("d", F.lit(0.95)).alias("r_95"))


def prototypes(df: DataFrame, key: str = "station", vector: str = "features") -> DataFrame:
    """One row ``station, total``: the station of least total distance to all."""
    pairs = vector_distances(df, key, vector)
    sides = pairs.select(F.col("a").alias(key), "distance").union(pairs.select("b", "distance"))
    return sides.groupBy(key).agg(F.sum("distance").alias("total")).orderBy("total", key).limit(1)
