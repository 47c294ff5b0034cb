"""Approximate nearest neighbours by collision-counting hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import write_table

K = 20
#: Directions (for wider vectors a quarter of their dimensions), orthogonal to each other as far as there are dimensions.
PROJECTIONS = 64
#: Virtual buckets of a sorted array; windows are made of whole ones.
BUCKETS = 32
#: Half the narrowest window, in mean projected spreads, and how much wider each round's is. The last takes in all.
WINDOW = 0.28
WIDEN = 1.25
ROUNDS = 14
#: Share of the projections in which a vector must lie in the window to be verified.
COLLISIONS = 0.8
#: Vectors that a query verifies in a block, besides K, before windows stop widening: a share of the block, and at least so many.
VERIFIED = 0.03
FLOOR = 512
#: Where that finds less than this share of a sample's neighbours (wide vectors that point everywhere), the block doubles it until it does.
RECALL = 0.94
SAMPLE = 64
#: Vectors of a block, about.
BLOCK = 16384
#: Blocks that a task searches one after another, at most: queries and their best lists move once for all of them.
BLOCKS = 8
#: Queries whose collisions are counted together.
TOGETHER = 16
SEED = 11

_ONES = np.uint64((1 << 64) - 1)


def directions(count: int, width: int, seed: int) -> np.ndarray:
    """``count`` unit directions, orthogonal within each run of ``width``."""
    draw = np.random.default_rng(seed)
    turns = [np.linalg.qr(draw.standard_normal((width, width)))[0] for _ in range(-(-count // width))]
    return np.concatenate(turns, axis=1)[:, :count]


def tally(members: np.ndarray) -> list[np.ndarray]:
    """Binary digits, lowest first, of how many of the bitmaps along the last axis but one hold each place.

    Three bitmaps of one weight become one of that weight and one of the next, until one of each is left.
    """
    planes = []
    while members.shape[-2]:
        carried = []
        while (n := members.shape[-2]) > 1:
            third = n // 3
            if not third:
                a, b = members[..., :1, :], members[..., 1:, :]
                carried.append(a & b)
                members = a ^ b
                continue
            a, b, c = (members[..., k * third : (k + 1) * third, :] for k in range(3))
            odd = a ^ b
            carried.append((a & b) | (c & odd))
            members = np.concatenate([odd ^ c, members[..., 3 * third :, :]], axis=-2)
        planes.append(members[..., 0, :])
        members = np.concatenate(carried, axis=-2) if carried else members[..., :0, :]
    return planes


def reaching(planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Bitmaps of the places whose number is ``least`` (one for each row) or more."""
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], _ONES)
    for k in range(len(planes) - 1, -1, -1):
        wanted = np.where(least >> k & 1, _ONES, np.uint64(0)).astype(np.uint64)[:, None]
        above |= equal & planes[k] & ~wanted
        equal &= ~(planes[k] ^ wanted)
    return above | equal


def ranked(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by score, greatest first and those that aren't numbers last, then id, then row."""
    return np.lexsort((rows, ids, -np.where(np.isnan(scores), -np.inf, scores)))


class CollisionIndex:
    """A sorted array of projections for each direction, over a block of vectors of one length.

    For inner products the vectors get one more coordinate, which gives all of them the block's greatest length, so that the
    nearest by distance has the largest product. Each sorted array is cut into virtual buckets of equally many vectors and
    keeps, for each cut, the bitmap of the vectors before it: the members of any window of whole buckets are the
    difference of two bitmaps, and collisions of all vectors are counted 64 at a time. Equal vectors are indexed once.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, projections: int | None = None, buckets: int = BUCKETS, seed: int = SEED):
        _, first, back = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((rows, ids, back))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(back))])
        self.ids, self.rows = ids[order], rows[order]  # of each distinct vector together, ascending
        self.vectors = vectors[first].astype(np.float64)
        # by the largest component, so that no length overflows; what then vanishes is beside it nothing
        scaled = self.vectors / np.abs(self.vectors).max()
        norms = np.sqrt((scaled**2).sum(axis=1))
        self.length = float(norms.max())
        self.single = scaled.astype(np.float32)
        n, width = scaled.shape
        projections = projections or max(PROJECTIONS, width // 4)
        self.directions = directions(projections, width + 1, seed)
        placed = np.column_stack([scaled, np.sqrt(np.maximum(self.length**2 - norms**2, 0.0))]) @ self.directions
        self.spread = float(placed.std(axis=0).mean()) or self.length
        by_place = np.argsort(placed, axis=0, kind="stable")
        cuts = np.arange(buckets + 1) * n // buckets
        bucket = np.empty((projections, n), np.int32)
        np.put_along_axis(bucket, by_place.T, (np.searchsorted(cuts, np.arange(n), side="right") - 1).astype(np.int32)[None], axis=1)
        self.words = -(-n // 64)
        self.before = np.zeros((projections, buckets + 1, self.words), np.uint64)
        for k in range(1, buckets + 1):
            bits = np.packbits(bucket < k, axis=1, bitorder="little")
            self.before[:, k].view(np.uint8)[:, : bits.shape[1]] = bits
        self.edges = np.take_along_axis(placed, by_place[np.minimum(cuts[:-1], n - 1)], axis=0).T.copy()  # least value of each bucket
        self.needed = math.ceil(COLLISIONS * projections)
        self.first_round = 0
        some = scaled[:: max(1, n // TOGETHER)][:TOGETHER]
        self.enough = min(n, K + 1 + max(FLOOR, math.ceil(VERIFIED * n)))
        self.first_round = int(np.median(self.candidates(some, self.enough)[1]))
        self._widen()

    def _widen(self) -> None:
        """Doubles the number to verify until a sample of the block's own vectors finds ``RECALL`` of its ``K`` nearest among the candidates."""
        n = len(self.vectors)
        rows = np.unique(np.linspace(0, n - 1, SAMPLE).astype(np.int64))
        products = self.single[rows] @ self.single.T
        best = np.argpartition(-products, min(K, n - 1), axis=1)[:, : min(K + 1, n)]
        while self.enough < n:
            rounds, hits = [], 0
            for begin in range(0, len(rows), TOGETHER):
                part = slice(begin, begin + TOGETHER)
                found, turn = self.candidates(self.single[rows[part]].astype(np.float64), self.enough)
                chosen = np.unpackbits(found.view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
                hits += np.take_along_axis(chosen, best[part], axis=1).sum()
                rounds += turn.tolist()
            self.first_round = int(np.median(rounds))
            if hits >= RECALL * best.size:
                return
            self.enough, self.first_round = min(n, 2 * self.enough), 0

    def candidates(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the vectors to verify for each query, and the round that found ``enough`` of them.

        Windows centred on the query's projections hold whole buckets; each round widens them, until enough vectors collide
        in ``COLLISIONS`` of the projections. Where more do, the number of collisions asked for rises while enough are left.
        There are ``ROUNDS`` rounds at most, the last of which takes in all.
        """
        lengths = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        centre = queries / lengths * self.length @ self.directions[:-1]  # only the direction matters
        projections, buckets = len(self.edges), self.edges.shape[1]
        found = np.zeros((len(queries), self.words), np.uint64)
        rounds = np.zeros(len(queries), np.int64)
        open_ = np.arange(len(queries))
        for turn in range(self.first_round, ROUNDS):
            half = WINDOW * WIDEN**turn * self.spread if turn < ROUNDS - 1 else np.inf
            low, high = np.empty((2, len(open_), projections), np.int64)
            for p in range(projections):
                low[:, p] = np.searchsorted(self.edges[p], centre[open_, p] - half, side="right") - 1
                high[:, p] = np.searchsorted(self.edges[p], centre[open_, p] + half, side="right")
            each = np.arange(projections)
            planes = tally(self.before[each, high.clip(0, buckets)] ^ self.before[each, low.clip(0, buckets)])
            least, most = np.full(len(open_), self.needed), np.full(len(open_), projections + 1)
            held = np.bitwise_count(reaching(planes, least)).sum(axis=1)
            done = held >= enough
            while (apart := most - least > 1).any():  # the greatest number of collisions that enough vectors reach
                middle = np.where(apart, (least + most) // 2, least)
                fits = np.bitwise_count(reaching(planes, middle)).sum(axis=1) >= enough
                least, most = np.where(apart & fits, middle, least), np.where(apart & ~fits, middle, most)
            found[open_[done]] = reaching(planes, least)[done]
            rounds[open_] = turn
            open_ = open_[~done]
            if not len(open_):
                break
        return found, rounds

    def search(self, queries: np.ndarray, own: np.ndarray, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query, up to ``k`` ids of rows other than ``own``, those rows and their scores, by score, then id, then row."""
        n = len(self.vectors)
        enough = min(n, max(self.enough, k + 1 + FLOOR))
        for begin in range(0, len(queries), TOGETHER):
            part = queries[begin : begin + TOGETHER].astype(np.float64)
            scaled = part / np.abs(part).max(axis=1, keepdims=True)
            bitmaps, _ = self.candidates(scaled, enough)
            chosen = np.unpackbits(bitmaps.view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
            for i, query in enumerate(part):
                found = np.flatnonzero(chosen[i])
                # a fast product picks those that can be among the best; the exact one, summed left to right, ranks them
                rough = self.single.take(found, axis=0) @ scaled[i].astype(np.float32)
                place = len(found) - min(len(found), k + 1)
                slack = 1e-5 * self.length * max(1.0, float(np.abs(scaled[i]).sum()))
                found = found[rough >= np.partition(rough, place)[place] - slack]
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = np.cumsum(self.vectors[found] * query, axis=1)[:, -1]
                # of equal vectors only the first rows can be among the first k, besides the query's own
                size = np.minimum(self.starts[found + 1] - self.starts[found], k + 1)
                at = np.repeat(self.starts[found] - np.cumsum(size) + size, size) + np.arange(size.sum())
                ids, rows, scores = self.ids[at], self.rows[at], np.repeat(exact, size)
                other = rows != own[begin + i]
                ids, rows, scores = ids[other], rows[other], scores[other]
                rank = ranked(ids, rows, scores)[:k]
                yield ids[rank], rows[rank], scores[rank]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part.

    Out stay vectors that are null, zero, or hold null or non-finite components, and rows without a key.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = vectors.schema[vector].dataType.elementType.typeName()
    held = "array<float>" if kind == "float" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(held).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.where(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = K, every: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, seed: int = SEED, blocks: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose key is divisible by ``every``, the ``k`` other rows of largest product.

    Rows are dealt by a hash into blocks of about ``block`` vectors of one length. A task builds the indexes of up to ``blocks`` blocks (as many
    as leave each core two tasks, ``BLOCKS`` at most) and reads the queries after them, as they stream in; only queries move to more than one
    task, and a task's memory depends on ``block`` and ``BLOCKS`` alone. A query's ``k`` best of a task's blocks, then those of all tasks, are
    ranked; the rows found don't depend on ``blocks``. Scores are summed in double precision over the original
    components, in order; one that overflows both ways is not a number and comes last. Ties go to the smaller key.

    Vectors are compared with those of their own length. Rows of equal key are rows of their own: each is searched for, and found by the
    others. In blocks of ``FLOOR`` + k vectors or fewer the search is exact. A block finds out on a sample of its own how many vectors a query
    must verify for a recall of about ``RECALL``: 3 % at 64 components, most of the block where hundreds of components point everywhere. No usable rows: no output rows.
    """
    small_batches(vectors.sparkSession)
    rows = write_table(usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows = rows.withColumn("length", F.size("vector"))
    sizes = rows.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    together = F.lit(blocks) if blocks else F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.col("blocks") / tasks)))
    sizes = sizes.withColumn("together", together.cast("int")).withColumn("groups", F.ceil(F.col("blocks") / F.col("together")).cast("int"))
    rows = rows.join(F.broadcast(sizes), "length")  # a row for each length of vectors
    data = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "vec_id", "row"), F.col("blocks")).cast("int")).withColumn("group", F.floor(F.col("block") / F.col("together")).cast("int")).withColumn("asked", F.lit(False))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.lit(0)).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("asked", F.lit(True))
    columns = ["length", "group", "asked", "block", "vec_id", "row", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: of each length and group first the vectors, block by block, then the queries."""
        last, indexes, held, of_block = None, [], [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else np.zeros(1, np.int64)
            out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                ids, numbers = part.column(4).to_numpy(), part.column(5).to_numpy()
                matrix = part.column(6).flatten().to_numpy().reshape(len(ids), -1)
                if (group := tuple(keys[a, :2])) != last:
                    last, indexes, held = group, [], []
                if held and (keys[a, 2] or keys[a, 3] != of_block):
                    indexes.append(CollisionIndex(*map(np.concatenate, zip(*held)), seed=seed))
                    held = []
                if not keys[a, 2]:
                    held.append((ids, numbers, matrix))
                    of_block = keys[a, 3]
                    continue
                if not indexes:  # no vector fell into these blocks
                    continue
                for own, number, *found in zip(ids, numbers, *(index.search(matrix, numbers, k) for index in indexes)):
                    best = found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))
                    best = tuple(x[ranked(*best)[:k]] for x in best)
                    out.append((np.full(len(best[0]), own), np.full(len(best[0]), number), *best))
            names = ["query_id", "query_row", "vec_id", "row", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

    dealt = data.select(columns).union(asked.select(columns)).repartition("length", "group").sortWithinPartitions("length", "group", "asked", "block", "vec_id")
    met = dealt.mapInArrow(tidy(run), "query_id bigint, query_row bigint, vec_id bigint, row bigint, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")).desc(), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
