"""Near-duplicates by Jaccard similarity of word shingles: banded MinHash proposes, exact sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .components import components
from .scratch import T, write_table

SEED = 42
SHINGLE = 5
#: Texts are linked from a similarity of LEAST[0] / LEAST[1] on.
LEAST = (4, 5)
#: Texts that agree in all ROWS minima of one of BANDS bands are compared: a pair at 0.8 stays unseen with chance
#: (1 - 0.8**6)**32 = 6e-5, one at 0.9 with 5e-11.
BANDS = 32
ROWS = 6
#: Texts of a candidate group that meet in one task at a time.
PART = 128
#: Parts of a group in the second round, in which each part meets each: no row is repeated more often than this.
PARTS = 32
#: So many marks of texts are looked up by broadcast (16 MB); more by a shuffle.
SOME = 1_000_000
#: Shingles hashed at a time, so that a very long text takes no more memory than this many.
TALLY = 1 << 16
#: Shingles whose BANDS * ROWS hashes are held at a time.
CHUNK = 1 << 10
_draws = np.random.default_rng(SEED)
_FACTORS = _draws.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MASKS = _draws.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, in order, of each ``shingle`` words; of all words where there are fewer, none if there is no word."""
    words = text.lower().split()  # both ASCII only
    if not words:
        return np.empty(0, np.uint64)
    digest, parts = xxhash.xxh64_intdigest, []
    for start in range(0, max(1, len(words) - shingle + 1), TALLY):
        part = words[start : start + TALLY + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        parts.append(np.unique(np.array([digest(g, SEED) for g in grams], np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def bands(grams: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), CHUNK):
        np.minimum(least, ((grams[start : start + CHUNK] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _of_texts(texts: DataFrame, each, name: str) -> DataFrame:
    """``texts`` without its last column, the text, but with ``each(shingles)`` as ``name``."""
    *others, text = texts.columns
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [each(shingles(t.as_buffer().to_pybytes())) for t in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(made)], [*others, name])

    return texts.mapInArrow(tidy(run), ", ".join([*(f"`{c}` bigint" for c in others), f"{name} array<bigint>"]))


def text_id(text: str) -> Column:
    """64 bits of the text; 0 for null, empty and blank ones, which are copies of each other."""
    return F.when(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.xxhash64(text)).otherwise(0)


def forest(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of similarity LEAST or more connect."""
    sizes = np.array(list(map(len, sets)))
    starts = np.cumsum(sizes) - sizes
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, starts[1:])
    held, group, edges = np.zeros(len(values), bool), np.arange(len(sets)), []
    num, den = LEAST
    for i in range(len(sets) - 1):
        others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        others = others[den * np.minimum(sizes[others], sizes[i]) >= num * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        held[own[i]] = True
        if len(others) > 8:
            shared = np.add.reduceat(held[codes], starts, dtype=np.int64)[others]
        else:
            shared = np.array([np.count_nonzero(held[own[j]]) for j in others])
        held[own[i]] = False
        for j in others[den * shared >= num * (sizes[others] + sizes[i] - shared)]:
            if group[j] != group[i]:
                edges.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return edges


def _few(marks: DataFrame) -> DataFrame:
    """``marks``, a written table of longs, for a broadcast if it has ``SOME`` rows at most."""
    return F.broadcast(marks) if marks.count() <= SOME else marks


def _edges(rows: DataFrame) -> DataFrame:
    """``a, b``: ``forest`` of each ``component, p, q`` of ``rows``, which hold ``id, grams`` besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a group may lie in several batches."""
        last, ids, sets = None, [], []

        def emit() -> pa.RecordBatch:
            pairs = np.array(forest(np.array(ids), sets) if len(ids) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for k, (key, i) in enumerate(zip(keys, batch.column(3).to_pylist())):
                if key != last:
                    if ids:
                        yield emit()
                    last, ids, sets = key, [], []
                ids.append(i)
                sets.append(batch.column(4)[k].values.to_numpy().copy())
        if ids:
            yield emit()

    group = ["component", "p", "q"]
    return rows.select(*group, "id", "grams").repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", part: int = PART) -> DataFrame:
    """``id, component`` of the texts (by ``text_id``) that a chain of links of similarity LEAST connects to another.

    Texts that share a band form candidate groups; a pair is linked only by its exact similarity. In the first
    round the texts of a group meet in parts of ``part``, each with the group's least text, so that a
    large group of true copies is connected in one pass over it. Groups of several parts that aren't one component then
    have each two of their parts meet: no pair that shares a band, or is joined by such pairs, stays uncompared.
    """
    texts = docs.select(text_id(text).alias("id"), F.col(text).alias("text")).where("id != 0")
    prints = write_table(_of_texts(texts, bands, "bands").dropDuplicates(["id"]), "bands")
    posted = prints.select("id", F.posexplode("bands").alias("band", "key"))
    stars = posted.groupBy("band", "key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    # merged: Spark takes BANDS rows a text for no larger than the text's own, and would broadcast them
    near = posted.hint("merge").join(stars, ["band", "key"]).select("id", "least")
    candidates = write_table(components(near, "id", "least"), "candidates")
    sizes = candidates.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    wanted = texts.join(_few(candidates).withColumnRenamed("node", "id"), "id").dropDuplicates(["id"]).select("id", "component", "text")
    sets = write_table(_of_texts(wanted, lambda grams: grams.view(np.int64), "grams"), "sets")

    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    everywhere = F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    first = sets.join(sizes, "component").withColumn("p", F.explode(everywhere)).withColumn("q", F.col("p"))
    linked = write_table(_edges(first), "links")

    found = components(linked).withColumnRenamed("component", "own")
    state = candidates.join(found, "node", "left").withColumn("own", F.coalesce("own", "node"))
    open_ = state.groupBy("component").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    open_ = write_table(open_.where("low < high and parts > 1").select("component", F.least("parts", F.lit(PARTS)).cast("int").alias("parts")), "open")
    if open_.isEmpty():
        return found.select(F.col("node").alias("id"), F.col("own").alias("component"))
    met = sets.join(open_, "component").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("mine != other")
    second = met.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")})
    return components(linked.union(write_table(_edges(second), "links"))).withColumnRenamed("node", "id")


def drop_near_duplicates(docs: DataFrame, part: int = PART, links: DataFrame | None = None) -> DataFrame:
    """One row of each component, that with the least ``doc_id`` (of equal ones, with one and the same text).

    ``links`` (``a, b``, by ``text_id``) are edges that another method has found; components are those of both methods' edges together.
    What goes is found by ``doc_id`` and text mark and anti-joined, so that texts move only where more than ``SOME`` go.
    Rows are dropped by their text's component, never by their ``doc_id`` alone. Rows without a ``doc_id`` can't be
    named as copies and stay.
    """
    own = [f"{T}{c}" for c in ("id", "component", "doc")]
    found = near_duplicates(docs.where("doc_id is not null").select("text"), part=part).toDF(*own[:2])
    if links is not None:
        found = components(write_table(found.union(links), "both"), *own[:2]).toDF(*own[:2])
    named = docs.where("doc_id is not null").withColumn(own[0], text_id("text"))
    classes = named.groupBy("doc_id", own[0]).agg(F.count(F.lit(1)).alias("n")).join(found, own[0], "left").withColumn(own[1], F.coalesce(own[1], own[0]))
    classes = write_table(classes, "classes")
    kept = classes.groupBy(own[1]).agg(F.min(F.struct("doc_id", own[0])).alias("least")).select(F.col("least.doc_id").alias(own[2]), F.col(f"least.{own[0]}").alias(f"{T}text"))
    same = (F.col("doc_id") == F.col(own[2])) & (F.col(own[0]) == F.col(f"{T}text"))
    gone = classes.join(kept, same, "left_anti").select(F.col("doc_id").alias(own[2]), F.col(own[0]).alias(f"{T}text"))
    rows = named.join(_few(write_table(gone, "gone")), same, "left_anti")
    again = write_table(classes.where("n > 1").join(kept, same, "left_semi").select(F.col("doc_id").alias(own[2]), F.col(own[0]).alias(f"{T}text")), "again")
    if not again.isEmpty():  # rows kept that are repeated
        again = _few(again)
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", own[0]]))
    return rows.select(*docs.columns).unionByName(docs.where("doc_id is null"))
