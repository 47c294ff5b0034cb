"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .components import components
from .scratch import T, join_groups, write_table

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Bytes that a posting's key holds. Fingerprints within DISTANCE bits share at least 8 - DISTANCE bytes, so of
#: any ``8 - (8 - DISTANCE - KEY_BYTES)`` positions they share at least KEY_BYTES: a posting for each choice of so
#: many among those positions misses no pair.
KEY_BYTES = 4
#: Fingerprints of a posting that meet in one task at a time; greater postings are dealt in pairs of such parts.
PART = 1024
#: Shingles tallied at a time, so that a very long text takes no more memory than this many.
TALLY = 1 << 16


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; no words: 0."""
    if text is None:
        return 0
    words = (text.encode() if isinstance(text, str) else text).lower().split()  # both ASCII only, as bytes
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, TALLY):
        part = words[start : min(count, start + TALLY) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, bits`` (the fingerprint as a signed long), a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], [key, "bits"])

    return docs.select(key, F.col(text)).mapInArrow(tidy(run), f"`{key}` {key_type}, bits bigint")


def _forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges that connect whatever links connect among ``left``, or between ``left`` and ``right``.

    Tallies, for each fingerprint against all others, the positional bytes they share, keeps those that share at
    least ``8 - distance``, and verifies those bit by bit.
    """
    other = left if right is None else right
    bytes_of = other.view(np.uint8).reshape(-1, 8)
    parent = np.arange(len(left) + (0 if right is None else len(right)))
    shift = 0 if right is None else len(left)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i, x in enumerate(left):
        own = left[i : i + 1].view(np.uint8)
        first = i + 1 if right is None else 0
        shared = (bytes_of[first:] == own).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - distance) + first
        near = near[np.bitwise_count(other[near] ^ x) <= distance]
        for j in near.tolist():
            a, b = root(i), root(j + shift)
            if a != b:
                parent[b] = a
                edges.append((int(x), int(other[j])))
    return edges


def links(prints: DataFrame, distance: int = DISTANCE, key_bytes: int = KEY_BYTES, part: int = PART) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (column ``bits``) that connect all that links connect.

    A posting lists the fingerprints that hold the same bytes at the same ``key_bytes`` positions. Postings are
    parted by a hash of the fingerprint once they exceed ``part`` rows, and every pair of parts meets in a
    task of its own, so a posting of any size needs memory for two parts only, and yields at most as many edges as
    it has rows a task. Fingerprints that share whole texts were folded to one row before.
    """
    same = 8 - distance
    if not 0 < key_bytes <= same:
        raise ValueError(f"key_bytes must be 1 to {same}")
    among = 8 - (same - key_bytes)
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(among), key_bytes)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    table = F.array(*(F.struct(F.lit(k).alias("which"), F.lit(signed(m)).alias("mask")) for k, m in enumerate(masks)))
    posted = prints.select("bits", F.explode(table).alias("m")).select("bits", F.col("m.which").alias("which"), F.col("bits").bitwiseAND(F.col("m.mask")).alias("key"))
    # the sizes of postings with company; the others have no pair
    sizes = posted.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("which", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    # merged: Spark takes postings for no larger than the fingerprints before the explode, and would broadcast them
    posted = posted.hint("merge").join(sizes, ["which", "key"])
    mine = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("bits"), F.col("parts"))).otherwise(0).cast("int")
    posted = posted.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    posted = posted.select("which", "key", F.least("mine", "theirs").alias("p"), F.greatest("mine", "theirs").alias("q"), "bits", "mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (which, key, p, q); a group may lie in several batches."""
        kept: list[np.ndarray] = []
        last = None

        def done(rows: np.ndarray) -> list[tuple[int, int]]:
            p, q = int(rows[0, 2]), int(rows[0, 3])
            bits = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
            if p == q:
                return _forest(bits, None, distance)
            first = rows[:, 5] == p
            return _forest(bits[first], bits[~first], distance)

        def emit(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            edges: list[tuple[int, int]] = []
            groups = np.split(rows, starts[1:])
            if last is not None and (groups[0][0, :4] == last).all():
                kept.append(groups.pop(0))
            if groups:
                if kept:
                    edges += done(np.concatenate(kept))
                for group in groups[:-1]:
                    if len(group) > 1:
                        edges += done(group)
                kept, last = [groups[-1].copy()], groups[-1][0, :4].copy()
            yield emit(edges)
        if kept:
            yield emit(done(np.concatenate(kept)))

    group = ["which", "key", "p", "q"]
    return posted.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``key, bits, component_id`` for every row of ``docs``.

    Texts whose fingerprints differ by at most ``distance`` bits are linked; ``component_id`` is the least key
    reachable. Equal fingerprints are folded to one row before pairs are sought. Null, empty and blank
    texts have fingerprint 0 and are linked like any other. Rows without a key take the component of their text
    but never name one (null if none in it has a key). Repeated rows give repeated results.
    """
    prints = write_table(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = write_table(prints.groupBy("bits").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct")
    found = components(links(distinct, distance))
    classes = distinct.join(found.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = classes.groupBy("component").agg(F.min("_least").alias("component_id"))
    of_print = classes.select("bits", "component", "_n").join(least, "component").select(F.col("bits").alias("_bits"), "component_id", "_n")
    return join_groups(prints, of_print, {"bits": "_bits"}, "_n")


def key_links(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``a, b``: edges between the keys of ``docs`` that connect whatever near fingerprints connect."""
    found = near_duplicates(docs, key, text)
    return found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("a"), F.col("component_id").alias("b")).distinct()


def duplicate_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that with the least ``doc_id``, of equal ones the first read.

    Rows go by their text's component, never by ``doc_id`` alone. Rows without a ``doc_id`` can't be named as copies and stay.
    """
    number = f"{T}number"
    numbered = write_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.where("doc_id is not null"), number, shingle=shingle, distance=distance)
    named = found.join(numbered.select(number, "doc_id"), number)
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", number)).alias("least")).select(F.col(f"least.{number}").alias(number))
    return numbered.join(kept.union(numbered.where("doc_id is null").select(number)), number, "left_semi").select(*docs.columns)
