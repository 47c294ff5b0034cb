"""Document fingerprints by one-permutation MinHash (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .scratch import running, write_table

SHINGLE = 5
#: Bins, a power of two; each keeps four low-order bits, one hex digit of the fingerprint.
BINS = 128
BITS = 4
#: Probes tried before all others are: nearly always enough.
SOON = 6
#: Documents of neighbouring ids that are ordered together, about, and how many at most: blocks of more are cut by rank.
NEIGHBOURS = 128
CROWD = 1024
#: Crowded blocks that are looked up by broadcast.
SOME = 100_000
SEGMENTS = 64


@lru_cache(maxsize=4)
def probe_order(bins: int) -> tuple[tuple[int, ...], ...]:
    """For each bin, the other bins in a fixed random order: where an empty one looks for a value."""
    draw = lambda i, j: hashlib.blake2b(f"{i}:{j}".encode(), digest_size=8).digest()
    return tuple(tuple(sorted((j for j in range(bins) if j != i), key=lambda j: draw(i, j))) for i in range(bins))


def fingerprint(text: Column, shingle: int = SHINGLE, bins: int = BINS) -> Column:
    """Packed fingerprint of a text, ``bins`` hex digits.

    A-Z are lower-cased and words ``[^\\x20\\x09-\\x0D]+`` hashed; a shingle's hash is that of its words' hashes, in order.
    Its top bits name a bin and each bin keeps its least hash: one sort of the hashes, with a greatest possible
    value added for each bin, leaves the first of every bin, and the added value marks an empty one. An empty bin takes
    the value of the first filled bin in its own random order, which is the same for all texts (optimal
    densification). Fewer words than a shingle: they are the one shingle; none, or null: all digits 0.
    """
    shift = 64 - (bins.bit_length() - 1)
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(F.regexp_replace(lowered, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    full = F.lit((1 << shift) - 1)
    ends = F.from_json(F.lit(json.dumps([((k << shift) | ((1 << shift) - 1)) - (1 << 64 if k >= bins // 2 else 0) for k in range(bins)])), "array<bigint>")
    places = [[(j + bins // 2) % bins for j in row] for row in _signed(probe_order(bins))]
    constant = lambda rows: F.from_json(F.lit(json.dumps(rows)), "array<array<int>>")  # noqa: E731  folded once
    soon, late = constant([row[:SOON] for row in places]), constant([row[SOON:] for row in places])

    def grams(h: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(1), F.size(h) - shingle + 1), lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(shingle))))
        return F.when(F.size(h) < shingle, F.array(F.xxhash64(h))).otherwise(rolled)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, shift) != F.shiftrightunsigned(F.get(s, i - 1), shift)))

    empty = lambda x: x.bitwiseAND(full) == full

    def fill(slots: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            value = lambda probes: F.get(F.filter(F.transform(F.get(probes, i), lambda p: F.get(slots, p)), lambda y: ~empty(y)), F.lit(0))
            return F.when(empty(x), F.coalesce(value(soon), value(late))).otherwise(x)

        return F.transform(slots, one)

    digit = lambda x: F.substring(F.lit("0123456789abcdef"), x.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1))
    packed = F.array_join(F.transform(_let(_let(_let(_let(hashed, grams), lambda g: F.sort_array(F.concat(g, ends))), firsts), fill), digit), "")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, F.lit("0" * bins)).otherwise(packed)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _signed(rows: tuple[tuple[int, ...], ...]) -> list[tuple[int, ...]]:
    """Rows in the order of signed hashes, where the upper half of the bins comes first."""
    half = len(rows) // 2
    return list(rows[half:]) + list(rows[:half])


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1: equal digits, less those equal by chance."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(bins)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half of code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every document.

    The next document is that of the next ``doc_id`` (nulls first; equal ids by a hash of the text), after the last the first. Texts
    move once: blocks of about ``NEIGHBOURS`` neighbouring ids are ordered apart, and only a block's last document
    is joined to the first of the block after. Null texts are empty. One document is its own next. Where null, equal or crowded ids, or
    ids that aren't whole numbers, would make a block of over ``CROWD`` rows, its rows are ranked and cut by rank: they move twice more.
    Other columns don't matter.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _parted(rows.withColumn("_block", _blocks(rows))).withColumn("fingerprint", fingerprint(F.col("text")))
    place = Window.partitionBy("_block", "_part").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    nearby = rows.withColumns({"_next": F.lead("text").over(place), "_next_print": F.lead("fingerprint").over(place), "_first": F.first("text").over(place), "_first_print": F.first("fingerprint").over(place)})
    last = F.col("_next").isNull()
    ready = _compare(nearby).select(
        "doc_id", "n_chars", "fingerprint", *_RESULTS, last.alias("_last"), "_block", "_part",
        *(F.when(last, F.col(c)).alias(c) for c in ("text", "_first", "_first_print")),
    )
    ready = write_table(ready, "neighbours")
    ends = running(ready.where("_last"), [F.col("_block"), F.col("_part")], rank="_k").drop("row_id")
    count = ends.agg(F.count(F.lit(1)).alias("_count"))  # one row
    heads = ends.crossJoin(F.broadcast(count)).select(F.expr("(_k + _count - 1) % _count").alias("_before"), F.col("_first").alias("_next"), F.col("_first_print").alias("_next_print"))
    tails = ends.select("doc_id", "text", "fingerprint", "_k").join(heads, F.col("_k") == F.col("_before"))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return ready.where(~F.col("_last")).select(*columns).union(_compare(tails).select(*columns))


def _parted(rows: DataFrame) -> DataFrame:
    """Adds ``_part``: 0, but for blocks of over ``CROWD`` rows a number that rises with their order and that ``NEIGHBOURS`` rows share."""
    crowded = write_table(rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select("_block"), "crowded")
    found = crowded.count()
    if not found:
        return rows.withColumn("_part", F.lit(0).cast("long"))
    if found <= SOME:
        crowded = F.broadcast(crowded)
    apart = write_table(rows.join(crowded, "_block", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "apart")
    slim = apart.select("_row", "_block", "doc_id", F.xxhash64("text").alias("_hash"))
    ranked = running(slim, [F.col("_block"), F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")], rank="_rank").select("_row", (F.floor(F.col("_rank") / NEIGHBOURS) + 1).alias("_part"))
    others = rows.join(crowded, "_block", "left_anti").withColumn("_part", F.lit(0).cast("long"))
    return others.unionByName(apart.join(ranked, "_row").drop("_row"))


def _blocks(rows: DataFrame) -> Column:
    """A number that rises with ``doc_id`` and is shared by about ``NEIGHBOURS`` documents; nulls: -1. One for all, if ids aren't whole numbers.

    Ids are cut at ``SEGMENTS`` approximate quantiles, and evenly between those, so that gaps and dense stretches do no harm.
    """
    if not isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return F.lit(0).cast("long")
    shares = [k / SEGMENTS for k in range(SEGMENTS + 1)]
    span = rows.agg(F.percentile_approx("doc_id", shares).alias("bounds"), F.count(F.lit(1)).alias("n")).first()
    bounds = span["bounds"] or [0] * (SEGMENTS + 1)
    widths = [max(1, (b - a + 1) * NEIGHBOURS * SEGMENTS // max(1, span["n"])) for a, b in zip(bounds, bounds[1:])]
    held = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    segment = F.size(F.filter(held(bounds[1:-1], "bigint"), lambda b: b <= F.col("doc_id")))
    inside = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.get(held(bounds, "bigint"), segment)) / F.get(held(widths, "decimal(20,0)"), segment))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(segment.cast("long") * (1 << 40) + inside.cast("long"))


_RESULTS = ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")


def _compare(rows: DataFrame) -> DataFrame:
    """From ``text, fingerprint, _next, _next_print``."""
    change = F.when(F.col("_next").isNotNull(), edited(F.col("text"), F.col("_next")))
    rows = rows.withColumn("_edited", change)
    rows = rows.withColumn("edited_fingerprint", F.when(F.col("_edited").isNotNull(), fingerprint(F.col("_edited"))))
    return rows.withColumns(
        {
            "n_chars": F.length("text").cast("long"),
            "edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256),
            "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
            "near_next": likeness(F.col("fingerprint"), F.col("_next_print")),
        }
    )
