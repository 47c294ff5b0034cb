"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import T, join_groups, running, write_table
from .sharding import shuffle_key

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = 29
#: Marks of repeated rows that are looked up by broadcast.
SOME = 100_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """``source, source_size, weight, target, budget`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share`` of all sizes; a target
    stops at ``epochs`` times its source's size and the excess is reshared by weight until none is above. That
    fixed point is a level: with sources sorted by cap / weight, those before some place are full and the
    others stand at one common amount a unit of weight, which two running sums find without a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"), (epochs * F.col("source_size")).cast("double").alias("_cap"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("_open"),
    )
    rows = rows.withColumn("_level", (F.col("budget") - F.col("_full")) / F.col("_open"))
    # the first source, by cap, that the level leaves below its cap; where none is, all are full
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("weight")).alias("at"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap"))))
    return rows.select("source", "source_size", "weight", target.alias("target"), "budget")


def fair_queue(rows: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, seed: int = SEED, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``source_size, target, copies, taken`` to ``doc_id, source, size`` (and whatever else is there).

    A source's documents are shuffled by a seeded hash and queue ``epochs`` times over. A copy's virtual finish time
    is the source's words up to its end, divided by the source's weight. All copies are range-sorted by that time
    and cut where their words reach the budget; ``copies`` of a document lie before the cut and bring
    ``taken`` words. A source that runs out of copies leaves its share to the others, by weight.

    Rows of size 0 (null or blank texts) are never taken. Null sources are one source. Equal ``doc_id`` are told
    apart by size and ``ties``. No rows: no output rows. Columns of the outputs' names, ``weight`` and ``budget`` are replaced or dropped.
    """
    kept = [c for c in rows.columns if c not in ("source_size", "target", "copies", "taken", "weight", "budget")]
    rows = rows.select(*kept)
    order = [F.col("source").asc_nulls_last(), F.col(f"{T}shuffle"), F.col("doc_id"), F.col("size"), *map(F.col, ties)]
    queue = running(rows.withColumn(f"{T}shuffle", shuffle_key(seed, "doc_id")), order, {f"{T}before": "size"}, rank=f"{T}rank", row_id=f"{T}id")
    queue = write_table(queue, "queue")
    per_source = write_table(queue.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(f"{T}before").alias(f"{T}start"), F.count(F.lit(1)).alias(f"{T}n")), "per-source")
    targets = source_targets(per_source.select("source", "source_size"), weights, epochs, share)
    starts = per_source.select(F.col("source").alias(f"{T}s"), f"{T}start", f"{T}n")
    sources = targets.join(starts, F.col("source").eqNullSafe(F.col(f"{T}s"))).drop(f"{T}s").withColumnRenamed("source", f"{T}source")
    queue = join_groups(queue, sources, {"source": f"{T}source"}, f"{T}n")
    upto = F.col(f"{T}before") - F.col(f"{T}start") + F.col("size")
    copies = queue.where(F.col("size") > 0).select(F.col(f"{T}id").alias(f"{T}row"), "size", f"{T}rank", "budget", F.explode(F.array([(upto + e * F.col("source_size")) / F.col("weight") for e in range(epochs)])).alias(f"{T}finish"))
    served = running(copies, [F.col(f"{T}finish"), F.col(f"{T}rank")], {f"{T}served": "size"}, rank=f"{T}turn", row_id=f"{T}turn_id")
    served = served.where(F.col(f"{T}served") + F.col("size") <= F.col("budget"))
    taken = served.groupBy(f"{T}row").agg(F.count(F.lit(1)).alias(f"{T}copies"))
    out = queue.join(taken, F.col(f"{T}id") == F.col(f"{T}row"), "left").withColumn("copies", F.coalesce(f"{T}copies", F.lit(0)))
    return out.select(*kept, "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document; ``size`` counts words."""
    rows = write_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return fair_queue(rows, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``; copies follow each other.

    Only marks (64 bits of key, source and text), sources and sizes are sorted; whole texts move once, by mark, so that
    rows of one ``doc_id`` (or without) are rows like any other. Rows that share a mark are numbered and written, and
    matched by number: a repeated row is weighed once a row, and no group of them meets.
    """
    mark, number = f"{T}mark", f"{T}number"
    marked = docs.withColumn(mark, F.xxhash64("doc_id", "source", "text"))
    slim = write_table(marked.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark, F.lit(None).cast("long").alias(number)), "sizes")
    repeated = write_table(slim.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(mark), "repeated")
    found = repeated.count()
    numbered = None
    if found:
        repeated = F.broadcast(repeated) if found <= SOME else repeated
        numbered = write_table(marked.join(repeated, mark, "left_semi").withColumn(number, F.monotonically_increasing_id()), "numbered")
        again = numbered.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark, number)
        slim = slim.join(repeated, mark, "left_anti").select(again.columns).union(again)
    mixed = fair_queue(slim, ties=[mark, number], **options).where(F.col("copies") > 0).select(mark, number, F.col("copies").cast("int").alias(f"{T}copies"))
    both = marked.join(mixed.where(F.col(number).isNull()).drop(number), mark)
    if numbered is not None:
        both = both.unionByName(numbered.join(mixed.drop(mark), number).drop(number))
    return both.withColumn(f"{T}copy", F.explode(F.sequence(F.lit(1), F.col(f"{T}copies")))).select(*docs.columns)
