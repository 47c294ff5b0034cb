"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import T, join_groups, running, write_table

SHARDS = 24
SEED = 17
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 8


def shuffle_key(seed: int, key: str | Column) -> Column:
    """Seeded order of rows: the MD5 of seed and key, as text, so that any SQL engine can repeat it."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def stratified_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source", ties: list[str] | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot`` so that every shard matches the mixture of sources.

    Rows are shuffled by a seeded hash of ``key`` and ranked within their source; the rank becomes the
    fraction ``(rank + 1/2) / rows of the source``; the order by that fraction is cut into ``shards`` runs whose
    row counts differ by at most one. ``slot`` counts from 0 within a shard.

    Null sources are one source, null keys one key. Repeated rows are told apart by ``ties`` (columns), and
    rows equal in those too are interchangeable. No rows: no output rows. Other columns pass through (``shard`` and ``slot``
    are replaced); keep them few, since rows are sorted twice.
    """
    ties = ties or []
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    order = [F.col(source).asc_nulls_last(), F.col(f"{T}shuffle"), F.col(key), *map(F.col, ties)]
    ranked = running(rows.withColumn(f"{T}shuffle", shuffle_key(seed, key)), order, rank=f"{T}rank", row_id=f"{T}id").drop(f"{T}id")
    ranked = write_table(ranked, "ranked")
    sources = ranked.groupBy(F.col(source).alias(f"{T}source")).agg(F.min(f"{T}rank").alias(f"{T}first"), F.count(F.lit(1)).alias(f"{T}rows"))
    placed = join_groups(ranked, sources.withColumn(f"{T}n", F.col(f"{T}rows")), {source: f"{T}source"}, f"{T}n")
    placed = placed.withColumn(f"{T}fraction", (2 * (F.col(f"{T}rank") - F.col(f"{T}first")) + 1) / (2 * F.col(f"{T}rows")))
    placed = placed.drop(f"{T}first", f"{T}rows")
    mixed = running(placed, [F.col(f"{T}fraction"), F.col(f"{T}rank")], rank=f"{T}place", row_id=f"{T}id")
    total = ranked.agg(F.count(F.lit(1)).alias(f"{T}total"))  # one row
    out = mixed.crossJoin(F.broadcast(total)).withColumn(f"{T}shard", F.expr(f"{T}place * {shards} div {T}total"))
    first = F.expr(f"({T}shard * {T}total + {shards - 1}) div {shards}")
    return out.withColumn(f"{T}slot", F.col(f"{T}place") - first).select(*kept, F.col(f"{T}shard").cast("int").alias("shard"), F.col(f"{T}slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    ``size`` is the text's UTF-8 bytes (none: 0) plus 8, ``text_crc32`` that of its bytes (none: 0). The law held
    is ``rows``: counts differ by at most one, so ``grown_shard`` is null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + RECORD_OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = stratified_shards(rows, shards, seed, ties=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
