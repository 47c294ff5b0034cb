"""Ranked lexical search: compressed postings per shard, merged a document at a time.

Index: ``build_index`` writes one row a shard and term, with postings in the order of ``doc_id``, and one a shard with its documents.
Search: ``search`` walks a shard's postings with a heap of cursors, keeps each item's best in a bounded heap, and merges shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import T, write_table
from .words import PATTERN, words_of

K = 50
#: A shard is closed when it has so many bytes of text or documents; a longer text is a shard of its own.
SHARD_BYTES = 1 << 24
SHARD_DOCS = 1 << 14
#: Documents of a window, through which cursors step together.
WINDOW_BITS = 9
#: Items searched together.
BLOCK = 512
#: Groups of shards whose best are merged before all are.
SPREAD = 64


def encode_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (7 bits each, lowest first, the last one under 128) of whole numbers from 0, and where each begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, at


def decode_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 128
    begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins)


def _shard_rows(shard: int, ids: pa.Array, texts: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents in order, then each term's postings (steps of place and occurrences, by turns)."""
    order = pc.array_sort_indices(ids, order="ascending") if not ids.null_count else pc.sort_indices(pa.table({"k": ids}), sort_keys=[("k", "ascending")], null_placement="at_start")
    ids, words = ids.take(order), words_of(texts.take(order))
    lengths = np.diff(words.bounds)
    packed, _ = encode_numbers(lengths)
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.nulls(1, pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([packed.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], schema=schema
    )
    if not len(words.offsets) > 1:
        return
    coded = words.array().dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    key, times = np.unique(key, return_counts=True)
    term, place = key // len(ids), key % len(ids)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    stream = np.empty(2 * len(key), np.int64)
    stream[0::2], stream[1::2] = step, times
    data, at = encode_numbers(stream)
    bounds = np.append(at[2 * first], len(data)).astype(np.int32)
    found = np.diff(np.append(first, len(key)))
    postings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    for a in range(0, len(first), 20_000):
        part = slice(a, a + 20_000)
        n = len(first[part])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), terms.slice(a, n), pa.array(found[part]), pa.array(np.zeros(n, np.int64)), postings.slice(a, n), pa.nulls(n, schema.field("doc_ids").type)], schema=schema)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``shard, term, n, words, data, doc_ids`` of all whole texts, stored; no text is shuffled.

    A row of a term has its postings in ``data``: for each of its ``n`` documents the step from the last one's place
    and the number of occurrences. A shard's row without a term has its ``doc_ids`` in ascending order (null first), their
    lengths in ``data``, how many of them have words (``n``) and all their ``words``. A shard is a run of rows of one task.

    Null and empty texts are documents without words. Rows of one key stay apart. No rows: no index. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        shard = TaskContext.get().partitionId() << 33

        def flush() -> Iterator[pa.RecordBatch]:
            together = pa.Table.from_batches(held).combine_chunks()
            ids = together.column(0).combine_chunks()
            schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("words", pa.int64()), ("data", pa.binary()), ("doc_ids", pa.list_(ids.type))])
            yield from _shard_rows(shard, ids, together.column(1).combine_chunks().cast(pa.large_string()), schema)

        for batch in batches:
            first = 0
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            until = np.cumsum(lengths)
            while first < batch.num_rows:
                done = int(until[first - 1]) if first else 0
                fit = int(np.searchsorted(until, done + shard_bytes - size, side="right")) - first
                take = min(max(fit, 0 if held else 1), shard_docs - rows, batch.num_rows - first)
                if take:
                    held.append(batch.slice(first, take))
                    rows, size, first = rows + take, size + int(until[first + take - 1]) - done, first + take
                if not take or rows >= shard_docs or size >= shard_bytes:
                    yield from flush()
                    held, rows, size, shard = [], 0, 0, shard + 1
        if held:
            yield from flush()

    index = docs.select(key, text).mapInArrow(tidy(run), f"shard bigint, term string, n bigint, words bigint, data binary, doc_ids array<{key_type}>")
    return write_table(index, "lexical-index")


class _Cursor:
    """A term's postings in a shard with what each gives to the score, in windows of documents."""

    def __init__(self, data: bytes, weight: int, penalty: np.ndarray):
        numbers = decode_numbers(data)
        place, times = np.cumsum(numbers[0::2]), numbers[1::2]
        gain = weight * (1_000_000_000 * times // (1000 * times + 20 * penalty[place]))
        window = place >> WINDOW_BITS
        begins = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        self.windows = window[begins].tolist()
        self.most = np.maximum.reduceat(gain, begins).tolist()
        ends = [*begins[1:].tolist(), len(place)]
        self.parts = [(place[a:b] & ((1 << WINDOW_BITS) - 1), gain[a:b]) for a, b in zip(begins.tolist(), ends)]


def best_of_shard(cursors: list[_Cursor], k: int) -> list[tuple[int, int]]:
    """The ``k`` best ``(score, place)`` above 0, best first, equal scores by place.

    The heap holds each cursor at its next window of documents; cursors of one window are taken off together, their gains
    summed, and a window whose greatest gains can't pass the ``k``-th score so far is left out. Places only rise, so
    an equal score never replaces one that is kept.
    """
    ahead = [(c.windows[0], i, 0) for i, c in enumerate(cursors)]
    heapq.heapify(ahead)
    kept: list[tuple[int, int]] = []  # (score, -place): the worst of equals is the one of the greatest place
    sums = np.zeros(1 << WINDOW_BITS, np.int64)
    while ahead:
        window = ahead[0][0]
        here = []
        while ahead and ahead[0][0] == window:
            _, i, at = ahead[0]
            cursor = cursors[i]
            here.append((cursor, at))
            if at + 1 < len(cursor.windows):
                heapq.heapreplace(ahead, (cursor.windows[at + 1], i, at + 1))
            else:
                heapq.heappop(ahead)
        floor = kept[0][0] if len(kept) == k else 0
        if sum(cursor.most[at] for cursor, at in here) <= floor:
            continue
        sums[:] = 0
        for cursor, at in here:
            place, gain = cursor.parts[at]
            sums[place] += gain
        found = np.flatnonzero(sums > floor)
        for place, score in zip((found + (window << WINDOW_BITS)).tolist(), sums[found].tolist()):
            if len(kept) < k:
                heapq.heappush(kept, (score, -place))
            elif score > kept[0][0]:
                heapq.heapreplace(kept, (score, -place))
    return [(score, -place) for score, place in sorted(kept, reverse=True)]


def search(index: DataFrame, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``item, rank, key, score``: each item's ``k`` best documents with a score above 0, best first, equal scores by ascending key (null first).

    A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))`` of the documents with words; a document adds for each of the
    item's terms, once each, ``w * (10**9 tf div (1000 tf + 20 m))`` with ``m = 50 + 50 n N div L``.

    Only postings of the items' terms are read on; a task holds those of one shard and ``BLOCK`` items. Shards are
    merged in ``SPREAD`` groups, then together. Items without words or hits have no rows; items of one id are ranked apart.
    """
    spark = index.sparkSession
    totals = index.where(F.col("term").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
    n_docs, n_words = int(totals["n"]), int(totals["l"])
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item).alias(f"{T}item"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0))).alias("terms"), F.monotonically_increasing_id().alias("row"))
    asked = write_table(asked, "items")
    blocks = max(1, -(-asked.count() // BLOCK))
    terms = asked.select("row", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode("terms").alias("term"))
    hits = write_table(index.where(F.col("term").isNotNull()).join(terms.select("term").distinct(), "term", "left_semi").select("shard", "term", "n", "data"), "postings")
    frequency = hits.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    wanted = terms.join(frequency.select("term", weight.alias("weight")), "term").where("weight > 0")
    lists = wanted.groupBy("block", "term", "weight").agg(F.collect_list("row").alias("rows"))  # BLOCK or fewer
    postings = hits.join(lists, "term").select("shard", "block", "weight", "rows", "data", F.lit(None).cast(index.schema["doc_ids"].dataType).alias("doc_ids"))
    shards = index.where(F.col("term").isNull()).select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).cast("long").alias("weight"), F.lit(None).cast("array<bigint>").alias("rows"), "data", "doc_ids")

    def run(table: pa.Table) -> pa.Table:
        data, rows, weights, ids = (table.column(c).to_pylist() for c in ("data", "rows", "weight", "doc_ids"))
        own = next(i for i, r in enumerate(rows) if r is None)
        lengths = decode_numbers(data[own])
        penalty = 50 + (50 * lengths * n_docs) // max(n_words, 1)
        of_item: dict[int, list[_Cursor]] = {}
        for i, r in enumerate(rows):
            if i != own:
                cursor = _Cursor(data[i], weights[i], penalty)
                for row in r:
                    of_item.setdefault(row, []).append(cursor)
        found = [(row, ids[own][place], score) for row, cursors in of_item.items() for score, place in best_of_shard(cursors, k)]
        shard = table.column("shard")[0].as_py()
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table({"row": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], table.schema.field("doc_ids").type.value_type), "score": pa.array(columns[2], pa.int64()), "shard": pa.array([shard] * len(found), pa.int64())})

    key_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    best = postings.unionByName(shards).groupBy("shard", "block").applyInArrow(run, f"row bigint, key {key_type}, score bigint, shard bigint")
    order = [F.col("score").desc(), F.col("key").asc_nulls_first()]
    some = Window.partitionBy("row", F.pmod(F.xxhash64("shard"), F.lit(SPREAD))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("row", f"{T}item"), "row").select(F.col(f"{T}item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``search`` over an index of all ``docs``."""
    return search(build_index(docs), items, k)
