"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a benchmark item. Text is read as word numbers; blocks of two words index a table of
shifts, which skips positions where no pattern can end, the last block picks a bucket of patterns, narrowed by
the first block, and a comparison of all words decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import T, write_table
from .words import PATTERN, slices, words_of

#: Words of a window.
WINDOW = 10
#: Pairs of window and item that are searched for together: about 100 MB of tables in a task.
BLOCK = 500_000
#: Bytes of text read at a time, words of a lane, and pairs of position and pattern compared at a time.
SLICE, LANE, PAIRS = 1 << 22, 512, 1 << 18


def _block(left: np.ndarray, right: np.ndarray, mask: int) -> np.ndarray:
    """Place of a block of two words in the table of shifts."""
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(mask)).astype(np.int64)


@dataclass(frozen=True)
class Patterns:
    """Patterns of one length (``words``: one a row, word numbers from 1) with their tables."""

    words: np.ndarray
    names: np.ndarray
    shift: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, names: np.ndarray) -> Patterns:
        n, m = words.shape
        size = 1 << max(12, (8 * n * m).bit_length())
        b = min(2, m)
        shift = np.full(size, m - b + 1, np.uint8 if m < 255 else np.int32)
        for j in range(b, m + 1):  # the block that ends at word j
            np.minimum.at(shift, _block(words[:, j - b], words[:, j - 1], size - 1), m - j)
        ends, firsts = _block(words[:, m - b], words[:, m - 1], size - 1), _block(words[:, 0], words[:, b - 1], size - 1)
        order = np.lexsort((firsts, ends))
        return cls(words[order], names[order], shift, ends[order], firsts[order])

    def ends_in(self, ids: np.ndarray, begin_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(last word's position, pattern)`` of all occurrences; ``begin_of`` is the first position of each word's text.

        Lanes of the text step through the table together: each looks at the block that ends at its position
        and moves on by the block's shift, or, where that is 0, notes the position and moves on by one.
        """
        m = self.words.shape[1]
        b = min(2, m)
        mask = len(self.shift) - 1
        if len(ids) < m:
            return
        at = np.arange(m - 1, len(ids), LANE)
        until = np.append(at[1:], len(ids))
        suspects = []
        while len(at):
            by = self.shift[_block(ids[at - b + 1], ids[at], mask)].astype(np.int64)
            suspects.append(at[by == 0])
            at = at + np.maximum(by, 1)
            on = at < until
            at, until = at[on], until[on]
        found = np.concatenate(suspects)
        found = found[found - m + 1 >= begin_of[found]]
        whole = (self.ends << 32) | self.firsts
        begin = found - m + 1
        key = (_block(ids[found - b + 1], ids[found], mask) << 32) | _block(ids[begin], ids[begin + b - 1], mask)
        low, high = np.searchsorted(whole, key, "left"), np.searchsorted(whole, key, "right")
        some = high > low
        found, low, count = found[some], low[some], (high - low)[some]
        upto = np.concatenate([[0], np.cumsum(count)])
        for a in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(a, min(a + PAIRS, int(upto[-1])))
            row = np.searchsorted(upto, pair, "right") - 1
            pattern, end = low[row] + pair - upto[row], found[row]
            same = np.ones(len(pair), bool)
            for j in range(m):
                same[same] = ids[end[same] - m + 1 + j] == self.words[pattern[same], j]
            yield end[same], pattern[same]


@dataclass(frozen=True)
class Searcher:
    """The patterns of a block by length, the words they have, and the items that have them."""

    vocabulary: pa.Array
    patterns: tuple[Patterns, ...]
    item_bounds: np.ndarray
    items: np.ndarray
    said: tuple[str, ...]

    @classmethod
    def of(cls, windows: pa.Array, items: pa.Array) -> Searcher:
        """Of pairs of a window (words joined by spaces) and an item's name (null: none)."""
        coded = pc.dictionary_encode(windows)
        names = pc.dictionary_encode(items)
        said = names.dictionary.to_pylist()
        rank = np.empty(len(said), np.int64)
        order = sorted(range(len(said)), key=said.__getitem__)  # by code point
        rank[order] = np.arange(len(said))
        window = coded.indices.to_numpy(zero_copy_only=False)
        item = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
        named = item >= 0
        pairs = np.unique(np.stack([window[named].astype(np.int64), rank[item[named]]]), axis=1) if named.any() else np.empty((2, 0), np.int64)
        split = pc.split_pattern(coded.dictionary, " ")
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        flat = pc.dictionary_encode(split.flatten())
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        begins = np.cumsum(lengths) - lengths
        patterns = []
        for m in np.unique(lengths):
            mine = np.flatnonzero(lengths == m)
            patterns.append(Patterns.of(ids[begins[mine][:, None] + np.arange(m)], mine))
        bounds = np.searchsorted(pairs[0], np.arange(len(coded.dictionary) + 1))
        return cls(flat.dictionary.cast(pa.large_string()), tuple(patterns), bounds, pairs[1], tuple(said[i] for i in order))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each row; ``(row, first word, last word)`` of each occurrence; distinct ``(row, item)``."""
        words = words_of(texts)
        n_words = np.diff(words.bounds)
        ids = pc.fill_null(pc.index_in(words.array(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        begin_of = np.repeat(words.bounds[:-1], n_words)
        found = [(end, p.words.shape[1], p.names[pattern]) for p in self.patterns for end, pattern in p.ends_in(ids, begin_of)]
        end = np.concatenate([np.empty(0, np.int64), *(e for e, _, _ in found)])
        begin = np.concatenate([np.empty(0, np.int64), *(e - m + 1 for e, m, _ in found)])
        window = np.concatenate([np.empty(0, np.int64), *(w for _, _, w in found)])
        row = np.searchsorted(words.bounds, end, "right") - 1
        both = np.unique(np.stack([row, window]), axis=1) if len(row) else np.empty((2, 0), np.int64)
        count = self.item_bounds[both[1] + 1] - self.item_bounds[both[1]]
        places = np.repeat(self.item_bounds[both[1]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs = np.unique(np.stack([np.repeat(both[0], count), self.items[places]]), axis=1) if len(places) else np.empty((2, 0), np.int64)
        return n_words, row, begin - words.bounds[row], end - words.bounds[row], pairs[0], pairs[1]


def hit_words(row: np.ndarray, begin: np.ndarray, end: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Number of words of each row that lie in any of its spans."""
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    edges = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edges, bounds[row] + begin, 1)
    np.add.at(edges, bounds[row] + end + 1, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def words_column(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """``window, item``: distinct pairs of a window's words, joined by spaces, and an item's name."""
    listed = items.select(F.col(item).cast("string").alias("item"), words_column(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))).alias("window")).distinct()


def _searchers(docs: DataFrame, items: DataFrame, window: int, block: int) -> Iterator:
    """Broadcast searchers of ``block`` pairs or so each; the driver holds one block at a time."""
    pairs = write_table(item_windows(items, window), "windows")
    blocks = max(1, -(-pairs.count() // block))
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).toArrow().combine_chunks()
        column = lambda c: (mine.column(c).combine_chunks() if mine.num_rows else pa.array([], pa.string())).cast(pa.string())  # noqa: B023, E731
        yield docs.sparkSession.sparkContext.broadcast(Searcher.of(column("window"), column("item"))), blocks


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``key, n_words, spans, items`` of every document: where windows of the items occur, and in which items they are.

    A window is ``window`` consecutive words of an item, or all of one that has fewer; it occurs where the same words follow
    each other in the document, whatever stands between. ``spans`` are ``(a, b)``: first and last word, from 0; ``items`` are
    distinct names in the order of their code points.

    Patterns are searched for in blocks of ``block`` pairs of window and item, each broadcast; no text is shuffled. With one
    block a row's answer comes from one pass; with more, rows are numbered and written, and what the passes found
    meets by number. Null and empty texts have no words; items without words are never found, and those without a name have spans but are
    not listed; rows of one name are one item. Rows of ``docs`` are independent. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    parts = []
    for shared, blocks in _searchers(docs, items, window, block):
        if not parts and blocks > 1:
            docs = write_table(docs.select(key, text).withColumn(f"{T}row", F.monotonically_increasing_id()), "numbered")
        row_id = F.lit(0).cast("long") if blocks == 1 else F.col(f"{T}row")

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            for batch in batches:
                for first, last in slices(batch.column(1), SLICE):
                    part = batch.slice(first, last - first)
                    n_words, row, begin, end, item_row, item = searcher.find(part.column(1))
                    order = np.lexsort((end, begin, row))
                    bounds = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                    spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(begin[order]), pa.array(end[order])], ["a", "b"]))
                    said = pa.array(searcher.said, pa.string()).take(pa.array(item))
                    names = pa.ListArray.from_arrays(pa.array(np.searchsorted(item_row, np.arange(part.num_rows + 1)).astype(np.int32)), said)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words), spans, names], [key, "row", "n_words", "spans", "items"])

        parts.append(docs.select(F.col(key), F.col(text), row_id.alias("row")).mapInArrow(tidy(run), f"`{key}` {key_type}, row bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"))
    if len(parts) == 1:
        return parts[0].drop("row")
    parts = [write_table(p, "found") for p in parts]
    slim = parts[0].select(key, "row", "n_words")
    some = parts[0].where(F.size("spans") > 0)
    for p in parts[1:]:
        some = some.unionByName(p.where(F.size("spans") > 0))
    some = some.groupBy(F.col("row").alias(f"{T}row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = slim.join(some, F.col("row") == F.col(f"{T}row"), "left")
    return joined.select(key, "n_words", F.coalesce(F.array_sort("spans"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: how many words lie in any occurrence, and the items they come from."""
    found = occurrences(docs, items, **options)
    key_type = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, names = batch.column(2), batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
            ends = spans.flatten()
            n_words = batch.column(1).to_numpy(zero_copy_only=False)
            begin, end = (ends.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n_hit = hit_words(row, begin, end, n_words)
            digests = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit), pc.list_value_length(names).cast(pa.int64()), pa.array(digests), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(run, f"doc_id {key_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, most: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of whose words more than the share ``most`` lie in occurrences; all columns stay."""
    number = f"{T}doc"
    rows = write_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    report = contamination_report(rows.select(F.col(number).alias("doc_id"), "text"), items, **options)
    bad = report.where(F.col("n_hit") > most * F.col("n_words")).select(F.col("doc_id").alias(number))
    return rows.join(bad, number, "left_anti").select(docs.columns)
