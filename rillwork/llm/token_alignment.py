"""Alignment of two tokenizers: where tokens of both end together, and how often each pair of ids does so over a corpus.

Pairs are packed into int64 keys (second id above, first id below). Tasks count their keys with ``np.unique``; the partial counts are
range-partitioned and sorted, runs are summed, and each task leaves one sorted count shard in the shared folder,
which the lookup maps into memory.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import T, shared_folder, write_table
from .words import slices

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text aligned at a time, units remembered by a task, and characters of the longest of them.
SLICE, REMEMBERED, LONGEST = 1 << 22, 250_000, 200
#: Characters of units that are encoded together.
TOGETHER = 20_000
#: Keys held before a task folds them into partial counts.
FOLD = 1 << 22
#: Partial counts of a count shard, about.
SHARD = 1 << 20

_MARK = "▁"
_SHIFT = 32


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """The two tokenizers, loaded where they are used; the files must be at the same place on every executor."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_of_char()
        of_id = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.spelt_a = [bytes(alphabet[c] for c in of_id[i]) if i in of_id else b"" for i in range(max(of_id) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.spelt_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, s)), np.int64) for s in (self.spelt_a, self.spelt_b))
        self.said = list(map(str, range(max(len(self.spelt_a), len(self.spelt_b)))))
        self.mark = self.b.piece_to_id(_MARK)
        own = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        #: No piece has a space or a line's end after anything else, so text may be cut before them.
        self.parted = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in own) and len(self.b.encode("\nx", out_type=str)) == 3

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space or a line's end, as they stand within a longer text."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, b)]


def cut(text: str) -> list[str]:
    """Space + text, cut before each single space or line's end between characters that are no white space.

    Both tokenizers cut there as well, whatever stands around: the first one's words take a leading space and end before white
    space, the second one's pieces have spaces only at their start.
    """
    if "\0" in text:
        return [" " + text]
    units = (" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    out = [units[1]]
    for u in units[2:]:
        if out[-1][-1].isspace() or len(u) == 1 or u[1].isspace():
            out[-1] += u
        else:
            out.append(u)
    return out


def _whole(u: str) -> bool:
    """Whether the unit may be encoded in a row with others."""
    return len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and _MARK not in u and "\0" not in u


@dataclass
class _Units:
    """What units of text come to: numbers of tokens and groups, keys of linked pairs, and the groups as written."""

    n_a: np.ndarray
    n_b: np.ndarray
    fine: np.ndarray
    keys: np.ndarray
    key_bounds: np.ndarray
    said: list[str]


class Aligner:
    """Aligns texts unit by unit; units come back often, so a task remembers what they came to."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.units = _Units(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.zeros(1, np.int64), [])

    def _analyse(self, units: list[str]) -> _Units:
        t = self.t
        # safe units in a row are cut where they meet, so many are encoded as one text
        runs: list[list[str]] = []
        chars, before = 0, False
        for u in units:
            whole = _whole(u)
            if before and whole and chars < TOGETHER:
                runs[-1].append(u)
            else:
                runs.append([u])
                chars = 0
            chars += len(u)
            before = whole
        joined, members = list(map("".join, runs)), list(map(len, runs))
        ids_a, ids_b = t.encode(joined)
        first = np.cumsum(members) - members
        spell = lambda spelt, ids: b"".join(map(spelt.__getitem__, ids))
        odd = {j for j, (a, b, text) in enumerate(zip(ids_a, ids_b, joined)) if spell(t.spelt_a, a) != (own := text.encode()) or spell(t.spelt_b, b) != own}
        if any(members[j] > 1 for j in odd):  # find the units that do it
            return self._join([self._analyse(p) for j, own in enumerate(runs) for p in ([[u] for u in own] if j in odd else [own])])
        fine = np.ones(len(units), bool)
        for j in odd:
            fine[first[j]] = False
            ids_a[j], ids_b[j] = [], []
        size = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        flat_a, flat_b = (np.array([i for ids in x for i in ids], np.int64) for x in (ids_a, ids_b))
        ends = np.cumsum(np.where(fine, size, 0))
        end_a, end_b = np.cumsum(t.size_a[flat_a]), np.cumsum(t.size_b[flat_b])
        common, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        unit_of = lambda x: np.searchsorted(ends, x, "left")
        n_a, n_b = (np.bincount(unit_of(x), minlength=len(units)) for x in (end_a, end_b))
        key_unit = unit_of(common)
        said_a, said_b = list(map(t.said.__getitem__, flat_a.tolist())), list(map(t.said.__getitem__, flat_b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            groups.append(",".join(said_a[i:p]) + "|" + ",".join(said_b[j:q]))
            i, j = p, q
        bounds = np.searchsorted(key_unit, np.arange(len(units) + 1))
        said = [";".join(groups[p:q]) for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return _Units(n_a, n_b, fine, flat_b[at_b] << _SHIFT | flat_a[at_a], bounds, said)

    @staticmethod
    def _join(parts: list[_Units]) -> _Units:
        column = lambda f: np.concatenate([getattr(p, f) for p in parts])
        sizes = np.concatenate([np.diff(p.key_bounds) for p in parts])
        return _Units(column("n_a"), column("n_b"), column("fine"), column("keys"), np.concatenate([[0], np.cumsum(sizes)]), [s for p in parts for s in p.said])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Per text: numbers of tokens of both, of groups (one link each), keys of all links with each text's bounds, and its groups as written."""
        if len(self.place) > REMEMBERED or len(self.units.keys) > 16 * REMEMBERED:
            self._clear()
        place, new, flat, counts = self.place, [], [], np.zeros(len(texts), np.int64)
        passing: dict[str, int] = {}  # too long to be remembered
        for i, text in enumerate(texts):
            if not text:
                continue
            own = cut(text) if self.t.parted else [" " + text]
            counts[i] = len(own)
            for u in own:
                at = place.get(u)
                if at is None:
                    at = place[u] = len(self.units.said) + len(new)
                    new.append(u)
                    if len(u) > LONGEST:
                        passing[u] = at
                flat.append(at)
        if new:
            self.units = self._join([self.units, self._analyse(new)])
        known, use = self.units, np.array(flat, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[use])])[bounds])
        fine = total(~known.fine) == 0
        sizes = np.diff(known.key_bounds)
        n_keys = np.where(np.repeat(fine, counts), sizes[use], 0)
        upto = np.concatenate([[0], np.cumsum(n_keys)])
        keys = known.keys[np.repeat(known.key_bounds[use] - upto[:-1], n_keys) + np.arange(upto[-1])]
        said = [";".join(map(known.said.__getitem__, flat[p:q])) if ok else "" for p, q, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), fine.tolist())]
        key_bounds = upto[bounds]
        out = total(known.n_a) * fine, total(known.n_b) * fine, np.diff(key_bounds), keys, key_bounds, said
        if passing:  # forget them; their places stay empty until the next clearing
            for u, at in passing.items():
                del place[u]
                known.said[at] = ""
        return out


def align(docs: DataFrame, first: str = BYTE_LEVEL, second: str = PIECES, key: str = "doc_id", text: str = "text", written: bool = True) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times`` of every document.

    Space + text is encoded by the byte-level tokenizer ``first``, the text by the piece tokenizer ``second``, without special tokens.
    Byte offsets where tokens of both end cut them into ``groups``, written ``a1,a2|b1;a3|b2`` (null unless ``written``); the last
    tokens of a group are linked. ``pairs`` are the distinct linked pairs, ascending, as ``b << 32 | a``, and ``times`` how often
    each is linked here.

    Null and empty texts, and texts that either tokenizer doesn't spell byte for byte (as those with a literal U+2581), have no tokens:
    zeros, no pairs, and empty strings. Rows are independent; other columns are not read. Long texts are cut where both
    tokenizers cut, so memory follows ``SLICE`` bytes or the longest text.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(first, second))
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                n_a, n_b, n_groups, keys, bounds, said = aligner.texts(part.column(1).to_pylist())
                distinct, which = np.unique(keys, return_inverse=True)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                both, times = np.unique(row * max(len(distinct), 1) + which, return_counts=True)
                row, pair = both // max(len(distinct), 1), both % max(len(distinct), 1)
                lists = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
                columns = [part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_groups), pa.array(said if written else [None] * len(said), pa.string()), pa.array(digests)]
                columns += [pa.ListArray.from_arrays(lists, pa.array(distinct[pair])), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {key_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, pairs array<bigint>, times array<int>")


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: each once, with its sum."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        distinct, which = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)

    for batch in batches:
        keys, counts = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((keys, counts))
        size += len(keys)
        if size >= FOLD:
            held = [fold()]
            size = 0
            if len(held[0][0]) > FOLD // 2:  # most keys are new: pass them on
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["key", "n"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([*map(pa.array, fold())], ["key", "n"])


def _local(place: str) -> str | None:
    """The path of a folder that is mounted, or None."""
    return place.removeprefix("file:").replace("///", "/", 1) if place.startswith(("file:", "/")) else None


@dataclass(frozen=True)
class Shard:
    """A sorted count shard: ``n`` keys, then as many counts, int64 each, in the file at ``place``."""

    place: str
    low: int
    high: int
    n: int

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Mapped into memory; from a store that can't be mapped, read."""
        if path := _local(self.place):
            return np.memmap(path, "<i8", "r", 0, (self.n,)), np.memmap(path, "<i8", "r", 8 * self.n, (self.n,))
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.place)
        with store.open_input_file(path) as f:
            both = np.frombuffer(f.read_buffer(16 * self.n), "<i8")
        return both[: self.n], both[self.n :]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ``keys``; 0 where there is none."""
        own, n = self.columns()
        at = np.minimum(np.searchsorted(own, keys), self.n - 1)
        return np.where(own[at] == keys, n[at], 0)

    @staticmethod
    def write(folder: str, keys: np.ndarray, counts: np.ndarray) -> str:
        """A new file; one that a lost task began is never named by a result."""
        from pyarrow import fs

        place = f"{folder}/counts-{uuid.uuid4().hex}"
        path = _local(place)
        store, path = (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(place)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            out.write(keys.astype("<i8").tobytes())
            out.write(counts.astype("<i8").tobytes())
        return place


def pair_counts(aligned: DataFrame) -> tuple[list[Shard], np.ndarray]:
    """Corpus-wide counts of linked pairs as sorted shards, and each second id's highest count (by id).

    ``aligned`` must be stored: it is read here and by the lookup. A pair has as many partial counts as there are tasks, at most,
    all in one shard; a shard is about ``SHARD`` partial counts. The driver holds the list of shards and one number for each
    id of the second tokenizer.
    """
    spark = aligned.sparkSession
    partial = write_table(aligned.select("pairs", "times").mapInArrow(tidy(_partial), "key bigint, n bigint"), "partial-counts")
    folder = f"{shared_folder(spark)}/rillwork/{spark.sparkContext.applicationId}"
    parts = max(1, -(-partial.count() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_sums(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        keys, counts = _sums(*(np.concatenate(x) for x in zip(*held)))
        place = Shard.write(folder, keys, counts)
        second = keys >> _SHIFT
        first = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]]))
        best = pa.array([[{"id": int(i), "n": int(n)} for i, n in zip(second[first], np.maximum.reduceat(counts, first))]], pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([int(keys[0])]), pa.array([int(keys[-1])]), pa.array([len(keys)]), best], ["place", "low", "high", "n", "best"])

    ordered = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    shards = write_table(ordered.mapInArrow(tidy(run), "place string, low bigint, high bigint, n bigint, best array<struct<id:bigint,n:bigint>>"), "count-shards")
    listed = sorted((Shard(r["place"], r["low"], r["high"], r["n"]) for r in shards.select("place", "low", "high", "n").collect()), key=lambda s: s.low)
    most = shards.select(F.explode("best").alias("b")).groupBy("b.id").agg(F.max("b.n").alias("n")).collect()  # ids of a vocabulary
    best = np.zeros(1 + max((r["id"] for r in most), default=0), np.int64)
    for r in most:
        best[r["id"]] = r["n"]
    return listed, best


def look_up(shards: list[Shard], keys: np.ndarray) -> np.ndarray:
    """Counts of sorted ``keys``, shard by shard."""
    out = np.zeros(len(keys), np.int64)
    for s in shards:
        a, b = np.searchsorted(keys, s.low, "left"), np.searchsorted(keys, s.high, "right")
        if b > a:
            out[a:b] = s.counts(keys[a:b])
    return out


def alignment_report(docs: DataFrame, first: str = BYTE_LEVEL, second: str = PIECES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    ``n_best`` counts links whose pair's corpus-wide count is the highest of its second id (ties included); ``count_sum`` adds
    up all links' counts. Odd rows are as in ``align``. No documents: no rows.
    """
    aligned = write_table(align(docs, first, second, written=False).drop("groups"), "aligned")
    shards, best = pair_counts(aligned)
    shared = docs.sparkSession.sparkContext.broadcast((shards, best))  # file names, and a number for each id of a vocabulary
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, highest = shared.value
        for batch in batches:
            pairs = batch.column(len(kept))
            times = batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False)
            size = pc.list_value_length(pairs).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(size)])
            keys, which = np.unique(pairs.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            count = look_up(listed, keys)
            top = count == highest[keys >> _SHIFT] if len(keys) else np.empty(0, bool)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(total(times * top[which])), pa.array(total(times * count[which]))], [*kept, "n_best", "count_sum"])

    found = aligned.select(*kept, "pairs", "times").mapInArrow(tidy(run), f"doc_id {key_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
