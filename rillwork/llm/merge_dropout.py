"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
#: Bytes of text encoded at a time.
SLICE = 1 << 19
#: Longer words go through an agenda each, shorter ones through arrays together.
WIDE = 48

_SPACE = "▁"
_NONE = np.iinfo(np.int32).max
_UNITS = re.compile(" +[^ ]*| *[^ ]+")


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ALL = (1 << 64) - 1


def _mix_one(x: int) -> int:
    x &= _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores. ``kinds``: n normal, b byte, else not used for text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Of a SentencePiece model of the merge type with byte fallback, read on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        kinds = "".join("b" if model.is_byte(i) else "-" if model.is_unknown(i) or model.is_control(i) or model.is_unused(i) else "n" for i in ids)
        return cls(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == "n"}

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == "b"}
        return [at[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def of_char(self) -> np.ndarray:
        """Symbol of each code point; those without a piece get symbols from ``len(pieces)`` on."""
        out = np.arange(0x110000, dtype=np.int32) + len(self.pieces)
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != _SPACE:  # a literal mark in a text is spelt in bytes, or it would decode as a space
                out[ord(piece)] = i
        out[ord(" ")] = self.ids[_SPACE]
        return out

    @cached_property
    def ranks(self) -> np.ndarray:
        """Place of each piece by score, best first."""
        out = np.empty(len(self.pieces), np.int32)
        out[sorted(range(len(self.pieces)), key=lambda i: (-self.scores[i], i))] = np.arange(len(self.pieces))
        return out

    @cached_property
    def by_rank(self) -> np.ndarray:
        return np.argsort(self.ranks).astype(np.int32)

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Open hash table from (left << 32 | right) to the merged piece's rank."""
        found = {(self.ids[p[:k]] << 32 | self.ids[p[k:]]): int(self.ranks[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        size = 1 << max(4, (16 * len(found)).bit_length())
        keys, values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        for key, rank in found.items():
            at = int(_mix(np.array([key], np.uint64))[0]) & (size - 1)
            while keys[at] >= 0:
                at = (at + 1) & (size - 1)
            keys[at], values[at] = key, rank
        return keys, values

    @cached_property
    def merge_ranks(self) -> dict[int, int]:
        keys, values = self.merges
        held = keys >= 0
        return dict(zip(keys[held].tolist(), values[held].tolist()))

    @cached_property
    def parted_by_space(self) -> bool:
        """No piece has a space after anything else, so text can be cut before spaces."""
        return not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)

    @cached_property
    def spelling(self) -> list[bytes]:
        """What each id decodes to."""
        return [bytes([self.byte_ids.index(i)]) if k == "b" else p.replace(_SPACE, " ").encode() if k == "n" else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what ``left`` and ``right`` merge into, or ``_NONE``."""
        keys, values = self.merges
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = (_mix(wanted.view(np.uint64)) & np.uint64(len(keys) - 1)).astype(np.int64)
        out = np.full(len(wanted), _NONE, np.int32)
        todo = np.arange(len(wanted))
        while len(todo):
            seen = keys[at[todo]]
            hit = seen == wanted[todo]
            out[todo[hit]] = values[at[todo[hit]]]
            todo = todo[(seen >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & (len(keys) - 1)
        return out


class Encoder:
    """Merge-type encoding in which the keyed hash of (seed, document, place of the word, bounds in it) skips candidates."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.vocabulary, self.dropout = vocabulary, dropout
        self.seed = int(_mix(np.array([seed & (1 << 64) - 1], np.uint64))[0])
        self.limit = np.uint64(min(int(dropout * 2.0**64), (1 << 64) - 1))

    def _rank(self, keys: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of candidates, ``_NONE`` where there is none or the hash skips it; each is asked for once."""
        out = self.vocabulary.rank_of(left, right)
        if self.dropout > 0:
            some = np.flatnonzero(out != _NONE)
            place = (start[some].astype(np.uint64) << np.uint64(42)) ^ (middle[some].astype(np.uint64) << np.uint64(21)) ^ end[some].astype(np.uint64)
            out[some[_mix(_mix(keys[some] ^ place) + keys[some]) < self.limit]] = _NONE
        return out

    def _together(self, symbols: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left in each row of ``symbols`` (-1 fills up), flat, and their number in each row."""
        n, width = symbols.shape
        symbols = np.concatenate([symbols, np.full((n, 1), -1, np.int32)], axis=1)
        places = np.arange(width + 1, dtype=np.int32)
        after, before = np.tile(places + 1, (n, 1)), np.tile(places - 1, (n, 1))
        after[:, -1] = width
        rank = np.full((n, width + 1), _NONE, np.int32)
        row, col = np.nonzero((symbols[:, :-1] >= 0) & (symbols[:, 1:] >= 0))
        rank[row, col] = self._rank(keys[row], symbols[row, col], symbols[row, col + 1], col, col + 1, col + 2)
        rows = np.arange(n)
        while len(rows):
            best = rank[rows].argmin(axis=1)
            found = rank[rows, best]
            live = found != _NONE
            rows, j, found = rows[live], best[live], found[live]
            if not len(rows):
                break
            k = after[rows, j]
            end = after[rows, k]
            merged = self.vocabulary.by_rank[found]
            symbols[rows, j], symbols[rows, k] = merged, -2
            after[rows, j], before[rows, end] = end, j
            rank[rows, k] = _NONE
            nxt = symbols[rows, end]
            right = np.full(len(rows), _NONE, np.int32)
            some = np.flatnonzero(nxt >= 0)
            r, e = rows[some], end[some]
            right[some] = self._rank(keys[r], merged[some], nxt[some], j[some], e, after[r, e])
            rank[rows, j] = right
            p = before[rows, j]
            some = np.flatnonzero(p >= 0)
            r, q = rows[some], p[some]
            rank[r, q] = self._rank(keys[r], symbols[r, q], merged[some], q, j[some], end[some])
        alive = symbols >= 0
        return symbols[alive], alive.sum(axis=1)

    def _agenda(self, symbols: list[int], key: int) -> list[int]:
        """One long word: the best candidate first, leftmost of equals, stale ones passed over."""
        n, ranks, limit, of_rank = len(symbols), self.vocabulary.merge_ranks, int(self.limit), self.vocabulary.by_rank
        after, before, symbol = [*range(1, n), n], list(range(-1, n - 1)), list(symbols)
        queue: list[tuple[int, int, int, int]] = []

        def offer(j: int, k: int) -> None:
            rank = ranks.get(symbol[j] << 32 | symbol[k])
            if rank is not None:
                end = after[k]
                place = (j << 42 ^ k << 21 ^ end) & _ALL if end >> 21 == 0 else _mix_one(_mix_one(_mix_one(j) + k) + end)
                if not limit or _mix_one(_mix_one(key ^ place) + key) >= limit:
                    heapq.heappush(queue, (rank, j, k, after[k]))

        for j in range(n - 1):
            offer(j, j + 1)
        while queue:
            rank, j, k, end = heapq.heappop(queue)
            if symbol[j] < 0 or after[j] != k or symbol[k] < 0 or after[k] != end:
                continue
            symbol[j], symbol[k], after[j] = int(of_rank[rank]), -2, end
            if end < n:
                before[end] = j
                offer(j, end)
            if before[j] >= 0:
                offer(before[j], j)
        return [s for s in symbol if s >= 0]

    def words(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word (without its first space) under its key of 64 bits: flat, and offsets."""
        vocabulary = self.vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        wide = np.where(lengths <= 6, 6, np.where(lengths <= 12, 12, np.where(lengths <= 24, 24, np.where(lengths < WIDE, WIDE, 0))))
        flat, counts, order = [], [], []
        for width in (6, 12, 24, WIDE):
            mine = np.flatnonzero(wide == width)
            if not len(mine):
                continue
            symbols = np.full((len(mine), width + 1), -1, np.int32)
            symbols[:, 0] = vocabulary.ids[_SPACE]
            codes = np.frombuffer("".join(words[mine]).encode("utf-32-le"), np.uint32)
            n = lengths[mine]
            row = np.repeat(np.arange(len(mine)), n)
            symbols[row, np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n) + 1] = vocabulary.of_char[codes]
            got, count = self._together(symbols, keys[mine])
            flat.append(got)
            counts.append(count)
            order.append(mine)
        for i in np.flatnonzero(wide == 0):
            codes = np.frombuffer((" " + words[i]).encode("utf-32-le"), np.uint32)
            got = np.array(self._agenda(vocabulary.of_char[codes].tolist(), int(keys[i])), np.int32)
            flat.append(got)
            counts.append(np.array([len(got)]))
            order.append(np.array([i]))
        symbols, count, order = np.concatenate(flat), np.concatenate(counts), np.concatenate(order)
        # characters without a piece are spelt in bytes
        top = len(vocabulary.pieces)
        size = np.ones(len(symbols), np.int64)
        odd = np.flatnonzero(symbols >= top)
        code = symbols[odd] - top
        size[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ids = np.repeat(symbols, size)
        if len(odd):
            places = np.repeat(np.cumsum(size)[odd] - size[odd], size[odd]) + np.arange(size[odd].sum()) - np.repeat(np.cumsum(size[odd]) - size[odd], size[odd])
            spelt = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[places] = np.array(vocabulary.byte_ids, np.int32)[spelt]
        ends = np.cumsum(np.concatenate([[0], size]))[np.cumsum(count)]
        sizes = np.diff(np.concatenate([[0], ends]))
        # back to the order of the words
        start = np.empty(len(words), np.int64)
        length = np.empty(len(words), np.int64)
        start[order], length[order] = ends - sizes, sizes
        offsets = np.concatenate([[0], np.cumsum(length)])
        return ids[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets

    def encode(self, texts: list[str], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets; ``documents`` (64 bits each) and the word's place in the text make its key."""
        whole = not self.vocabulary.parted_by_space
        units: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                own = []
            elif whole:
                own = [text]
            elif "  " in text or text[0] == " ":
                own = [u[1:] for u in _UNITS.findall(" " + text)]
            else:
                own = text.split(" ")
            units += own
            counts[i] = len(own)
        ends = np.cumsum(counts)
        if not len(units):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if self.dropout > 0:
            place = np.arange(len(units)) - np.repeat(ends - counts, counts)
            keys = _mix(np.repeat(_mix(documents ^ np.uint64(self.seed)), counts) + place.astype(np.uint64))
            ids, offsets = self.words(np.array(units, dtype=object), keys)
            return ids, offsets[np.concatenate([[0], ends])]
        # without dropout a word is cut in one way
        table: dict[str, int] = {}
        use = np.fromiter((table.setdefault(u, len(table)) for u in units), np.int64, len(units))
        ids, offsets = self.words(np.array(list(table), dtype=object), np.zeros(len(table), np.uint64))
        length = np.diff(offsets)[use]
        until = np.concatenate([[0], np.cumsum(length)])
        out = ids[np.repeat(offsets[use] - until[:-1], length) + np.arange(until[-1])]
        return out, until[np.concatenate([[0], ends])]

    def decode(self, ids: list[int]) -> bytes:
        """The text's UTF-8."""
        return b"".join(map(self.vocabulary.spelling.__getitem__, ids))[1:]


def document_key(value) -> int:
    """64 bits of a document's key, the same in every process."""
    return xxhash.xxh64_intdigest(repr(value).encode())


def encode_column(docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text", check: bool = True, copies: bool = False) -> DataFrame:
    """``key, ids, n_tokens, round_trip``: each whole text's piece ids, and whether they decode to it.

    Candidates for merging are taken best first; each is skipped with chance ``dropout``, by a hash of the seed, the document's
    key, the word's place in it, and the candidate's bounds, so a run can be repeated, and every occurrence of a word is cut in
    its own way. Rows of one key and text are cut alike, unless ``copies``: then the row's
    number in the table (its partition, and its place there) is hashed too, so that every row is cut in its own way, however many follow
    each other and wherever they lie; the table should be a stored one, of which a repeated task reads the same rows. With dropout 0 the ids are the library's own, but for a literal U+2581, which is spelt
    in bytes so that it isn't read back as a space.

    Null texts have null ids (and null ``round_trip``), empty ones none. Rows are independent. ``check=False`` skips
    decoding (``round_trip`` is then null). Other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))  # as large as the model's vocabulary
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        for batch in batches:
            first = 0
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
            while first < batch.num_rows:
                done = int(sizes[first - 1]) if first else 0
                upto = max(first + 1, int(np.searchsorted(sizes, done + SLICE)))
                part = batch.slice(first, min(upto, batch.num_rows) - first)
                first += part.num_rows
                texts = part.column(1).to_pylist()
                documents = np.array([document_key(v) for v in part.column(0).to_pylist()], np.uint64)
                if copies:
                    nth = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
                    documents = np.where(nth > 0, _mix(documents + nth), documents)
                ids, offsets = encoder.encode([t or "" for t in texts], documents)
                valid = np.array([t is not None for t in texts])
                # a null offset marks a null list
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(~valid, False)), pa.array(ids))
                same = [None if t is None or not check else encoder.decode(ids[a:b].tolist()) == t.encode() for t, a, b in zip(texts, offsets, offsets[1:])]
                count = pa.array(np.diff(offsets), mask=~valid)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, count, pa.array(same, pa.bool_())], [key, "ids", "n_tokens", "round_trip"])

    row = F.monotonically_increasing_id() if copies else F.lit(0).cast("long")
    return docs.select(F.col(key), F.col(text), row.alias(f"{T}row")).mapInArrow(tidy(run), f"`{key}` {key_type}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode_column(encoded: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from piece ids; null ids: null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if i is None else encoder.decode(i).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, F.col(ids)).mapInArrow(tidy(run), f"`{key}` {key_type}, text string")
