"""Words of Arrow string columns as arrays, without an object a word.

A word is a longest run of digits, letters A-Z (lower-cased, and no others) and characters beyond ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The same words in Java's and RE2's patterns, for text whose A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Words:
    """``letters`` of all words one after another; word ``i`` is ``letters[offsets[i]:offsets[i + 1]]``; row ``r`` has words ``bounds[r]:bounds[r + 1]``."""

    letters: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray

    def array(self) -> pa.Array:
        """The words as Arrow strings over the same memory."""
        return pa.Array.from_buffers(pa.large_string(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.letters)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each text's bounds in them; null is as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return letters, offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    """The words of each row's whole text; null and empty texts have none."""
    if not len(column):
        return Words(np.empty(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    data, rows = utf8(column)
    data = _LOWER[data]
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = rows[:-1][rows[:-1] < rows[1:]]
    begins[first] = inside[first]  # a word ends where its row does
    starts = np.flatnonzero(begins)
    letters = data[inside]
    before = np.cumsum(inside, dtype=np.int64) - inside
    offsets = np.append(before[starts], len(letters)).astype(np.int64)
    return Words(letters, offsets, np.searchsorted(starts, rows).astype(np.int64))


def slices(column: pa.Array, about: int) -> list[tuple[int, int]]:
    """Bounds of runs of rows with about so many bytes of text; a longer row is a run of its own."""
    _, rows = utf8(column)
    out, first = [], 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(rows, rows[first] + about, side="right")) - 1)
        out.append((first, min(last, len(column))))
        first = out[-1][1]
    return out
