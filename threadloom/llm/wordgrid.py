"""Vectorised word access over Arrow text columns.

Texts are read straight from the Arrow buffers: words are maximal runs of bytes other than space and
9 to 13, found with numpy over a slice of whole texts. Every word gets a 64-bit hash of its bytes, eight a step,
equal in every process. Slices hold about ``SLICE_BYTES`` of text (one text at least), which bounds a task's memory by
the slice and the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

LONG_WORD = 2048  # bytes of a word that are hashed eight at a time; the rest of a longer one at once
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. Mixing after every step leaves no sum that equal parts could cancel in."""
    return mix(a * _FACTOR + b)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` neighbouring values, from those of runs of half the length."""
    h, have = values, 1
    while have * 2 <= length:
        h, have = combine(h[: max(len(h) - have, 0)], h[have:]), have * 2
    if have < length:
        h = combine(h[: max(len(values) - length + 1, 0)], h[length - have :])
    return h


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(codes) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the bytes from every place on
    left = end - start
    h = mix(left.astype(np.uint64) + _FACTOR)
    live, at = np.arange(len(start)), start
    for _ in range(LONG_WORD // 8):
        h[live] = combine(h[live], eight[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
        if not len(live):
            break
    for i, a, n in zip(live.tolist(), at.tolist(), left.tolist()):
        rest = hashlib.blake2b(codes[a : a + n].tobytes(), digest_size=8).digest()
        h[i : i + 1] = combine(h[i : i + 1], np.frombuffer(rest, "<u8"))
    return h


@dataclass
class Words:
    """Words of a slice of texts: byte bounds, hashes, and for each text its first word (with an end)."""

    data: np.ndarray
    begin: np.ndarray  # byte offset of each text, with an end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool) -> np.ndarray:
        codes = _LOWER[self.data] if lower else self.data
        return _word_hashes(codes, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and each text's offset in them, with an end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array) -> Words:
    data, begin = text_bytes(column)
    n = len(data)
    solid = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[1:], before[0] = solid[:-1], False
        after[:-1], after[-1] = solid[1:], False
        before[begin[:-1][begin[:-1] < n]] = False
        after[begin[1:][begin[1:] > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(data, begin, start, end, np.searchsorted(start, begin, side="left"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of text, one row at least; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
