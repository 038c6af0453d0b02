"""Words, word hashes and shingles of Arrow text columns, computed on the raw UTF-8 bytes.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``. All white space of that class is ASCII, so
splitting bytes is the same as splitting characters. Texts are taken in slices of a few megabytes,
each slice in a handful of numpy passes; a single longer text is a slice of its own and stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for key, base in (("up", _ODD), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def drop_tables() -> None:
    """Give back the memory of the power tables; the next slice makes them anew."""
    _powers.clear()


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    low, rows = 0, len(at) - 1
    while low < rows:
        high = int(np.searchsorted(at, at[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


@dataclass
class Words:
    """Words of consecutive texts. ``first[d]`` is the position of text d's first word."""

    raw: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    space: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal bytes."""
        return span_hashes(self.raw, self.start, self.end)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(len(start), np.uint64)
    up, down = _power_table(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[:-1], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * _ODD)


def split(raw: np.ndarray, at: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside the ``gap`` table."""
    if lower:
        raw = LOWER[raw]
    n = len(raw)
    space = gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    word = ~space
    start = np.flatnonzero(word & (before | cut[:-1]))
    end = np.flatnonzero(word & (after | cut[1:])) + 1
    return Words(raw, at, start, end, np.searchsorted(start, at), space)


def word_slices(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for successive slices of a text column."""
    raw, at = text_buffers(texts)
    for low, high in slices(at, limit):
        yield low, high, split(raw[at[low] : at[high]], at[low : high + 1] - at[low], lower)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and where each text's begin.

    A text with fewer words than ``size`` has its whole word sequence as one shingle; a text
    without words has none.
    """
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=begin[1:])
    doc = np.repeat(np.arange(len(counts)), number)
    position = np.arange(begin[-1]) - begin[doc] + first[doc]
    value = np.zeros(begin[-1], np.uint64)
    width = np.minimum(counts, size)[doc]
    for j in range(size):
        inside = j < width
        word = hashes[np.where(inside, position + j, 0)] if len(hashes) else value
        value = np.where(inside, value * np.uint64(0xD6E8FEB86659FD93) + word, value)
    return mix(value + width.astype(np.uint64)), begin


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
