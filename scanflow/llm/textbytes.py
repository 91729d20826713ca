"""Byte-level helpers for whole Arrow text columns: slabs, rolling hashes and word positions.

All functions work on numpy arrays over the UTF-8 buffer of a column, so the cost of a row is a few
vector operations per byte and no Python loop runs over characters or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK64 = (1 << 64) - 1
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code for every byte value."""
    if "codes" not in _cache:
        _cache["codes"] = mix((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return _cache["codes"]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``BASE**i`` (or its inverse) for i < n."""
    name = "inverse" if inverse else "forward"
    have = _cache.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, np.uint64(BASE_INVERSE if inverse else BASE), dtype=np.uint64)
        table[0] = 1
        _cache[name] = have = np.multiply.accumulate(table, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Hashes of any substring of one buffer, by prefix sums of weighted byte codes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_codes()[data] * powers(n), out=self.prefix[1:])
        self.shift = powers(n + 1, inverse=True)

    def raw(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.shift[begin]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(begin, end) + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every position that has so many."""
        return mix((self.prefix[size:] - self.prefix[: len(self.prefix) - size]) * self.shift[: len(self.prefix) - size])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(starts) and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    if len(raw):
        raw = raw[starts[0] : starts[-1]]
    return raw, starts - (starts[0] if len(starts) else 0)


def row_groups(offsets: np.ndarray, size: int, most: int = 2048):
    """Ranges of whole rows of about ``size`` bytes and at most ``most`` rows each (one row at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1), first + most)
        yield first, last
        first = last


#: The separators of words are the space and the bytes 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word (a run without separators) and the first word of each row.

    Words never span rows. The third array has n + 1 entries: row i owns the words
    ``first[i] .. first[i + 1] - 1``.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    begin = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every ``size`` successive words of a row, its row and its first word.

    A row with fewer words gives its whole sequence as one shingle; a row without words none.
    ``word`` holds word hashes.
    """
    n = len(word)
    count = np.diff(first)
    row_of = np.repeat(np.arange(len(count)), count)
    full = np.zeros(n, dtype=np.uint64)
    if n >= size:
        for k in range(size):
            full[: n - size + 1] = mix(full[: n - size + 1] * np.uint64(BASE) + word[k : n - size + 1 + k])
    at = np.arange(n)
    ok = at + size <= first[1:][row_of] if n else np.zeros(0, bool)
    rows, starts, hashes = row_of[ok], at[ok], full[ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            live = count[short] > k
            value[live] = mix(value[live] * np.uint64(BASE) + word[first[:-1][short][live] + k])
        value = mix(value + np.uint64(size) + count[short].astype(np.uint64))
        rows = np.concatenate([rows, short])
        starts = np.concatenate([starts, first[:-1][short]])
        hashes = np.concatenate([hashes, value])
        order = np.argsort(rows, kind="stable")
        rows, starts, hashes = rows[order], starts[order], hashes[order]
    return hashes, rows, starts
