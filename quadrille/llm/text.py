"""Vectorised views of UTF-8 text columns: words, word hashes and rolling hashes of word runs.

Everything works on the bytes of an Arrow string column, a few MB at a time, so that memory is
bounded by the largest single document and not by an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; a longer document is handled alone.
CHUNK_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], equal for equal runs wherever they stand."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


@dataclass
class Words:
    """The words of some documents in a row; document d has the words first[d]:first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def of(self, d: int) -> slice:
        return slice(self.first[d], self.first[d + 1])


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    # The buffers are looked at where they are; only offsets are widened.
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for groups of rows of about CHUNK_BYTES."""
    data, at = string_parts(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not separators; no word crosses the end of a document.

    fold: a 256-entry table applied to the bytes before hashing (such as lower-casing A-Z).
    """
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(separator[data], out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    stops = inside[:-1] & ~inside[1:]
    stops[cut[cut > 0] - 1] |= inside[cut[cut > 0] - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    first = np.searchsorted(start, offsets)
    codes = _BYTES[data if fold is None else fold[data]]
    h = mix(span_hashes(codes, start, end, _BASE) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, first, h)


def run_hashes(hashes: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hashes of all runs of k consecutive words, also those that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(span_hashes(hashes, at, at + k, base))


def inside_document(first: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words by its first word: does it lie within one document?"""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[:n] == owner[k - 1 :]
