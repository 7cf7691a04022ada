"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

A batch of texts is one byte array plus offsets, so words, shingles and
n-grams are found with a few numpy passes instead of a Python loop per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial word hash and the shingle combiner.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
COMBINE = np.uint64(0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a string column."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = ~np.asarray(column.is_null())
    if n and column.null_count:
        length = np.where(valid, np.diff(off), 0)
        if length.sum() != off[-1] - off[0]:  # a null slot may own bytes
            column = column.fill_null("")
            _, offsets, data = column.buffers()
            off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
            raw = np.frombuffer(data, np.uint8) if data is not None else raw
    return raw[off[0] : off[-1]], off - off[0], valid


def slices(offsets: np.ndarray, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at most `rows` rows each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n, start + rows)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Hashes of the words (runs without ASCII white space) of each text.

    Returns (hash of each word, index of each text's first word, with the
    total last).
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]  # a text's start also starts a word
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        # Horner's rule over each word, done for all words of the batch at once
        # by prefix sums of byte * BASE**position, shifted back to the word.
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        value = (total[end] - total[start]) * inverse[start]
        value = mix64(value + np.uint64(0x632BE59BD9B4E019) * (end - start).astype(np.uint64))
    return value, np.searchsorted(start, offsets).astype(np.int64)


_cache: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _cache
    if len(_cache[0]) < n:
        size = 1 << int(n - 1).bit_length()
        if size > 1 << 22:
            return _power_table(size)  # not kept: one very long text must not hold memory
        _cache = _power_table(size)
    return _cache


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5):
    """The set of distinct word shingles of each text, as sorted 64-bit hashes.

    A text of fewer than `size` words has its whole word sequence as its one
    shingle; a text without words has the empty set. Returns (hashes, first
    index of each text with the total last).
    """
    value, at = words(data, offsets)
    counts = np.diff(at)
    rows = len(counts)
    with np.errstate(over="ignore"):
        n = len(value)
        full = np.zeros(max(n - size + 1, 0), np.uint64)
        for k in range(size):
            full = full * COMBINE + value[k : k + len(full)]
        owner = np.repeat(np.arange(rows), counts)
        keep = np.zeros(len(full), bool)
        if len(full):
            keep = owner[: len(full)] == owner[size - 1 :]
        hashes, text = full[keep], owner[: len(full)][keep]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            one = np.array([_fold(value[at[i] : at[i + 1]]) for i in short], np.uint64)
            hashes, text = np.concatenate([hashes, one]), np.concatenate([text, short])
        hashes = mix64(hashes)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(rows + 1)).astype(np.int64)


def _fold(values: np.ndarray) -> int:
    out = len(values)
    for x in values:
        out = (out * int(COMBINE) + int(x)) & 0xFFFFFFFFFFFFFFFF
    return out
