"""Words and shingles of Arrow text columns as 64-bit hashes, computed with numpy inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1 << 18                          # bytes hashed at once; longer words go through blake2b
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACES = np.ones(256, bool)              # words [^\x20\x09-\x0D]+
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)              # words of digits, lower-case letters and all of non-ASCII
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)   # lower-cases A-Z only
LOWER[0x41:0x5B] += 0x20


def _powers(base: int) -> np.ndarray:
    out = np.full(LIMIT + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POW, INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a text column; null is empty."""
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs_of_rows(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes, and each row's first word."""
    inside = kind[buf]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + LIMIT, side="right"))
        if j <= i:
            out[i] = int.from_bytes(hashlib.blake2b(buf[base:int(ends[i])].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        run = np.zeros(int(ends[j - 1]) - base + 1, np.uint64)
        np.cumsum((buf[base:int(ends[j - 1])] + np.uint64(1)) * POW[:len(run) - 1], out=run[1:])
        s = starts[i:j] - base
        out[i:j] = (run[ends[i:j] - base] - run[s]) * INV[s]
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each row, and each row's first run; shorter rows give none."""
    count = np.diff(first)
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total += words[j:j + len(total)] * POW[j + 1]
    row = np.repeat(np.arange(len(count)), count)
    whole = row[:len(total)] == row[width - 1:]
    return mix(total[whole] + np.uint64(width)), np.concatenate([[0], np.cumsum(np.maximum(count - width + 1, 0))])


def shingle_sets(column: pa.Array, width: int, kind: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row. A row with fewer words than `width` has its whole
    sequence as one shingle, a row without words none."""
    data, offsets = utf8(column)
    for i, j in runs_of_rows(offsets):
        buf = LOWER[data[offsets[i]:offsets[j]]]
        starts, ends, first = word_bounds(buf, offsets[i:j + 1] - offsets[i], kind)
        words = word_hashes(buf, starts, ends)
        hashes, at = shingle_hashes(words, first, width)
        for r in range(j - i):
            n = int(first[r + 1] - first[r])
            if n >= width or n == 0:
                yield np.unique(hashes[at[r]:at[r + 1]])
            else:
                yield shingle_hashes(words[first[r]:first[r + 1]], np.array([0, n]), n)[0]
