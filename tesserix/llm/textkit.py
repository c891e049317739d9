"""Texts as flat byte arrays: words, shingles and hashes of a whole batch by numpy.

A span's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums (the base is
odd, so its powers can be divided out), and then mixed. Work goes by slices of about SLICE bytes;
a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of 64-bit murmur hashing."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(SLICE, int(n)).bit_length())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def first_bytes(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a text starts at a byte."""
    out = np.zeros(n, bool)
    at = offsets[:-1]
    out[at[at < offsets[1:]]] = True
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that come in order and don't overlap, by parts of about SLICE bytes, so that long texts need no long tables."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > SLICE:  # a span longer than a part: the hashes of its parts, one after the other
            h = np.zeros(1, np.uint64)
            for c in range(lo, hi, SLICE):
                h = mixed(h * BASE + _hashed(data[c : min(hi, c + SLICE)], np.array([0]), np.array([min(hi, c + SLICE) - c])))
            out[i] = h[0]
        else:
            out[i:j] = _hashed(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, first = SPACE[data], first_bytes(offsets, len(data))
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    # a word ends where a space or another text follows
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:] | first[1:]
    return starts, np.flatnonzero(~space & after) + 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word shingles, offsets by text), repeats kept.

    A text with fewer words has its whole sequence as its one shingle; without words it has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)  # the words of text i are at[i] to at[i + 1]
    count = np.diff(at)
    out_count = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_at = np.zeros(n + 1, np.int64)
    np.cumsum(out_count, out=out_at[1:])
    total = np.zeros(out_at[-1], np.uint64)
    if not len(total):
        return total, out_at
    owner = np.repeat(np.arange(n), out_count)
    pos = np.arange(len(total)) - out_at[owner] + at[owner]
    length = np.minimum(count, k)[owner]
    mult = np.uint64(1)
    for j in range(k):
        mult = np.uint64((int(mult) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64)
        use = j < length
        total += np.where(use, words[np.minimum(pos + j, len(words) - 1)], np.uint64(j)) * (mult | np.uint64(1))
    return mixed(total + length.astype(np.uint64)), out_at
