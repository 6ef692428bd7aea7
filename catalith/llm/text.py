"""Words, their hashes and n-grams of whole Arrow batches, as NumPy arrays.

The bytes of all texts of a batch are handled at once: no Python string and no
Python loop for each word. A word's hash is a polynomial over its bytes,
lower-cased in A-Z only, with random coefficients for the byte values, finished
by an avalanche; it is 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For matching passages: letters, digits and all bytes beyond ASCII make words.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche over 64 bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << int(max(n, 1) - 1).bit_length())
    return _powers(size)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes together; no row is cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _stretches(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of raw of about SLICE bytes that cut no word."""
    at = 0
    while at < len(raw):
        to = min(at + SLICE, len(raw))
        if to < len(raw):
            back = np.flatnonzero(gaps[raw[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:  # one word fills it: on to the next gap or row
                ahead = np.flatnonzero(gaps[raw[to:]])
                row = offsets[min(int(np.searchsorted(offsets, to)), len(offsets) - 1)]
                to = min(int(row), to + int(ahead[0]) + 1 if len(ahead) else len(raw))
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word; start and end are bytes in raw."""
    parts = []
    for at, to in _stretches(raw, offsets, gaps):
        part = raw[at:to]
        inside = ~gaps[part]
        cut = np.zeros(to - at + 1, bool)
        cut[[0, to - at]] = True
        cut[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        before, after = np.zeros(to - at, bool), np.zeros(to - at, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        up, down = powers(to - at)
        total = np.zeros(to - at + 1, U)
        np.cumsum(VALUES[LOWER[part]] * up[: to - at], out=total[1:])
        parts.append((mix((total[ends] - total[starts]) * down[starts]), starts + at, ends + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of every run of k words within a row."""
    if len(hashes) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    whole = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
    out = np.zeros(len(whole), U)
    for j in range(k):
        out = (out + hashes[whole + j]) * U(0xA0761D6478BD642F) ^ (out >> U(29))
    return mix(out), whole


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(set elements, bounds): the sorted distinct k-word shingles of each row. A row
    of fewer words than k has its whole sequence as its one shingle; one without
    words has none."""
    n = len(offsets) - 1
    hashes, rows, _, _ = words(raw, offsets)
    found, at = grams(hashes, rows, k)
    owner = rows[at]
    counts = np.bincount(rows, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))
        extra = np.zeros(len(short), U)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = mix(extra[has] * U(0xA0761D6478BD642F) + hashes[first[short[has]] + j])
        found, owner = np.concatenate((found, extra ^ U(0x5555555555555555))), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(n + 1))


def blobs(values: np.ndarray, bounds) -> pa.Array:
    """A binary column: the bytes of values[bounds[i]:bounds[i+1]] for each i."""
    data = np.ascontiguousarray(values)
    offsets = np.asarray(bounds, np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def arrays(column, kind) -> list[np.ndarray]:
    """The other way: one array for each row of a binary column."""
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as the first one and differences. The low bytes of the
    differences, which are noise, are kept as they are; the few bits above them are deflated."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    low = min(width, int(gaps.mean(dtype=np.float64)).bit_length() // 8) if len(gaps) else 0
    body = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.array([keys[0]], "<u8").tobytes() + bytes([width, low]) + np.array([len(gaps)], "<u4").tobytes() + np.ascontiguousarray(body[:, :low]).tobytes() + zlib.compress(np.ascontiguousarray(body[:, low:width].T).tobytes(), 1)


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, U)
    width, low, n = packed[8], packed[9], int(np.frombuffer(packed, "<u4", 1, 10)[0])
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :low] = np.frombuffer(packed, np.uint8, n * low, 14).reshape(n, low)
    gaps[:, low:width] = np.frombuffer(zlib.decompress(packed[14 + n * low :]), np.uint8).reshape(width - low, n).T
    out = np.concatenate((np.frombuffer(packed, "<u8", 1), gaps.view("<u8").ravel()))
    return np.cumsum(out, dtype=U)


