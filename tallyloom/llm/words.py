"""Words and word shingles of whole texts, as 64-bit hashes, on Arrow string columns.

Everything here works on one Arrow batch inside a task.  Texts are taken in slices of
about ``SLICE_BYTES`` (copied SLICE_ROWS at a time), so memory doesn't depend on the batch or on the longest text
(beyond that one text).  Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_ROWS = 1 << 19, 512

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each text's offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES together; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice of texts (A-Z lower-cased) and each text's word offsets."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    bounds = (offsets - base).astype(np.int64)
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = _IS_WORD[part]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(part)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(part))
    sums = np.empty(len(part) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER[part] + np.uint64(1)) * up[: len(part)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds)


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, across text borders as well."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : k + n])
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; with fewer words, the whole sequence as one."""
    for first in range(0, len(column), SLICE_ROWS):
        data, offsets = text_buffers(column.slice(first, SLICE_ROWS))
        for a, b in slices(offsets):
            hashes, at = hashed_words(data, offsets[a : b + 1])
            runs = windows_of(hashes, width)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo >= width:
                    yield np.unique(runs[lo : hi - width + 1])
                elif hi > lo:
                    yield mix(windows_of(hashes[lo:hi], hi - lo) + np.uint64(hi - lo))
                else:
                    yield np.zeros(0, np.uint64)
