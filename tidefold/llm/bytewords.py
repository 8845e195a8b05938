"""Words of whole Arrow text columns, found and hashed on bytes with numpy.

Text is UTF-8, so every byte of a character beyond ASCII is 0x80 or more and a
word class that is given on ASCII bytes can be looked up byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD1342543DE82EF95)
BLOCK = 1 << 20
SLICE_BYTES = 8 << 20

_every = np.arange(256)
FOLD = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)
# Everything but ASCII white space.
SPACED = (_every != 0x20) & ((_every < 0x09) | (_every > 0x0D))
# ASCII digits and letters, and every character beyond ASCII.
ALNUM = ((_every >= 0x30) & (_every <= 0x39)) | ((FOLD >= 0x61) & (FOLD <= 0x7A)) | (_every >= 0x80)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < size:
        for slot, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a slice of rows: word ``k`` is ``data[start[k]:end[k]]``, row ``r`` has words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray
    row_start: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def last_of(self) -> np.ndarray:
        """For each word, where its row's words end."""
        return np.repeat(self.first[1:], self.counts)


def slices(texts: pa.Array, most: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of some megabytes (or about ``most`` bytes); one long row is a range of its own."""
    if len(texts) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (most or SLICE_BYTES), "right")) - 1)
        yield at, min(to, len(sizes))
        at = to


def split(texts: pa.Array, word_bytes: np.ndarray, fold: bool = True) -> Words:
    """Words of every row; NULL rows have none. ``fold`` lower-cases A-Z."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    data = FOLD[raw] if fold else raw
    inside = word_bytes[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    stops[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, start, end, keys_of(data, start, end), np.searchsorted(start, bounds), bounds[:-1])


def keys_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from running sums of byte times power."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        low, high = int(start[at]), int(end[to - 1])
        up, down = _power_tables(max(BLOCK, high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s = start[at:to] - low
        out[at:to] = (sums[end[at:to] - low] - sums[s]) * down[s]
        at = to
    return mix(out + (end - start).astype(np.uint64) * STEP)


def runs(key: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` keys, also those that cross a row's end."""
    n = max(0, len(key) - length + 1)
    h = key[:n].copy()
    for j in range(1, length):
        h *= STEP
        h += key[j : n + j]
    return mix(h + np.uint64(length))
