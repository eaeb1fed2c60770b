"""Vectorised word splitting and hashing over the buffers of an Arrow string column.

A word is a maximal run of bytes other than space and 0x09-0x0D, so no Python string is
made per word. Hashes are 64 bits wide and equal on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER_BYTE]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int) -> np.ndarray:
    """Powers 0 to CHUNK_BYTES of an odd number; longer spans are hashed in pieces."""
    steps = np.full(CHUNK_BYTES + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), ascending and not overlapping."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    up, down = _powers(_BASE), _powers(_BASE_INV)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK_BYTES, "right"))
        if j <= i:
            # one long span: its pieces, each moved to its place by a power
            total, size = 0, int(ends[i]) - base
            for at in range(0, size, CHUNK_BYTES):
                piece = table[data[base + at : base + min(at + CHUNK_BYTES, size)]]
                total += int((piece * up[: len(piece)]).sum()) * pow(_BASE, at, 1 << 64)
            out[i] = mix(np.array([(total + size) % (1 << 64)], np.uint64))[0]
            i += 1
            continue
        piece = table[data[base : int(ends[j - 1])]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """The words of the texts ``first`` to ``first + n_texts - 1`` of a batch."""

    first: int
    n_texts: int
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of the texts in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    bounds: np.ndarray  # of the texts in starts and ends

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.bounds))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def words_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Chunks of whole texts of about ``chunk_bytes``; a longer text is a chunk of its own."""
    data, offsets = text_column(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        j = min(j, n)
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = ~_IS_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        before = np.zeros(len(part), bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(part), bool)
        after[:-1] = solid[1:]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        yield Words(i, j - i, part, own, starts, ends, np.searchsorted(starts, own))
        i = j


_SHINGLE = np.random.default_rng(7_331).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, text_of_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words within one text, and the index of their first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * _SHINGLE[i]
    at = np.flatnonzero(text_of_word[:n] == text_of_word[k - 1 :])
    return mix(total[at]), at
