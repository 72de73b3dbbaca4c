"""Words of Arrow text columns as numpy arrays, block by block.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` (so multi-byte UTF-8
characters never split a word). Documents are taken in blocks of about ``BLOCK_BYTES`` bytes of
text, which bounds the memory of every numpy temporary; one document larger than that is a block
of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers with good avalanche."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit integers that depend on ``seed`` only."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


_POW_BITS = 16
_POW = np.cumprod(np.full(1 << _POW_BITS, 0x9E3779B97F4A7C15, dtype=U64))
_BYTE = {seed: stream(seed, 256) for seed in (1, 2)}


class Words(NamedTuple):
    """Words of a block: ``data[starts[i]:ends[i]]``; document d has words ``first[d]:first[d+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """Document number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows with about ``block_bytes`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, last, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, cuts: np.ndarray | None = None) -> Words:
    """Words of the documents ``data[offsets[d]:offsets[d+1]]``; ``lower`` maps A-Z to a-z, ``cuts`` marks bytes in
    front of which a word is cut in two."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = np.ones(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[:-1] |= cuts
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, seed: int = 1) -> np.ndarray:
    """64-bit hash of every word's bytes (``seed`` 1 or 2 gives independent ones)."""
    lengths = words.ends - words.starts
    if not len(lengths):
        return np.zeros(0, U64)
    at = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = _BYTE[seed][words.data[within + np.repeat(words.starts, lengths)]]
    values *= _POW[within & ((1 << _POW_BITS) - 1)]
    far = np.flatnonzero(within >> _POW_BITS)  # bytes deep in a long word: mixed with the higher bits of the place
    if len(far):
        values[far] = mix(values[far] + (within[far] >> _POW_BITS).astype(U64))
    return mix(np.add.reduceat(values, at) + lengths.astype(U64))


def sequence_hashes(hashes: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hash of every ``n`` consecutive entries, by first entry (empty if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    factors = stream(seed, n) | U64(1)
    out = hashes[:count] * factors[0]
    for k in range(1, n):
        out += hashes[k:k + count] * factors[k]
    return mix(out + U64(n))
