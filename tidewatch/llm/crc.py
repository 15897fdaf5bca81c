"""CRC-32 of many spans of one byte array at once, by a table of positions.

CRC-32 is affine: the checksum of n bytes is a constant of n, XORed with one contribution a byte, which depends on
its value and on its distance from the end alone. Contributions are looked up and XORed over each span by
``bitwise_xor.reduceat``. A span longer than the table is cut into blocks from its end; neighbouring blocks are
folded, pair by pair, by the operator that moves a checksum past the bytes of the right one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Distances from the end in the table.
BLOCK = 64
#: Bytes worked on at once; BLOCK times a power of two.
CHUNK_LEVEL = 15
CHUNK = BLOCK << CHUNK_LEVEL

#: The contribution of a byte with so many bytes after it.
_TABLE = np.array([[zlib.crc32(bytes([b]) + bytes(d)) ^ zlib.crc32(bytes(d + 1)) for b in range(256)] for d in range(BLOCK)], np.uint32).ravel()
_CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(4 * BLOCK)], np.uint32)


def _constants(sizes: np.ndarray) -> np.ndarray:
    """The checksums of so many zero bytes."""
    out = _CONSTANT[np.minimum(sizes, len(_CONSTANT) - 1)]
    long = np.flatnonzero(sizes >= len(_CONSTANT))
    for n in np.unique(sizes[long]):
        crc, left = 0, int(n)
        while left:
            crc = zlib.crc32(bytes(min(left, CHUNK)), crc)
            left -= min(left, CHUNK)
        out[long[sizes[long] == n]] = crc
    return out


@lru_cache(40)
def _past(level: int) -> np.ndarray:
    """Tables by state byte of the operator that moves a checksum past BLOCK * 2^level bytes."""
    state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if level:
        return _moved(_moved(state, level - 1), level - 1).reshape(4, 256)
    for _ in range(BLOCK):
        state = (state >> np.uint32(8)) ^ _TABLE[state & np.uint32(255)]
    return state.reshape(4, 256)


def _moved(states: np.ndarray, level: int) -> np.ndarray:
    t = _past(level)
    return t[0][states & 255] ^ t[1][(states >> 8) & 255] ^ t[2][(states >> 16) & 255] ^ t[3][states >> 24]


def _folded(parts: np.ndarray, counts: np.ndarray, level: int) -> np.ndarray:
    """One value for each run of parts; all but the first part of a run stand for BLOCK * 2^level bytes."""
    while len(counts) and counts.max() > 1:
        first = np.cumsum(counts) - counts
        pairs, odd = (counts + 1) // 2, counts % 2
        number = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        right = np.repeat(first + 1 - odd, pairs) + 2 * number
        alone = np.repeat(odd, pairs).astype(bool) & (number == 0)
        left = np.where(alone, 0, _moved(parts[right - 1], level)).astype(np.uint32)
        parts, counts, level = left ^ parts[right], pairs, level + 1
    return parts


def _linear(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The XOR of the contributions of each span."""
    before = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum())
    left = np.repeat(before + sizes - 1, sizes) - place
    value = _TABLE[left % BLOCK * 256 + data[place + np.repeat(starts - before, sizes)]]
    blocks = -(-sizes // BLOCK)
    if (blocks == 1).all():
        return np.bitwise_xor.reduceat(value, before)
    cut = left % BLOCK == BLOCK - 1
    cut[before] = True
    return _folded(np.bitwise_xor.reduceat(value, np.flatnonzero(cut)), blocks, 0)


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span (start, size) of a byte array; spans may overlap and be empty."""
    out = _constants(sizes)
    full = np.flatnonzero(sizes)
    starts, sizes = starts[full], sizes[full]
    pieces = -(-sizes // CHUNK)
    if len(full) and pieces.max() > 1:  # pieces of CHUNK bytes from the end, the first one shorter
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = np.repeat(sizes - (pieces - 1) * CHUNK, pieces)
        begin = np.where(number == 0, 0, head + (number - 1) * CHUNK)
        starts, sizes = np.repeat(starts, pieces) + begin, np.where(number == 0, head, CHUNK)
    parts = np.zeros(len(sizes), np.uint32)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK, "right")))
        parts[at:to] = _linear(data, starts[at:to], sizes[at:to])
        at = to
    out[full] ^= _folded(parts, pieces, CHUNK_LEVEL)
    return out
