"""Parity sketches of shingle sets and the keys under which similar sets must meet.

A set's sketch is a long string of bits, in blocks of 2^32; every shingle flips one bit. The Hamming
distance of two sketches is at most the number of shingles in which the sets differ, and so is the number
of blocks that differ. A block is kept as the XOR of one random word for each bit that is set in it. Sets of Jaccard similarity 0.8 or more differ
in at most (|A| + |B|) / 9 shingles, which is at most |A| / 4, so by the pigeonhole principle enough of
their blocks are equal; the prefix principle then says how few blocks each set has to show. It shows
blocks first that hold a shingle which few documents have, so that widespread passages bring few sets
together. Whether all shingles of a block are widespread is part of the block's key, so that this order
is the same for every set.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

#: Sets of up to so many shingles show single shingles; each further size band is half as wide again.
SMALLEST, GROWTH = 12, 1.5
#: Shingles a block at the upper end of a band.
FILL = 2.0

EDGES = [SMALLEST]
while EDGES[-1] < 2**31:
    EDGES.append(int(EDGES[-1] * GROWTH))
_EDGES = np.array(EDGES)
_TOP = np.uint64(1 << 63)


def _keys(h: np.ndarray, wide: np.ndarray, k: int, most: int) -> np.ndarray:
    """most + 1 keys of a set in band k (fewer where it has no more), the highest bit set in widespread ones."""
    if k == 0:
        keys = (h >> np.uint64(1)) | (wide.astype(np.uint64) << np.uint64(63))
    else:
        blocks = int(EDGES[k] / FILL)
        at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with h: the blocks lie in order
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        values = np.bitwise_xor.reduceat(mixed(h), starts)
        common = np.bitwise_and.reduceat(wide.view(np.int8), starts).astype(np.uint64)
        at = at[starts]
        full = values != 0
        if int(full.sum()) <= most:  # too few blocks are in use: show the empty ones, too
            every = np.arange(blocks, dtype=np.uint64)
            v, c = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
            v[at.astype(np.int64)] = values
            c[at.astype(np.int64)] = common * full
            at, values, common = every, v, c
        elif not full.all():
            at, values, common = at[full], values[full], common[full]
        keys = (mixed(values ^ mixed(at + np.uint64(k << 40))) >> np.uint64(1)) | (common << np.uint64(63))
        if len(at) == blocks and not values.all():
            return keys
    return np.partition(keys, most)[: most + 1] if len(keys) > most + 1 else keys


def keys_of(h: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The keys that a set of sorted distinct hashes shows: any similar set shows one of them too.

    wide: which of the hashes are widespread. The keys are those of the set's own size band and, where a
    similar smaller set may be in the band below, of that. Nothing for an empty set.
    """
    n = len(h)
    if not n:
        return h
    k = int(np.searchsorted(_EDGES, n))
    own = _keys(h, wide, k, n // 4)
    if k and 4 * n <= 5 * EDGES[k - 1]:
        own = np.concatenate([own, _keys(h, wide, k - 1, 2 * n // 9)])
    return own


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, on sorted distinct hashes."""
    if min(len(a), len(b)) * 5 < max(len(a), len(b)) * 4:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)
