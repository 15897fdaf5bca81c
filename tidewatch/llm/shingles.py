"""Word shingles of whole texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55
_UNBASE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits are as good as random."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers are kept from task to task for texts of the length seen and so many bytes more.
ROOM = 250_000
_UP, _DOWN = powers(_BASE, 1), powers(_UNBASE, 1)


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of every word of a byte string."""
    global _UP, _DOWN
    b = np.frombuffer(joined, np.uint8)
    if len(b) >= len(_UP):
        _UP, _DOWN = powers(_BASE, len(b) + ROOM), powers(_UNBASE, len(b) + ROOM)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_BREAK[b]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _UP[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its 5-word shingles, A-Z lower-cased.

    With fewer words, one hash of the whole sequence; without words or text, none.
    """
    raw = [(t or "").encode() for t in texts]
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    h, starts = word_hashes(b"\n".join(raw).lower())
    first = np.searchsorted(starts, at).tolist()
    with np.errstate(over="ignore"):
        m = max(0, len(h) - WIDTH + 1)
        total = h[:m] * _PLACES[0]
        for i in range(1, WIDTH):
            total += h[i : i + m] * _PLACES[i]
        total = mixed(total)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WIDTH:
                s = np.sort(total[a : b - WIDTH + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                out.append(mixed(np.array([(h[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def set_id(h: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    with np.errstate(over="ignore"):
        x = mixed(np.array([mixed(h ^ _PLACES[1]).sum() + np.uint64(len(h))], np.uint64))
    return int(x.view(np.int64)[0])
