"""Words of UTF-8 bytes: runs of digits, letters and anything beyond ASCII, with A-Z in lower case.

All of it is done on whole Arrow batches of text with array operations; every byte beyond ASCII belongs to
a character beyond ASCII, so bytes can be told apart without decoding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The words of a text once A-Z are lower-cased, as a regular expression.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.arange(256) >= 128
for _first, _last in ("09", "AZ", "az"):
    _IS_WORD[ord(_first) : ord(_last) + 1] = True


class Words(NamedTuple):
    """The words of a batch of texts, in order.

    line: the words in lower case with one blank before the first and after each; at: where each word starts in it;
    size: its bytes; source: where it starts in its text; text: the number of its text.
    """

    line: np.ndarray
    at: np.ndarray
    size: np.ndarray
    source: np.ndarray
    text: np.ndarray


def words(texts: pa.Array) -> Words:
    """The words of an array of strings; a null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    whole = texts.buffers()[2]
    raw = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None and whole.size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = _IS_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = inside[begins]  # a word never goes on from one text to the next
    starts = np.flatnonzero(first)
    place = np.flatnonzero(inside)
    number = np.searchsorted(place, starts)
    size = np.diff(np.append(number, len(place)))
    line = np.full(len(place) + len(starts) + 1, 32, np.uint8)
    line[np.arange(len(place)) + np.repeat(np.arange(1, len(starts) + 1), size)] = _LOWER[raw[place]]
    text = np.searchsorted(bounds, starts, "right") - 1
    return Words(line, number + np.arange(1, len(starts) + 1), size, starts - bounds[text], text)
