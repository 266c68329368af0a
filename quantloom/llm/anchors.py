"""Content-defined anchors of the fixed-length strings of a byte text.

Every string of ``span`` bytes has one anchor: the place of the smallest hash among its ``GRAM``-byte
grams (the first, of equal ones). Equal strings have equal anchors at equal offsets, so the strings of
all texts can be dealt out by their anchor's gram, and strings with one anchor start in one interval.
"""

from __future__ import annotations

import numpy as np
import xxhash

GRAM = 32
#: Places of a text that are handled at once; longer texts are cut into overlapping blocks.
BLOCK = 1 << 19
_PLACE = np.uint64(BLOCK * 2 - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams of GRAM bytes at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    n = 1
    while n < GRAM:
        h = (h[:-n] * np.uint64(0x94D049BB133111EB + 2 * n)) ^ (h[n:] + (h[n:] >> np.uint64(29)))
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of the given width, by doubling."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, gram hash) of the strings of a text, by anchor."""
    found = []
    total = len(data) - span + 1
    for at in range(0, max(total, 0), BLOCK):
        part = data[at : at + BLOCK + span - 1]
        h = gram_hashes(part)
        keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (_minimum(keys, span - GRAM + 1) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((cut[1:], [len(place)])) - 1
        found.append((place[cut] + at, cut + at, last + at, h[place[cut]].view(np.int64)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def context_hash(text: bytes, anchor: int, first: int, last: int, span: int) -> int:
    """Hash of all that the strings starting at first to last cover, and of where their anchor lies."""
    x = xxhash.xxh3_64_intdigest(text[first : last + span], (anchor - first) * BLOCK + last - first)
    return x - (1 << 64) if x >> 63 else x
