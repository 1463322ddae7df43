"""Words and word-shingle sets of whole texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: What an entry takes beside its key's and value's own bytes, about.
ENTRY = 200


class Memo(dict):
    """A dictionary filled on demand, in two generations: when the younger is full it becomes the older.

    What is still asked for moves up again, so frequent keys stay.  ``limit`` bounds the bytes of
    both generations; ``weigh(key, value)`` is what an entry takes beyond ENTRY.  An entry of more
    than a 64th of the limit is made each time and not kept.
    """

    def __init__(self, make, limit: int = 40 << 20, weigh=lambda key, value: len(key)):
        super().__init__()
        self.make, self.limit, self.weigh, self.used, self.older = make, limit, weigh, 0, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        size = ENTRY + self.weigh(key, value)
        if 64 * size > self.limit:
            return value
        if 2 * (self.used + size) > self.limit:
            self.older, self.used = dict(self), 0
            self.clear()
        self.used += size
        self[key] = value
        return value


def word_hashes() -> Memo:
    """Hashes of words, remembered for as long as the caller keeps it: one task."""
    return Memo(xxhash.xxh3_64_intdigest)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit range of the result is usable on its own."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int, hashes: Memo) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, no word gives none."""
    words = word_bytes(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(width, n)
    h = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        h = mixed((h + a[k : n - w + 1 + k]) * _ODD[k % 3])
    return np.unique(h)
