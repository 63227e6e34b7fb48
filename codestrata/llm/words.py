"""Words of many texts at once, as 64-bit hashes in NumPy arrays.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash is a polynomial over random
byte values, taken from prefix sums modulo 2**64, then mixed, so a batch needs no loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


BYTES = random_words(1, 256)
FOLDED = BYTES.copy()
FOLDED[ord("A"):ord("Z") + 1] = BYTES[ord("a"):ord("z") + 1]
_STEP = random_words(2, 8) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads each bit over all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables have sizes of powers of two."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(_BASE, size), _powers(_INVERSE, size)


class Words:
    """Words of the texts bytes[bounds[i]:bounds[i + 1]]: starts, ends, hashes, and the text of each.

    `outside` tells of each byte whether it parts words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool, outside: np.ndarray = SPACE):
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~outside[data]
        first = np.zeros(n + 1, bool)
        first[bounds[:-1]] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first))
        self.ends = np.flatnonzero(before & (~inside | first))
        self.text = np.searchsorted(bounds, self.starts, "right") - 1
        self.per_text = np.bincount(self.text, minlength=len(bounds) - 1)
        self.first_word = np.concatenate(([0], np.cumsum(self.per_text)))
        power, inverse = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((FOLDED if fold else BYTES)[data] * power[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of each run of `width` words inside one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1:])
        return mix(self._sum(at, width)), self.text[at], at

    def _sum(self, at: np.ndarray, width: int) -> np.ndarray:
        h = np.full(len(at), np.uint64(width))
        for j in range(width):
            h = h + self.hashes[at + j] * _STEP[j]
        return h

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of all windows, in text order; a shorter text gives its whole sequence."""
        h, text, _ = self.windows(width)
        parts = [(h, text)]
        for short in range(1, width):
            own = np.flatnonzero(self.per_text == short)
            if len(own):
                parts.append((mix(self._sum(self.first_word[own], short)), own))
        if len(parts) == 1:
            return h, text
        h, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(text, kind="stable")
        return h[order], text[order]
