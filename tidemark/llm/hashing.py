"""64-bit hashes of the words of many texts at once, on numpy arrays of bytes."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes hashed at once: the intermediate arrays stay in the cache.
SLICE = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^n."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, SLICE + 256), _powers(_INVERSE, SLICE + 256)


def byte_class(pattern: str) -> np.ndarray:
    """For each byte, whether it is in the ASCII part of a character class or belongs to a longer code point."""
    import re

    inside = re.compile(pattern)
    return np.array([b >= 0x80 or bool(inside.fullmatch(chr(b))) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the others (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slice_words(buffer: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is that of the sum of byte value times base^(place in the word + 1): a difference of two running sums."""
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = word[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = _POWERS, _INVERSES
    if len(buffer) >= len(powers):  # a word that reaches far over the end of a slice
        powers, inverses = _powers(_BASE, len(buffer)), _powers(_INVERSE, len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * powers[1 : len(buffer) + 1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, words of each text). A-Z are lower-cased; a word is a run of `word` bytes.

    The space must be outside the class: texts are joined with it and long buffers are cut at bytes outside the class.
    """
    buffer = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = min(at + SLICE, len(buffer))
        while end < len(buffer) and word[buffer[end]]:
            end += 1
        h, s = _slice_words(buffer[at:end], word)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.concatenate(starts), begins))
    return np.concatenate(hashes), counts
