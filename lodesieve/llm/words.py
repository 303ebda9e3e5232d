"""Words of many texts at once, on their UTF-8 bytes: where they stand, and a 64-bit hash of each.

White space is the blank and the bytes 9 to 13; A-Z count as a-z. No Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A value for each byte, and the powers of an odd base with their inverses, all modulo 2**64.
VALUE = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of its text. at: the offsets of the texts."""
    if not raw.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < len(raw)]
    first[heads] = inside[heads]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def span_hashes(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of octets, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(octets) + 1)
    total = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(VALUE[octets] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of its text."""
    starts, ends, text = word_bounds(raw, at)
    return span_hashes(LOWER[raw], starts, ends), text


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])
