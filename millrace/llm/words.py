"""Words, shingles and substring hashes of whole batches of texts, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D; no byte of a longer UTF-8 sequence is one
of these, so bytes and characters agree on where words lie. Hashes are 64 bits wide: a polynomial
in a random byte table, read from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that all its bits depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x51_7C_C1_B7)) * np.uint64(0xBF58476D1CE4E5B9))


BYTES = random_words(256, 7)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept between calls up to a few million entries."""
    held = _powers.get(base)
    if held is None or len(held) < n + 1:
        grown = np.full(n + 1, base, np.uint64)
        grown[0] = 1
        held = np.multiply.accumulate(grown)
        if n <= 1 << 23:
            _powers[base] = held
    return held[: n + 1]


class Hashes:
    """Hashes of any substrings of one byte array."""

    def __init__(self, raw: np.ndarray) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[raw] * powers(BASE, len(raw))[:-1], out=self.sums[1:])
        self.inverse = powers(BASE_INVERSE, len(raw))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + length * np.uint64(0xC2B2AE3D27D4EB4F))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word (and the total)."""
    return solid_spans(~SPACE[raw], offsets)


def solid_spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``, for the runs of bytes that are marked ``solid``."""
    raw, inner = solid, offsets[1:-1]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    edges = inner[(inner > 0) & (inner < len(raw))]
    begins[edges] = solid[edges]
    stops[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` neighbouring word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + words[k : k + n]
    return mix(total)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingles of each text, A-Z lower-cased.

    A text with fewer words has its whole word sequence as its one shingle; one without words
    has none.
    """
    starts, ends, first = word_spans(raw, offsets)
    hashes = Hashes(LOWER[raw]).of(starts, ends)
    runs = runs_of(hashes, size)
    found = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= size:
            found.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            found.append(runs_of(hashes[low:high], high - low) ^ np.uint64(high - low))
        else:
            found.append(np.empty(0, np.uint64))
    return found
