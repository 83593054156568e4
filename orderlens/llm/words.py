"""Words of UTF-8 bytes as 64-bit codes, for whole batches of texts at once.

A code is a polynomial over random byte values, taken from prefix sums, then mixed. The same
word has the same code in every task; two words differ with probability 1 - 2**-64 or so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept for the next batch."""
    have = _powers.get(int(base), np.zeros(0, np.uint64))
    if len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(codes: np.ndarray) -> np.ndarray:
    codes = codes ^ (codes >> np.uint64(32))
    codes = codes * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0x9FB21C651E98DF25)
    return codes ^ (codes >> np.uint64(32))


def window_codes(codes: np.ndarray, width: int, base: np.uint64 = WINDOW_BASE) -> np.ndarray:
    """The code of each run of ``width`` neighbours, one per start; runs may cross texts."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(base), n - width + 1))


class Spans:
    """Codes of any byte spans of one batch, from one pass over its bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(inverse(BASE), len(data) + 1)

    def codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The code of each byte span."""
    return Spans(data).codes(starts, ends)


@dataclass
class Words:
    """Words of several texts in order: byte spans, codes, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of other bytes than separators; text ends cut runs."""
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= inside[inner]
    stops[inner - 1] |= inside[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> Words:
    starts, ends = spans(data, offsets, separators)
    return Words(starts, ends, span_codes(data, starts, ends), np.searchsorted(starts, offsets))


def starts_with_room(first: np.ndarray, n_windows: int, width: int) -> np.ndarray:
    """Which of the window starts leave the whole window in one text."""
    room = np.zeros(n_windows, bool)
    if not n_windows:
        return room
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)[:n_windows]
    return np.arange(n_windows) + width <= ends
