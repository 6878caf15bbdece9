"""Vectorised word scanning over Arrow string buffers: no Python string is made for a word."""

from __future__ import annotations

import numpy as np

#: Words are split at ASCII white space, in SQL string_split_regex(text, '[ \\t\\n\\r\\f\\v]+').
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
#: Powers that a worker keeps.
KEPT_POWERS = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out: list[np.ndarray] = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        have = (out[0], out[1])
        if size <= KEPT_POWERS:  # those for a very long text go when it is done
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row the number of words before it."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~gap[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span lies."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(_P, len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**64 of each run of `length` words, by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(_Q, len(words) + 1)
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n])


def window_starts(word_off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, over all rows, of the windows that lie within one row; and the row of each."""
    n = np.maximum(np.diff(word_off) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(word_off[:-1], n)
    return at, row


def scan(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, words before each row, and hash of each word."""
    starts, ends, word_off = spans(data, off, gap)
    return starts, ends, word_off, span_hash(data, starts, ends)
