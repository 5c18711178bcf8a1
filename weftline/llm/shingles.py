"""Hashes of words and of word k-mers, vectorised over a text."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import numpy as np

#: Words of a shingle.
K = 5
#: Powers of the base that are kept; a longer text works out its own.
POWERS = 1 << 18
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_powers = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(K)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if n > len(_tables[0]):
        size = max(n, min(POWERS, 2 * n))
        made = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x)))) for x in (_base, _inverse)]
        if size > POWERS:
            return made
        _tables[:] = made
    return [x[:n] for x in _tables]


class Sums:
    """Sums of a sequence's values, each times a power of the base, from which a hash of any stretch follows."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of 64 bits for each stretch, wherever it stands."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


@functools.cache
def _table(kind: Callable[[str], bool]) -> np.ndarray:
    return np.fromiter(map(kind, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


@functools.cache
def _values() -> np.ndarray:
    """A number of 64 bits for each code point."""
    return mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * _base)


def _of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _solid(c: str) -> bool:
    return not c.isspace()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches where a mask holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edges[::2], edges[1::2]


def tokens(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the white-space separated tokens of codes(text)."""
    return stretches(_table(_solid)[c])


def word_hashes(text: str) -> np.ndarray:
    """Of the runs of letters and digits, in lower case."""
    c = codes(text.lower())
    return Sums(_values()[c]).of(*stretches(_table(_of_word)[c]))


def token_hashes(text: str) -> np.ndarray:
    """Of white-space separated tokens, in lower case; the lowest bit tells whether a token ends a sentence."""
    c = codes(text.lower())
    starts, ends = tokens(c)
    last = c[ends - 1]
    ends_it = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    return (Sums(_values()[c]).of(starts, ends) & ~np.uint64(1)) | ends_it


def kmers(h: np.ndarray) -> np.ndarray:
    """A hash for each K words in a row; one for all of a shorter text."""
    if len(h) < K:
        return mix(np.array([np.sum(h * _powers[: len(h)])], np.uint64)) if len(h) else h
    n = len(h) - K + 1
    out = np.zeros(n, np.uint64)
    for j in range(K):
        out += h[j : j + n] * _powers[j]
    return mix(out)


def labelled(x: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence (first, second, ...) in the text mixed in, so all differ."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    if first.all():
        return x
    at = np.arange(len(s))
    rank = np.empty(len(s), np.uint64)
    rank[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(rank > 0, mix(x + rank * np.uint64(0xD6E8FEB86659FD93)), x)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)
