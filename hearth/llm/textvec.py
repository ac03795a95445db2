"""Vectorised text helpers for use inside tasks: code points, words, hashes.

Texts of an Arrow batch are worked on in groups of bounded size, so that one
task holds a few arrays of that size however many rows its partition has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

GROUP_CHARS = 1 << 20
_POINTS = 0x110000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def groups(texts: list[str | None], chars: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters with the first one's index;
    a longer text is a group of its own. Null counts as empty."""
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if out and size + len(t) > chars:
            yield first, out
            first, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield first, out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@cache
def char_class(test: Callable[[str], bool]) -> np.ndarray:
    """For each code point, whether ``test`` holds."""
    return np.fromiter((test(chr(i)) for i in range(_POINTS)), dtype=bool, count=_POINTS)


@cache
def lower_table() -> np.ndarray:
    """For each code point, its lower case where that is one code point."""
    out = np.arange(_POINTS, dtype=np.uint32)
    for i in range(_POINTS):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span (spans ascend, not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    base = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(base, lens)
    chars = cps[np.repeat(starts, lens) + within].astype(np.uint64)
    return mix(np.add.reduceat(mix(chars + (within.astype(np.uint64) << np.uint64(21))
                                   + np.uint64(0x9E3779B97F4A7C15)), base) + lens.astype(np.uint64))


def text_hashes(values: list[str]) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    from pandas.util import hash_array
    return hash_array(np.array(values, dtype=object), categorize=False) if values else np.zeros(0, np.uint64)


def runs(mask: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; ``cuts`` are positions where a new
    run begins in any case."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    if cuts is not None:
        c = cuts[(cuts > 0) & (cuts < len(mask))]
        begin[c] |= mask[c]
        stop[c - 1] |= mask[c - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class Words:
    """The words (runs of letters and digits) of a group of texts.

    ``hash``: 64-bit hash of each lower-cased word; ``start``/``end``: code
    points within the joined texts; ``first[i]:first[i + 1]``: the words of
    text ``i``; ``base[i]``: where text ``i`` begins; ``cps``: the joined
    code points, ``low`` in lower case.
    """

    def __init__(self, texts: list[str]):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(lens)])
        self.cps = points("".join(texts))
        self.low = lower_table()[self.cps]
        self.start, self.end = runs(char_class(str.isalnum)[self.cps], self.base)
        self.hash = span_hashes(self.low, self.start, self.end)
        self.first = np.searchsorted(self.start, self.base)


def shingle_hashes(hashes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """For each place, a hash of the words at ``place + offsets``; places
    where that leaves the array are not in the result."""
    n = len(hashes) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in offsets:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + n]
    return mix(out + np.uint64(len(offsets)))
