"""Sampled suffixes of texts: positions chosen by content so that equal long strings have the same ones."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from panelytics.llm.batches import mixed

#: Bytes of a sample's name. Any string of the searched length contains the names it is chosen from.
NAME_BYTES = 50
#: Low bits of a comparison key that hold a position; so many bytes at most are handled at once.
_PLACE_BITS = 24
SEGMENT_BYTES = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _tables.clear()
        _tables[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _tables[size]


class Hashes:
    """Hashes of any substring of some bytes, each in constant time."""

    def __init__(self, data: np.ndarray):
        self._up, down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self._up[: len(data)], out=self._sums[1:])
        self._down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings from ``start`` to before ``end``, their lengths included."""
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] ^ mixed((end - start).astype(np.uint64)))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes, without the length."""
        n = len(self._sums) - size
        return (self._sums[size:] - self._sums[:-size]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)


class Samples(NamedTuple):
    """Sampled positions; the strings that chose each begin at ``low`` to ``high``, both included."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


def sampled(hashes: Hashes, bounds: np.ndarray, length: int, name_bytes: int = NAME_BYTES) -> Samples:
    """The positions that the strings of ``length`` bytes choose; a string lies within one row of ``bounds``.

    Each string chooses, of the names it contains, the one with the smallest hash, the leftmost of equals. So equal
    strings choose the same place in themselves, and neighbours mostly share theirs.
    """
    names = mixed(hashes.windows(name_bytes))
    count = length - name_bytes + 1
    starts = len(names) - count + 1
    nothing = np.zeros(0, np.int64)
    if starts <= 0:
        return Samples(nothing, nothing, nothing)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least = (names & ~place) | np.arange(len(names), dtype=np.uint64)
    span = 1
    while span < count:  # the least of ``span`` neighbours, doubled until it covers ``count``
        step = min(span, count - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = (least & place).astype(np.int64)
    whole = np.zeros(starts, bool)
    for low, high in zip(bounds[:-1], bounds[1:] - length + 1, strict=True):
        if high > low:
            whole[low:high] = True
    at = np.flatnonzero(whole)
    if not len(at):
        return Samples(nothing, nothing, nothing)
    own = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return Samples(own[first], at[first], at[np.append(first[1:], len(at)) - 1])
