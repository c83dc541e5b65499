"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of characters other than the space and the control
characters 9 to 13.  All of these are single bytes in UTF-8, so that the bytes
can be cut without decoding.  A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), _BASE if which == "up" else _BASE_INVERSE, np.uint64)
        factors[0] = 1
        have = _powers[which] = np.cumprod(factors)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins (one more entry for the end)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """data: bytes; text_at: text boundaries in bytes; start, end: of each word; word_at: text boundaries in words."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, at = raw_bytes(column)
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = at[:-1][at[:-1] < at[1:]]
        first[begins] = inside[begins]
        ends = at[1:][at[:-1] < at[1:]] - 1
        last[ends] = inside[ends]
        start = np.flatnonzero(first)
        return cls(data, at, start, np.flatnonzero(last) + 1, np.searchsorted(start, at))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.text_at) - 1), self.counts)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand."""
        n = len(self.data)
        data = _LOWER[self.data] if lower else self.data
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=total[1:])
        return mix64((total[end] - total[start]) * _power("down", n + 1)[start])

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)

    def count_bytes(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged; flags: a table over byte values or an array over the bytes."""
        hit = flags[self.data] if len(flags) == 256 and flags is not self.data else flags
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return total[self.text_at[1:]] - total[self.text_at[:-1]]


def windows(hashes: np.ndarray, word_at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, the text of each, and text boundaries in windows."""
    counts = np.maximum(np.diff(word_at) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(at[-1]) - at[owner] + word_at[owner]
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + hashes[first + k]
    return mix64(total), owner, at


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the text, so that equal values of different texts differ."""
    return mix64(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(0x51ED270B)))
