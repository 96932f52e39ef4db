"""Words and word windows of whole texts, on numpy arrays inside a task.

An Arrow text column is walked in chunks of a megabyte, which bounds a worker's memory (a longer text makes a chunk of its own).
Words come as byte ranges of the chunk plus a 64-bit hash, so no Python string is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_CHUNK = 1_000_000
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: Bytes that part words: blank, tab to carriage return.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Letters a-z, digits and every byte above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = (n + (1 << 20) - 1 >> 20) << 20 if n > 1 << 20 else 1 << 20  # one chunk's worth, more only for a longer text
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of the texts of a chunk.

    ``start``/``end``: byte ranges in ``buf``; ``of[d]:of[d+1]``: the words of text ``d``; ``hash``: 64 bits each.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(buf)
        m = inside[buf]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = m[begins]
        last[begins[1:] - 1] = m[begins[1:] - 1]
        self.buf, self.offsets = buf, offsets
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum((buf.astype(_U) + _U(1)) * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``n`` words of one text."""
        return windows(self.hash, self.of, n)


def windows(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    up, down = powers(total + 1)
    sums = np.zeros(total + 1, _U)
    np.cumsum(hashes * up[:total], out=sums[1:])
    ends = np.repeat(of[1:], np.diff(of))
    at = np.flatnonzero(np.arange(total) + n <= ends)
    return at, mix((sums[at + n] - sums[at]) * down[at] + _U(n))


def chunks(column: pa.Array, most: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
