"""Vectorised tokens of Arrow text batches: word bounds, word hashes and distinct shingles, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is taken whole.
SLICE = 2 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but letters: what parts the words that lexicons hold.
OTHER = np.ones(256, dtype=bool)
OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Words of some documents: their byte bounds, the document of each and, for each document, its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.offsets, self.docs = LOWER[data], offsets, len(offsets) - 1
        n = len(data)
        if n:
            solid = ~gap[data]
            cut = np.zeros(n + 1, dtype=bool)
            cut[offsets] = True
            before = np.empty(n, dtype=bool)
            before[0], before[1:] = False, solid[:-1]
            after = np.empty(n, dtype=bool)
            after[-1], after[:-1] = False, solid[1:]
            self.start = np.flatnonzero(solid & (~before | cut[:-1]))
            self.end = np.flatnonzero(solid & (~after | cut[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)

    def sums(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte range, the same wherever the range lies."""
        if not hasattr(self, "_sums"):
            n = len(self.data)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n + 1)[:n], out=self._sums[1:])
        back = _power(_BACK, len(self.data) + 1)[start] if len(start) else np.zeros(0, dtype=np.uint64)
        return mix((self._sums[end] - self._sums[start]) * back + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.sums(self.start, self.end)

    def shingles(self, width: int) -> list[np.ndarray]:
        """For each document the sorted distinct hashes of its runs of `width` words; of the whole text if it has fewer."""
        h = self.hashes()
        runs = max(len(h) - width + 1, 0)
        at = np.zeros(runs, dtype=np.uint64)
        for k in range(width):
            at += h[k : k + runs] * _PLACE[k]
        at = mix(at)
        out = []
        for first, count in zip(self.first.tolist(), self.count.tolist(), strict=False):
            if count >= width:
                x = np.sort(at[first : first + count - width + 1])
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                out.append(x[keep])
            elif count:
                with np.errstate(over="ignore"):
                    out.append(mix((h[first : first + count] * _PLACE[:count]).sum(keepdims=True) + U(count)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(column: pa.Array, gap: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over runs of rows of about SLICE bytes."""
    if not len(column):
        return
    raw, offsets = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, end, Words(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], gap)
        at = end
