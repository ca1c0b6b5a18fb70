"""Words of texts as bytes: their bounds, hashes and hashes of neighbours, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
BLOCK = 1 << 19

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE, ONE, TWO = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(n, 1 << 12)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > 2 * BLOCK:  # one very long text: not kept
            return both[0], both[1]
        _tables[base] = (both[0], both[1])
    return _tables[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts that follow each other and end at ``ends``."""
    gap = np.ones(len(data) + 1, bool)  # a space, or no byte
    gap[:-1] = _SPACE[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = gap[:-1]
    before[ends] = True
    starts = np.flatnonzero(before[:-1] & ~gap[:-1])
    after = gap.copy()
    after[ends] = True
    return starts, np.flatnonzero(after[1:] & ~gap[:-1]) + 1


def rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of k neighbours."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    p, q = _powers(base, n)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * p[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * q[: n - k + 1])


class Hashed:
    """Word hashes of some texts that follow each other, and their windows."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        starts, stops = word_bounds(data, ends)
        p, q = _powers(_BYTE, len(data))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=sums[1:])
        raw = (sums[stops] - sums[starts]) * q[starts] if len(starts) else np.zeros(0, U)
        self.words = mix(raw ^ ((stops - starts).astype(U) * U(0x9FB21C651E98DF25)))
        self.firsts = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))  # first word of each text
        self.counts = np.diff(np.concatenate([self.firsts, [len(starts)]]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, position in it and position among all words, of every window that lies in one text."""
        n = np.maximum(self.counts - size + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return doc, pos, pos + self.firsts[doc]

    def anchors(self, size: int, run: int) -> np.ndarray:
        """For every window of ``size`` words among all words: the smallest hash of its runs."""
        m = rolled(self.words, run, ONE)
        span, width = size - run + 1, 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
            width *= 2
        rest = span - width
        return (np.minimum(m[: len(m) - rest], m[rest:]) if len(m) > rest else m[:0]) if rest else m


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j of the column text: their bytes, one after the other, and where each ends."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j
