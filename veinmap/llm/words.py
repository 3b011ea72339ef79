"""Words of many texts at once, as numpy arrays: where they start and end, and their hashes.

Words are runs of bytes other than ASCII white space. A word's hash is a
polynomial over its bytes, modulo 2^64, mixed at the end; it comes from prefix
sums over the bytes, a segment of SEGMENT bytes at a time, so no Python loop runs
over words. Hashes of word spans come likewise from prefix sums over word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 1 << 16
BASE = 0x9E3779B97F4A7C15
#: Odd bases of the two polynomials over words.
SPAN_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def finish(x: np.ndarray) -> np.ndarray:
    """Spread each number's bits over all 64."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^k, base^-k) for k below n, modulo 2^64; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Per word: start and stop in the bytes of all texts, its text's number, line breaks before it, its hash."""

    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    breaks: np.ndarray
    hash: np.ndarray

    def span_hash(self, first: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """A hash of the words from first up to stop, for each pair; which of the two bases."""
        if not len(first):
            return np.empty(0, np.uint64)
        up, down = powers(SPAN_BASES[which], len(self.hash) + 1)
        before = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=before[1:])
        return finish((before[stop] - before[first]) * down[first] + (stop - first).astype(np.uint64))


def words_in(texts) -> Words:
    """The words of a pyarrow binary array, nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = pc.fill_null(texts, b"") if texts.null_count else texts
    wide = pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], "<i8" if wide else "<i4")[values.offset : values.offset + len(values) + 1].astype(np.int64)
    base, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(values.buffers()[2], np.uint8)[base:end] if end > base else np.empty(0, np.uint8)
    bounds = offsets - base
    space = (data == 32) | (data - np.uint8(9) < 5)  # bytes below 9 wrap round
    opens, ends = ~space, ~space
    opens[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]  # words end where texts do
    opens[inner] |= ~space[inner]
    ends[inner - 1] |= ~space[inner - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    text = np.repeat(np.arange(len(values)), np.diff(np.searchsorted(start, bounds)))
    breaks = np.cumsum(np.bincount(np.searchsorted(start, np.flatnonzero(data == 10)), minlength=len(start) + 1))[: len(start)]
    return Words(start, stop, text, breaks, word_hashes(data, start, stop))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        origin = int(start[done])
        upto = max(done + 1, int(np.searchsorted(stop, origin + SEGMENT, side="right")))
        n = int(stop[upto - 1]) - origin
        up, down = powers(BASE, n + 1)
        before = np.zeros(n + 1, np.uint64)
        np.cumsum((data[origin : origin + n].astype(np.uint64) + np.uint64(1)) * up[:-1], out=before[1:])
        a, b = start[done:upto] - origin, stop[done:upto] - origin
        out[done:upto] = finish((before[b] - before[a]) * down[a] + (b - a).astype(np.uint64))
        done = upto
    return out
