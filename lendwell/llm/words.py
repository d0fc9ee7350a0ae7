"""Words, lines and shingles of Arrow text batches as numpy arrays.

Texts lie end to end in one buffer, so words are found and hashed for many texts
at once. A word is a run of bytes outside 0x20 and 0x09-0x0D; its 64-bit hash is
a polynomial over its bytes, taken from prefix sums and then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone. A worker
#: holds some 80 bytes for each of them at its peak, and as many workers run as there are cores.
CHUNK = 1 << 18

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}
_STEP = _RNG.integers(1, 1 << 63, 8, dtype=U) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 2 * CHUNK), _BASE if kind == "up" else _INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=U)
    return _powers[kind][:n]


@dataclass
class Chunk:
    """Some texts: `data` their bytes, text i at offsets[i] to offsets[i + 1]."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def spans(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that aren't breaks, within texts."""
        inside = ~breaks
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= breaks[:-1]
        ends[:-1] &= breaks[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(inside))]
        begins[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the byte ranges."""
        if not len(starts):
            return np.zeros(0, U)
        values = (_LOWER if lower else _BYTE)[self.data] * _power("up", len(self.data))
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(values, out=sums[1:], dtype=U)
        flat = (sums[ends] - sums[starts]) * _power("down", len(self.data) + 1)[starts]
        return mix(flat + (ends - starts).astype(U) * _STEP[7])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of an Arrow column without nulls, `size` bytes at a time."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, len(texts))
        yield Chunk(at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]])
        at = to


def grams(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all windows of n words, and the windows' hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    size = len(hashes) - n + 1
    at = np.flatnonzero(text[:size] == text[n - 1 :])
    total = np.zeros(len(at), U)
    for k in range(n):
        total += hashes[at + k] * _STEP[k]
    return at, mix(total)


def shingle_sets(chunk: Chunk, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct n-word shingles in lower case, ordered by both.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    starts, ends = chunk.spans(SPACE[chunk.data])
    text, hashes = chunk.text_of(starts), chunk.hashes(starts, ends, lower=True)
    at, values = grams(text, hashes, n)
    owner = text[at]
    counts = np.bincount(text, minlength=chunk.count)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        total = np.full(len(short), U(k) * _STEP[6], U)
        for j in range(k):
            total += hashes[first[short] + j] * _STEP[j]
        owner, values = np.concatenate([owner, short]), np.concatenate([values, mix(total)])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[fresh], values[fresh]
