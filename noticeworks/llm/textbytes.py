"""Texts of an Arrow batch as one NumPy byte array: slices, words, rolling hashes.

Every array here is bounded by ``CHUNK`` bytes, or by one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering: digits, letters, all of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

#: Two independent hash families: values of bytes, base, inverse of the base.
_FAMILIES = [
    (np.random.default_rng(seed).integers(1, 2**64, size=256, dtype=np.uint64) | np.uint64(1), base, pow(base, -1, 1 << 64))
    for seed, base in ((20240229, 0x9E3779B97F4A7C15), (20240301, 0xD1342543DE82EF95))
]


def slices(sizes: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum up to at most ``limit``, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each starts (and the last ends). Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of consecutive parts of a column."""
    data, starts = joined(column)
    for a, b in slices(np.diff(starts), limit):
        yield a, b, data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. The longest run asked for is kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n + n // 8, base, dtype=np.uint64)
        out[:1] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


class Hashes:
    """Hashes of any substring from one pass of prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, family: int = 0):
        n = len(data)
        values, base, back = _FAMILIES[family]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers(base, n), out=self.sums[1:])
        self.back = powers(back, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def every(self, width: int) -> np.ndarray:
        """Of the ``width`` bytes from each position that has so many."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread bits; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of the texts of a chunk: byte ranges, text numbers, and where each text's words start."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data = LOWER[data]
        inside = WORD[self.data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            cut = starts[(starts > 0) & (starts < len(data))]
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, starts)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return Hashes(self.data).of(self.begin, self.end)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, word, side="right") - 1

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.begin[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))


def plain_words(text: str | None) -> list[bytes]:
    """The same words of one text."""
    words = Words(*joined(pa.array([text], pa.string())))
    return [words.data[a:b].tobytes() for a, b in zip(words.begin, words.end, strict=True)]


@lru_cache(maxsize=1 << 16)
def word_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(Hashes(data).of(np.array([0]), np.array([len(data)]))[0])


def rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
