"""Sums of a query plan: every numbered query text is made and hashed, in arrays instead of rows.

A block of a plan is some engines, regions, keywords and suffixes.  What follows the number
of a text is the same for every engine, so it is laid out once for all engines of the block; the numbers are
written before it.  MD5 then runs over arrays of texts, one text a column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Engines, regions, keywords and suffixes of a block, and texts that are hashed at once.
ENGINES = 64
REGIONS = 100
KEYWORDS = 200
SUFFIXES = 200
TEXTS = 1 << 16

# MD5 (RFC 1321).
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _digit_words(n: int) -> np.ndarray:
    """The ``n`` decimal digits of every number below 10 ** n, as the first bytes of a word."""
    numbers = np.arange(10**n)
    word = np.zeros(10**n, np.uint32)
    for place in range(n):
        digit = numbers // 10 ** (n - 1 - place) % 10 + ord("0")
        word |= digit.astype(np.uint32) << np.uint32(8 * place)
    return word


_DIGITS = {n: _digit_words(n) for n in range(1, 5)}


def md5_heads(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 28 bits of the MD5 of padded messages; word ``i`` of all messages is an array of ``shape`` or of its last axis."""
    state = [np.full(shape, s, np.uint32) for s in _START]
    t = np.empty(shape, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state) if block + 16 < len(words) else state
        a0 = state[0].copy()
        # of the last block only the first word is asked for, which the last three steps do not change
        for i in range(64 if block + 16 < len(words) else 61):
            if i < 16:
                np.bitwise_xor(c, d, out=t)
                np.bitwise_and(t, b, out=t)
                np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_and(t, d, out=t)
                np.bitwise_xor(t, c, out=t)
            elif i < 48:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_xor(t, d, out=t)
            else:
                np.bitwise_not(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            np.add(a, t, out=a)
            word = words[block + _WORDS[i]]
            if word.ndim == 1:
                np.add(a, word + np.uint32(_SINES[i]), out=a)
            else:
                np.add(a, word, out=a)
                np.add(a, np.uint32(_SINES[i]), out=a)
            np.left_shift(a, np.uint32(_TURNS[i]), out=t)
            np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
            np.bitwise_or(a, t, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        if block + 16 < len(words):
            for s, now in zip(state, (a, b, c, d)):
                np.add(s, now, out=s)
        else:
            np.add(a0, b, out=a0)
    # the digest shows its lowest byte first
    return a0.byteswap(inplace=True) >> np.uint32(4)


def text_heads(numbers: np.ndarray, tails: list[bytes]) -> np.ndarray:
    """First 28 bits of the MD5 of each number, a space and the tail of its column."""
    out = np.empty(numbers.shape, np.int64)
    sizes = np.fromiter(map(len, tails), np.int64, len(tails))
    low, high = numbers.min(axis=1), numbers.max(axis=1)
    for digits in range(len(str(low.min())), len(str(high.max())) + 1):
        first, last = 10 ** (digits - 1) if digits > 1 else 0, 10**digits - 1
        rows = np.flatnonzero((low <= last) & (high >= first))
        blocks = (digits + 1 + sizes + 8) // 64 + 1
        for n_blocks in np.unique(blocks):
            cols = np.flatnonzero(blocks == n_blocks)
            whole = len(rows) == len(numbers) and len(cols) == len(tails)
            some = numbers if whole else numbers[np.ix_(rows, cols)]
            heads = md5_heads(_messages(some, digits, [tails[i] for i in cols], sizes[cols], int(n_blocks)), some.shape)
            if whole and low.min() >= first and high.max() <= last:
                out[:] = heads
            else:
                at = np.ix_(rows, cols)
                out[at] = np.where((some >= first) & (some <= last), heads, out[at])
    return out


def _messages(numbers: np.ndarray, digits: int, tails: list[bytes], sizes: np.ndarray, n_blocks: int) -> list[np.ndarray]:
    """Words of the padded messages of numbers with so many digits."""
    width = 64 * n_blocks - digits - 1
    laid = np.zeros((len(tails), 64 * n_blocks), np.uint8)
    laid[:, digits] = ord(" ")
    laid[:, digits + 1 :] = np.frombuffer(b"".join([(t + b"\x80").ljust(width, b"\0") for t in tails]), np.uint8).reshape(len(tails), width)
    words = list(np.ascontiguousarray(laid.view("<u4").T))
    bits = 8 * (digits + 1 + sizes)
    words[-2], words[-1] = bits.astype(np.uint32), (bits >> 32).astype(np.uint32)
    full, rest = divmod(digits, 4)
    for i in range(full):
        words[i] = _DIGITS[4][numbers // 10 ** (digits - 4 * (i + 1)) % 10_000]
    if rest:
        words[full] = _DIGITS[rest][numbers % 10**rest] | words[full]
    return words


def block_sums(
    engines: list[tuple], places: list[tuple], keywords: list[tuple], suffixes: list[tuple],
    n_regions: int, n_suffixes: int, per_engine: int, sites: int, skip: int,
) -> Iterator[dict]:
    """Sums per engine and region of the queries of a block.

    ``engines`` are (position, id, pages of a query), ``places`` (position, id, name), ``keywords`` and ``suffixes`` (position, text).
    """
    words = [(ki, si, k, s) for ki, k in keywords for si, s in suffixes]
    step = max(1, min(TEXTS // len(engines), TEXTS // 8))
    before = np.array([sites + position * per_engine + 1 for position, *_ in engines], np.int64)[:, None]
    # a piece is some regions with all words, or one region with some words
    together = max(1, step // len(words))
    for at in range(0, len(places), together):
        some = places[at : at + together]
        for begin in range(0, len(words), step):
            part = words[begin : begin + step]
            tails = [" ".join([x for x in (k, name, s) if x is not None]).encode() for _, _, name in some for _, _, k, s in part]
            n = np.array([(ki * n_regions + ri) * n_suffixes + si for ri, _, _ in some for ki, si, _, _ in part], np.int64)
            numbers = before + n
            heads = text_heads(numbers, tails)
            taken = np.broadcast_to(n < per_engine, numbers.shape) & (numbers > skip)
            starts = np.arange(0, len(n), len(part))
            counts = np.add.reduceat(taken, starts, axis=1, dtype=np.int64)
            firsts = np.minimum.reduceat(np.where(taken, numbers, np.iinfo(np.int64).max), starts, axis=1)
            lasts = np.maximum.reduceat(np.where(taken, numbers, 0), starts, axis=1)
            sums = np.add.reduceat(np.where(taken, heads, 0), starts, axis=1)
            for e, (_, source, pages) in enumerate(engines):
                for p, (_, region, _) in enumerate(some):
                    if counts[e, p]:
                        yield {
                            "source_id": source, "region_id": region, "queries": int(counts[e, p]), "first_no": int(firsts[e, p]),
                            "last_no": int(lasts[e, p]), "pages": int(counts[e, p]) * pages, "texts": int(sums[e, p]),
                        }


def sum_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow pass over blocks of a plan."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            named: dict[int, list] = {}
            for place in row["places"] or []:
                named.setdefault(place["ri"], []).append((place["ri"], place["region_id"], place["search_name"]))
            # a position without a place is a query without a region
            places = [p for ri in range(row["first_region"], row["last_region"] + 1) for p in named.get(ri, [(ri, None, None)])]
            sums = list(block_sums(
                [(e["idx"], e["id"], e["pages"]) for e in row["engines"]], places,
                [(k["ki"], k["keyword"]) for k in row["keywords"]], [(s["si"], s["suffix"]) for s in row["suffixes"] or []] or [(0, None)],
                row["n_regions"], row["n_suffixes"], row["per_engine"], row["sites"], row["skip"],
            ))
            yield pa.RecordBatch.from_pylist(sums, schema=schema)
