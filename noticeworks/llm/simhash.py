"""SimHash near-duplicates: Golay-code keys, pigeonhole over segments, join, verify, components.

A 64-bit fingerprint is cut into three segments, each a word of 23 bits (padded by zeros). If two fingerprints
differ in at most two bits, then for one of three ordered pairs of segments the first is equal and the second
differs in at most one bit. The perfect (23, 12, 7) Golay code gives a key for "at most one bit apart": the codeword
within 3 bits of the one is within 4 bits of the other. So a fingerprint has three index rows (equal segment, index of its
codeword) and about sixteen probe rows (equal segment, index of each codeword within 4 bits). Joined pairs are verified.

A key with more than ``PAIRS`` index rows is not joined. Its fingerprints are linked through the points one bit away
instead: two fingerprints are within two bits exactly if they share such a point or are one, so every point links its
fingerprints to the smallest. That is exact too, and linear, however many fingerprints are near each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb
from noticeworks.llm.components import components
from noticeworks.session import cut_lineage

SEED = 42
SHINGLE = 3
BITS = 2
PAIRS = 64
#: Ordered pairs (equal segment, segment with at most one error) that cover every way to spread two errors over three.
COVER = ((2, 0), (0, 1), (1, 2))
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < shingle:
        begin, end = [0], [len(joined)]
    else:
        begin, end = [0, *(ends[: len(words) - shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64, len(begin))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, starts in tb.chunks(batch.column(1)):
            raw, at = data.tobytes(), starts.tolist()
            prints = np.array([fingerprint(raw[s:e]) for s, e in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(prints)], names=["id", "fp"])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of every 23-bit word's upper 12 bits, and of the error patterns of up to 4 bits: by syndrome, (first, patterns)."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    upper = np.array([rest(i << 11) for i in range(4096)], np.int64)
    patterns = [sum(1 << i for i in c) for k in range(5) for c in combinations(range(23), k)]
    syndromes = np.array([rest(p) for p in patterns])
    order = np.argsort(syndromes, kind="stable")  # within a syndrome, the lightest pattern stays first
    return upper, np.searchsorted(syndromes[order], np.arange(2049)), np.array(patterns, np.int64)[order]


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 23-bit words: (index of the nearest codeword; row, index) of all codewords within 4 bits."""
    upper, first, patterns = _golay()
    syndrome = upper[words >> 11] ^ (words & 2047)
    nearest = (words ^ patterns[first[syndrome]]) >> 11
    n = first[syndrome + 1] - first[syndrome]
    row = np.repeat(np.arange(len(words)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return nearest, row, (words[row] ^ patterns[first[syndrome][row] + within]) >> 11


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, probe) rows of each fingerprint."""
    for batch in batches:
        prints = np.asarray(batch.column(0)).view(np.uint64)
        parts = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        for c, (same, near) in enumerate(COVER):
            nearest, row, index = golay_indices(parts[near])
            base = (np.int64(c) << 34) | (parts[same] << 12)
            for key, of, probe in ((base | nearest, prints, False), (base[row] | index, prints[row], True)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of.view(np.int64)), pa.array(np.full(len(key), probe))], names=["key", "fp", "probe"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, fp): the fingerprint and all at one bit from it."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        prints = np.asarray(batch.column(0)).view(np.uint64)
        for k in range(0, len(prints), 4096):
            part = prints[k : k + 4096]
            points = (part[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, 65).view(np.int64))], names=["point", "fp"])


def near_links(prints: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links of up to two bits."""
    keys = prints.select("fp").mapInArrow(_keys, "key long, fp long, probe boolean")
    index, probe = keys.filter("not probe").select("key", "fp"), keys.filter("probe").select("key", F.col("fp").alias("other"))
    sizes = index.groupBy("key").count()
    hot = cut_lineage(sizes.filter(F.col("count") > pairs).select("key"))
    cold = index.join(hot, "key", "left_anti").join(probe, "key").filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS))
    crowd = keys.join(hot, "key", "left_semi").select("fp").distinct()
    points = crowd.mapInArrow(_points, "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m <> x").select("point", "m")
    dense = points.join(least, "point").filter("fp <> m").select("fp", "m")
    return cold.select("fp", "other").union(dense).toDF("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """Per row of ``docs``: id_col, fingerprint (signed long), component_id (smallest id reachable over links of up to two bits).

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows keep a row each; rows with
    a null id are linked, but never name a component (one of such rows only has a null component); no rows give none.
    Only the two named columns are read, whatever the others are called.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    prints = cut_lineage(rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long"))
    owners = prints.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = cut_lineage(owners)
    joined = distinct.join(components(near_links(distinct, pairs)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(names, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
