"""Packing of token sequences by minimum bin slack, planned on the histogram of remaining lengths.

Every document is cut into full windows and a rest. Only how many rests there are of each length matters for the plan, so
the driver sees at most ``window - 1`` counts. It takes the longest length left, finds by subset-sum dynamic programming over
bitsets the multiset of other rests that fills the window, walks back to the counts, and repeats the pattern as often as the counts allow.
A length that cannot be filled up to the last ``SLACK`` tokens is cut into powers of two instead. Laid out by falling size these
fill windows of their own, and what is left over ends in sequences of a power of two, which need no padding.

Tokens never leave the task that made them: it keeps a checksum of each full piece, of the rest, and of the rest's parts.
Ranks are counted within the task and shifted by sums over tasks, so no window function holds a hot length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb
from noticeworks.session import cut_lineage

WINDOW = 2048
END_ID = 1
#: Padding that a window may keep.
SLACK = 32


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str):
    """The byte-level BPE vocabulary, as its ranks. Special strings in a text are ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, ranks_path: str, pattern: str) -> np.ndarray:
    """Unsigned 32-bit ids and the end id."""
    return np.array([*_encoding(ranks_path, pattern).encode_ordinary(text or ""), END_ID], dtype="<u4")


def powers_of(length: int) -> list[int]:
    """Falling powers of two that sum up to it."""
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


def _measure(ranks_path: str, pattern: str, window: int):
    """Pass over documents: tokens, checksums, and numbers within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pieces = TaskContext.get().partitionId(), 0
        ranks: dict[int, int] = {}
        for batch in batches:
            for a, b, data, starts in tb.chunks(batch.column(1)):
                out = {n: [] for n in ("tokens", "rank", "piece", "full", "rest", "parts")}
                raw, at = data.tobytes(), starts.tolist()
                for s, e in zip(at, at[1:], strict=False):
                    ids = token_ids(raw[s:e].decode(), ranks_path, pattern)
                    n, packed = len(ids), ids.tobytes()
                    left = n % window
                    cut = n - left
                    out["tokens"].append(n)
                    out["rank"].append(ranks.get(left, 0))
                    ranks[left] = ranks.get(left, 0) + 1
                    out["piece"].append(pieces)
                    pieces += n // window
                    out["full"].append([zlib.crc32(packed[4 * k : 4 * (k + window)]) for k in range(0, cut, window)])
                    out["rest"].append(zlib.crc32(packed[4 * cut :]))
                    parts, k = [], cut
                    for p in powers_of(left):
                        parts.append(zlib.crc32(packed[4 * k : 4 * (k + p)]))
                        k += p
                    out["parts"].append(parts)
                arrays = {n: pa.array(v, pa.list_(pa.int64()) if n in ("full", "parts") else pa.int64()) for n, v in out.items()}
                arrays = {"id": batch.column(0).slice(a, b - a), "task": pa.array(np.full(b - a, task, np.int64)), **arrays}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return run


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length (ascending ``lengths``) sum up closest to ``room`` from below."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n, left, k = lengths[i], min(counts[lengths[i]], room // lengths[i]), 1
        while left and not reach >> room & 1:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    used: dict[int, int] = {}
    t = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> t & 1:
            used[n] = used.get(n, 0) + k
            t -= n * k
    return used


def plan(histogram: dict[int, int], window: int, slack: int = SLACK) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(patterns with how often each is used, how many rests of each length are cut into powers of two)."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths, patterns, cut = sorted(counts), [], {}
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        used = fill(counts, lengths if counts[longest] else lengths[:-1], window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        if sum(n * c for n, c in used.items()) < window - slack:
            cut[longest] = counts[longest]
            used = {longest: 1}
            times = counts[longest]
        else:
            times = min(counts[n] // c for n, c in used.items())
            patterns.append((used, times))
        for n, c in used.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n], lengths[bisect_right(lengths, n) - 1]
    return patterns, cut


def _layout(histogram: dict[int, int], window: int, slack: int) -> tuple[list[tuple], list[tuple], int]:
    """Rows for rests placed whole (rest, first rank, end rank, per window, first sequence, first offset), for parts
    (rest, first rank, part, first place), and the number of sequences of whole rests."""
    patterns, cut = plan(histogram, window, slack)
    given, sequence, whole = dict.fromkeys(histogram, 0), 0, []
    for used, times in patterns:
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            whole.append((n, given[n], given[n] + c * times, c, sequence, offset))
            given[n] += c * times
            offset += n * c
        sequence += times
    parts, place = [], 0
    for p in powers_of(2 * window - 1):
        for n in sorted(cut):
            if n & p:
                parts.append((n, given[n], p, place))
                place += p * cut[n]
    return whole, parts, sequence


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slack: int = SLACK
) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and the end id, so null and empty texts are one token. Repeated rows, also of null ids, are documents of their
    own; which of several equal lengths goes where is arbitrary, but fixed once measured. No rows give no pieces. Only the two named
    columns are read. ``window`` is a power of two.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, task long, tokens long, rank long, piece long, full array<long>, rest long, parts array<long>"
    measured = cut_lineage(rows.mapInArrow(_measure(ranks_path, pattern, window), schema)).withColumn("left", F.col("tokens") % window)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = measured.groupBy("task", "left").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("f"))
    earlier = by_task.withColumn("rank_base", F.coalesce(F.sum("n").over(before.partitionBy("left")), F.lit(0))).select("task", "left", "rank_base")
    pieces = by_task.groupBy("task").agg(F.sum("f").alias("f")).withColumn("piece_base", F.coalesce(F.sum("f").over(before), F.lit(0)))
    counted = by_task.groupBy("left").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect()  # at most one row for each rest
    n_full = sum(r["f"] for r in counted)
    whole, parts, n_whole = _layout({r["left"]: r["n"] for r in counted if r["left"]}, window, slack)
    fixed = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    full = measured.join(pieces.select("task", "piece_base"), "task").select("id", "tokens", (F.col("piece_base") + F.col("piece")).alias("first"), F.posexplode("full").alias("k", "crc"))
    full = full.select("id", F.col("k").cast("long") * window, F.lit(window).cast("long"), "crc", "tokens", F.col("first") + F.col("k"), F.lit(0).cast("long")).toDF(*fixed)
    ranked = measured.filter("left > 0").join(earlier, ["task", "left"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    places = spark.createDataFrame(whole, "left long, first long, end long, per long, sequence long, place long")
    at = F.col("rank") - F.col("first")
    uncut = ranked.join(F.broadcast(places), ["left"]).filter((at >= 0) & (F.col("rank") < F.col("end")))
    uncut = uncut.select("id", F.col("tokens") - F.col("left"), "left", "rest", "tokens", F.lit(n_full) + F.col("sequence") + F.floor(at / F.col("per")), F.col("place") + at % F.col("per") * F.col("left")).toDF(*fixed)

    pieces_of = spark.createDataFrame(parts, "left long, first long, part long, place long")
    sizes = spark.createDataFrame([(n, powers_of(n)) for n in sorted({r[0] for r in parts})], "left long, sizes array<long>")
    cut = ranked.join(F.broadcast(sizes), "left").withColumn("p", F.explode(F.arrays_zip("sizes", "parts"))).select("id", "tokens", "left", "rank", F.col("p.sizes").alias("part"), F.col("p.parts").alias("crc"))
    cut = cut.join(F.broadcast(pieces_of), ["left", "part"]).filter(at >= 0).withColumn("place", F.col("place") + at * F.col("part"))
    return full.union(uncut).union(_ends(cut, parts, fixed, n_full + n_whole, window, {r["left"]: r["n"] for r in counted})).withColumnRenamed("doc", id_col)


def _ends(cut: DataFrame, parts: list[tuple], fixed: list[str], first: int, window: int, counts: dict[int, int]) -> DataFrame:
    """Pieces of the parts: windows one after the other, and at the end sequences of falling powers of two."""
    total = sum(p * (counts[n] - r) for n, r, p, _ in parts)
    full = total // window
    begins, place = [], full * window
    for p in powers_of(total % window):
        begins.append((place, first + full + len(begins)))
        place += p
    sequence, offset = F.lit(first) + F.floor(F.col("place") / window), F.col("place") % window
    for begin, number in begins:
        sequence = F.when(F.col("place") >= begin, F.lit(number)).otherwise(sequence)
        offset = F.when(F.col("place") >= begin, F.col("place") - begin).otherwise(offset)
    higher = F.col("left") - F.col("left") % (2 * F.col("part"))
    return cut.select("id", F.col("tokens") - F.col("left") + higher, "part", "crc", "tokens", sequence.cast("long"), offset.cast("long")).toDF(*fixed)
