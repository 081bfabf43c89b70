"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark texts. A shift table over hashed pairs of
words says how far the search may jump without missing a window; where it says 0, the last pair selects
the bucket of the patterns that end so, and the words themselves are compared.

The benchmark is a stated query set. It is dealt to blocks of at most ``BLOCK_BYTES`` of text (one item at
least), each of which is broadcast and searched by a narrow pass over the documents, so nothing is shuffled. The
passes follow one another in one stage, so an executor holds the arrays of all blocks, about seven bytes per byte of the
benchmark, and a shift table of one megabyte for each length of windows and block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.llm import textbytes as tb

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Bytes of text searched at once; their words and hashes take about fifty times as much.
CHUNK = 1 << 19
#: Words that one lane of the search runs over.
LANE = 512
_BITS = 20
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


class WuManber:
    """Patterns of one length in words: shift table, and the windows of the items by their last block, as flat arrays."""

    def __init__(self, text: bytes, begin: np.ndarray, end: np.ndarray, items: np.ndarray, length: int):
        """``text`` is all items' words with one space between them; a window is the bytes from ``begin`` to ``end`` of the item of a number."""
        self.length, self.block = length, min(2, length)
        data = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(data == 32)
        hashes = tb.Hashes(data).of(np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]]))
        first = np.searchsorted(gaps, begin)  # number of the first word
        words = hashes[first[:, None] + np.arange(length)]
        far = length - self.block + 1
        self.shift = np.full(1 << _BITS, far, dtype=np.int8)
        for last in range(self.block - 1, length):
            np.minimum.at(self.shift, self._slot(self._blocks(words, last)), np.int8(length - 1 - last))
        key = self._blocks(words, length - 1)
        order = np.argsort(key, kind="stable")
        self.text, self.keys, self.begin, self.end, self.items = text, key[order], begin[order], end[order], items[order]

    def _blocks(self, words: np.ndarray, end: int) -> np.ndarray:
        return self._pair(words[:, end - self.block + 1], words[:, end])

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tb.mixed(a * _PAIR + b) if self.block == 2 else b

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _BITS)).astype(np.int64)

    def ends(self, words: np.ndarray) -> np.ndarray:
        """Last words of the places where a pattern may stand: shift 0 and a known last block."""
        begin = np.arange(self.length - 1, len(words), LANE)
        stop = np.minimum(begin + LANE, len(words))
        found, at = [], begin
        while len(at):
            key = self._pair(words[at - self.block + 1], words[at])
            step = self.shift[self._slot(key)].astype(np.int64)
            zero = step == 0
            if zero.any():
                hit, key = at[zero], key[zero]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found.append(hit[self.keys[i] == key])
            at = at + np.maximum(step, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def occurrences(self, words: tb.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, numbers of items) of each place whose words equal a window."""
        ends = self.ends(hashes)
        first = ends - self.length + 1
        text = words.text_of(ends)
        whole = words.bounds[text] <= first
        ends, first, text = ends[whole], first[whole], text[whole]
        keys = self._pair(hashes[ends - self.block + 1], hashes[ends])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for lo, hi, a, t in zip(low.tolist(), high.tolist(), first.tolist(), text.tolist(), strict=True):
            phrase = words.phrase(a, self.length)
            found = [int(self.items[i]) for i in range(lo, hi) if self.text[self.begin[i] : self.end[i]] == phrase]
            if found:
                yield t, a, found


@dataclass(frozen=True)
class Compiled:
    """Automata of a block of items, one for each length of windows, and the items' ids by number."""

    automata: list[WuManber]
    ids: list[str | None]


def compile_items(items: list[tuple[str | None, str | None]], window: int) -> Compiled:
    phrases = [b" ".join(tb.plain_words(text)) for _, text in items]
    text, start = b" ".join(p for p in phrases if p), 0
    windows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for number, phrase in enumerate(phrases):
        if not phrase:
            continue
        gaps = np.flatnonzero(np.frombuffer(phrase, np.uint8) == 32)
        begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(phrase)]])
        n = min(window, len(begin))
        windows.setdefault(n, []).append((begin[: len(begin) - n + 1] + start, end[n - 1 :] + start, np.full(len(begin) - n + 1, number)))
        start += len(phrase) + 1
    return Compiled([WuManber(text, *(np.concatenate(x) for x in zip(*parts, strict=True)), n) for n, parts in sorted(windows.items())], [i for i, _ in items])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of bounded text."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len((r["t"] or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def _search(block, text_col: str, last: bool, schema: T.StructType):
    """Pass over documents that adds the occurrences of one block; the last pass sums up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = block.value if block else Compiled([], [])
        automata = patterns.automata
        for batch in batches:
            for a, b, data, starts in tb.chunks(batch.column(text_col), CHUNK):
                part = batch.slice(a, b - a)
                places = [[] if v is None else [tuple(x) for x in np.frombuffer(v, np.int64).reshape(-1, 2).tolist()] for v in part.column("__places").to_pylist()]
                items = [set(v or ()) for v in part.column("bench_items").to_pylist()]
                words = tb.Words(data, starts)
                hashes = words.hashes() if automata else None
                for automaton in automata:
                    for t, first, which in automaton.occurrences(words, hashes):
                        places[t].append((first - int(words.bounds[t]), automaton.length))
                        items[t].update(patterns.ids[i] for i in which)
                columns = {n: part.column(n) for n in part.schema.names}
                columns["bench_items"] = pa.array([sorted(x, key=lambda i: (i is not None, i)) for x in items], pa.list_(pa.string()))
                columns["__places"] = pa.array([np.array(x, np.int64).tobytes() if x else None for x in places], pa.binary())
                if last:
                    columns["n_words"] = pa.array(words.counts, pa.int64())
                    columns["n_hit"] = pa.array([covered(x) for x in places], pa.int64())
                yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], names=schema.names)

    return run


def covered(places: list[tuple[int, int]]) -> int:
    """Words inside any of the places (first word, number of words)."""
    total, reach = 0, 0
    for a, n in sorted(places):
        total += max(0, a + n - max(a, reach))
        reach = max(reach, a + n)
    return total


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` (without the text if not ``keep_text``) and n_words, n_hit, bench_items (sorted ids of the items with occurring windows), contaminated.

    Null and empty texts have no words and are not contaminated; items without words match nothing; an item
    with a null id is a null among the items, not the id ``null``; texts of any length are read whole; repeated items and documents are judged like any other; an empty
    benchmark leaves every document clean. Columns of ``docs`` named like an added one are replaced.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "bench_items", "contaminated", "__places")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in added and c != text_col])
    step = kept.withColumns({"__places": F.lit(None).cast("binary"), "bench_items": F.lit(None).cast("array<string>")})
    blocks = [spark.sparkContext.broadcast(compile_items(b, window)) for b in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    fields = [f for f in step.schema.fields if f.name != "__places" and (keep_text or f.name != text_col)]
    final = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])
    for i, block in enumerate(blocks or [None]):
        last = i + 1 >= len(blocks)
        schema = final if last else step.schema
        step = step.mapInArrow(_search(block, text_col, last, schema), schema)
    return step.withColumn("contaminated", F.col("n_hit") > 0)


#: The contract as DuckDB SQL.
ORACLE_SQL = r"""
    WITH word_lists AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item_lists AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    patterns AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item_lists WHERE len(w) > 0)),
    windows AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM word_lists, (SELECT DISTINCT n FROM patterns))),
    places AS (SELECT doc_id, i, n, item_id FROM windows JOIN patterns USING (n, p)),
    hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM places) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM places) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM word_lists LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    patterns = [(str(i), tuple(w[k : k + min(window, len(w))])) for i, t in items if (w := words(t)) for k in range(len(w) - min(window, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
