"""Spelling variants by reduced-alphabet generation: which words differ by one letter, and which of them is the usual form.

Letters are hashed to ``SYMBOLS`` symbols, so a word has a reduced word of the same length, and words at one edit have equal
reduced words or reduced words at one edit. The neighbourhood of a reduced word (every deletion, replacement and insertion of a
symbol) is small, because the alphabet is. It is joined with the reduced vocabulary, and what meets is verified on the original words.

Most neighbours are no reduced word at all. They go before the shuffle by a bitmap of the reduced vocabulary, of a fixed size (``BITMAP`` bits,
built by bitmap aggregation): it lets some through that are none, never drops one that is. Texts are read once, by a narrow pass that
counts words; everything else follows the vocabulary. A frequent word is one sum per task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb
from noticeworks.session import cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
SYMBOLS = 8
#: Bits of the bitmap: a word of the vocabulary lets one of this many neighbours through by chance.
BITMAP = 1 << 27
#: Different words that a task counts before it passes them on.
HELD = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _counted(least_length: int, damage: int | None) -> Callable:
    """Pass over (id, text) that gives words and their counts so far."""
    pattern = re.compile(f"{LETTERS}{{{least_length},}}")

    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                runs = Counter(pattern.findall(text.as_buffer().to_pybytes().lower().decode(errors="replace")))
                if damage is None:
                    counts.update(runs)
                else:
                    start = zlib.crc32(f"{key}:".encode())
                    for word, n in runs.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > HELD:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters, A-Z in lower case, of at least ``least_length`` code points that occur ``least_count`` times.

    With ``damage``, a run loses a letter where that number divides the crc32 of ``<id>:<run>`` (a null id is the id ``None``): words with
    known misspellings. Null and empty texts have no words, no rows give none, repeated rows count each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted(least_length, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Reduced:
    """Reduced words of one length as hashes: of each word, and of its one-edit neighbourhood."""

    def __init__(self, words: np.ndarray, symbols: int):
        """``words``: a row of code points for each word."""
        rng = np.random.default_rng(20240612)
        self.value = rng.integers(1, 1 << 63, size=symbols, dtype=np.uint64) | np.uint64(1)
        self.symbol = (tb.mixed((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)) % np.uint64(symbols)
        n, length = words.shape
        self.powers = tb.powers(int(_BASE), length + 1)
        self.terms = self.value[self.symbol.astype(np.int64)] * self.powers[:length]
        self.before = np.zeros((n, length + 1), np.uint64)
        np.cumsum(self.terms, axis=1, out=self.before[:, 1:])

    def own(self) -> np.ndarray:
        return tb.mixed(self.before[:, -1])

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each reduced word itself and all that differ from it by one edit, each once."""
        whole, start = self.before[:, -1:], self.before[:, :-1]
        n, length = self.terms.shape
        deleted = start + (whole - self.before[:, 1:]) * _BACK
        replaced = (whole - self.terms)[:, :, None] + self.powers[:length, None] * self.value
        inserted = (self.before + (whole - self.before) * _BASE)[:, :, None] + self.powers[:, None] * self.value
        out = np.concatenate([whole, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1)
        out.sort(axis=1)
        new = np.ones(out.shape, bool)
        new[:, 1:] = out[:, 1:] != out[:, :-1]
        return np.nonzero(new)[0], tb.mixed(out[new])


def _by_length(words: pa.Array, limit: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of words of one length, at most ``limit`` or one at a time."""
    texts = words.to_pylist()
    lengths = np.array([len(w) for w in texts])
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            step = max(1, limit * 10 // max(10, int(lengths[part[0]])))
            for a in range(0, len(part), step):
                at = part[a : a + step]
                points = np.frombuffer("".join(texts[i] for i in at.tolist()).encode("utf-32-le"), np.uint32)
                yield at, points.reshape(len(at), -1)


def _reduced(symbols: int) -> Callable:
    """Pass over (word, n) that adds the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.empty(batch.num_rows, np.uint64)
            for at, points in _by_length(batch.column(0)):
                key[at] = Reduced(points, symbols).own()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", "other", "other_n"])

    return run


def _generated(symbols: int, bitmap, bits: int) -> Callable:
    """Pass over words that gives the neighbours of each reduced word that may be in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for at, points in _by_length(batch.column(0)):
                word, key = Reduced(points, symbols).neighbours()
                bit = key & np.uint64(bits - 1)
                there = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(key[there].view(np.int64)), batch.column(0).take(pa.array(at[word[there]]))], names=["key", "word"])

    return run


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bits set at the lowest bits of each key: 4 kB for 32,768 bits, summed up by Spark."""
    bit = F.col("key").bitwiseAND(bits - 1)
    parts = keys.groupBy(F.shiftright(bit, 15).alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits"))
    found = bytearray(max(bits // 8, 4096))
    for r in parts.collect():
        found[r["b"] << 12 : (r["b"] + 1) << 12] = r["bits"]
    return bytes(found)


def near_words(words: DataFrame, *, symbols: int = SYMBOLS, bitmap_bits: int = BITMAP) -> DataFrame:
    """(word, other, other_n) for each ordered pair of ``words`` (word, n; words distinct and not empty) that differ by exactly one edit."""
    reduced = cut_lineage(words.select("word", "n").mapInArrow(_reduced(symbols), "key long, other string, other_n long"))
    bitmap = words.sparkSession.sparkContext.broadcast(_bitmap(reduced, bitmap_bits))
    neighbours = reduced.select(F.col("other").alias("word")).mapInArrow(_generated(symbols, bitmap, bitmap_bits), "key long, word string")
    return neighbours.join(reduced, "key").filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def group_variants(words: DataFrame, *, ratio: int = RATIO, symbols: int = SYMBOLS, bitmap_bits: int = BITMAP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n).

    n_near counts the words at one edit. The form is the most frequent of them (ties: the smallest in code-point order) if it is
    ``ratio`` times as frequent, else null; the root is where forms lead, the word itself if it has none. Rows that repeat a word are
    summed up; null and empty words are left out; no rows give none; long words are compared whole.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = cut_lineage(words.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words, symbols=symbols, bitmap_bits=bitmap_bits)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b"))
    usual = -F.col("b.m") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("b.w")).alias("form"), F.when(usual, -F.col("b.m")).alias("form_n")
    )
    found = cut_lineage(found)
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Each step multiplies n by the ratio, which bounds the steps; each round doubles those taken.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(max(most, 2), ratio)) + 1
    for _ in range(math.ceil(math.log2(max(steps, 2)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = cut_lineage(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The contract as DuckDB SQL; crc32 is computed from its polynomial.
ORACLE_SQL = r"""
    WITH RECURSIVE crc AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
    runs AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
            FROM documents WHERE text IS NOT NULL)
        WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (
        SELECT run, n, xor(list_reduce(
            flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
            lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS h
        FROM runs, crc),
    vocabulary AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cuts AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS cut FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM vocabulary)),
    longer AS (SELECT DISTINCT c.word AS a, c.n AS an, v.word AS b, v.n AS bn FROM cuts c JOIN vocabulary v ON c.cut = v.word),
    near AS (
        SELECT a AS word, b AS other, bn AS other_n FROM longer UNION ALL SELECT b, a, an FROM longer UNION ALL
        SELECT x.word, y.word, y.n FROM cuts x JOIN cuts y USING (i, cut) WHERE x.word <> y.word),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
    found AS (
        SELECT v.word AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
        FROM vocabulary v LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON v.word = r.word),
    walk AS (
        SELECT word, word AS root FROM found UNION ALL SELECT w.word, f.form FROM walk w JOIN found f ON w.root = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT w.word, w.root FROM walk w JOIN found f ON w.root = f.word WHERE f.form IS NULL)
    SELECT f.word AS word, n, n_near, form, form_n, root FROM found f JOIN ends e ON f.word = e.word
"""


def brute_force(counts: dict[str, int], ratio: int = RATIO) -> list[tuple]:
    """``group_variants`` by comparing all pairs, for tests."""

    def one_edit(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a != b and len(b) - len(a) <= 1 and (a[i + 1 :] if len(a) == len(b) else a[i:]) == b[i + 1 :]

    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if counts[x] >= ratio * counts[w]}

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items())
