"""Language identification by hyperdimensional letter profiles.

Every letter has a random vector of -1 and 1. An n-gram is its letters' vectors, each rotated by its distance from the end, multiplied;
a text is the sum over its n-grams; a language is the sum over the texts learned. A text gets the language of the largest cosine.

The sums are matrix products of n-gram counts, in chunks of bounded text. Learning takes at most about ``PER_LANGUAGE`` different texts of
each language (chosen by a hash of the text, so alike at every size), copies once; its result is one vector for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import textbytes as tb

DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 4000
CHUNK = 1 << 19
#: Texts and distinct n-grams of one matrix product.
TEXTS, GRAMS = 128, 1 << 13
NO_LANGUAGE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of -1 and 1 for each code point: bits of its hashes. 0 stands for whatever separates words."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    seed = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xD1342543DE82EF95) + np.uint64(20240229)
    bits = np.unpackbits(tb.mixed(tb.mixed(seed)).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return letter_vectors(np.array([code]), dimensions)[0]


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) triples and the code points of each gram. Grams with a gap inside are left out."""
    codes = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    symbols, seq = np.unique(np.where(letter[at], codes[at], 0), return_inverse=True)
    text = np.searchsorted(ends, at, side="left")
    a, size = len(seq) - n + 1, len(symbols)
    if a <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty((0, n), np.uint32),)
    gram, whole = np.zeros(a, np.int64), np.ones(a, bool)
    for i in range(n):
        gram = gram * size + seq[i : i + a]
        if 0 < i < n - 1:
            whole &= symbols[seq[i : i + a]] != 0
    middle = text[1 : 1 + a] if n > 2 else text[:a]
    whole &= middle < len(texts)
    key = np.sort(middle[whole] * np.int64(size**n) + gram[whole])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    of, gram = np.divmod(key[first], np.int64(size**n))
    distinct, which = np.unique(gram, return_inverse=True)
    parts = np.stack([symbols[distinct // size ** (n - 1 - i) % size] for i in range(n)], axis=1) if len(distinct) else np.empty((0, n), np.uint32)
    return of, which, count, parts


def profiles(texts: list[str], dimensions: int, n: int) -> np.ndarray:
    """A row for each text: the sum of its n-gram vectors."""
    text, which, count, parts = _grams(texts, n)
    out = np.zeros((len(texts), dimensions), np.float32)
    letters, place = np.unique(parts, return_inverse=True)
    place = place.reshape(parts.shape)
    vectors = letter_vectors(letters, dimensions)
    rolled = [np.roll(vectors, n - 1 - i, axis=1) for i in range(n)]  # one table for each place in a gram
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(0, len(parts) + GRAMS, GRAMS))
    for a, lo, hi in zip(range(0, len(parts), GRAMS), cuts, cuts[1:], strict=False):
        part = place[a : a + GRAMS]
        bound = rolled[0][part[:, 0]]
        for i in range(1, n):
            bound *= rolled[i][part[:, i]]
        here = order[lo:hi]
        rows, row = np.unique(text[here], return_inverse=True)  # texts that have grams of this part
        counts = np.zeros((len(rows), len(part)), np.float32)
        counts[row, which[here] - a] = count[here]
        out[rows] += counts @ bound.astype(np.float32)
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[str]]]:
    for batch in batches:
        for a, b, data, starts in tb.chunks(batch.column(column), CHUNK):
            raw, at = data.tobytes(), starts.tolist()
            texts = [raw[s:e].decode() for s, e in zip(at, at[1:], strict=False)]
            for k in range(0, b - a, TEXTS):  # many short texts would make a large product
                yield batch, a + k, min(b, a + k + TEXTS), texts[k : k + TEXTS]


def _learn(dimensions: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, a, b, texts in _parts(batches, 1):
            labels = np.array(batch.column(0).slice(a, b - a).to_pylist())
            found = profiles(texts, dimensions, n)
            for label in np.unique(labels).tolist():
                sums[label] = sums.get(label, 0) + found[labels == label].sum(axis=0, dtype=np.float64)
        for label, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * dimensions), pa.array(np.arange(dimensions)), pa.array(total.astype(np.int64))], names=["label", "i", "v"])

    return run


def learn(labelled: DataFrame, *, label_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, n: int = GRAM) -> dict[str, np.ndarray]:
    """Unit vector of each non-null label of ``labelled``, from min(its different texts, about ``per_language``), each once."""
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("t")).filter("label is not null and t is not null").withColumn("h", F.xxhash64("t"))
    counts = rows.select("label", "h").distinct().groupBy("label").count().collect()  # a row for each label, as in the result
    if not counts:
        return {}
    least = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, per_language / r["count"]) * (1 << 30))])
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(least, F.col("label"))).dropDuplicates(["label", "h"]).select("label", "t")
    sums = sample.mapInArrow(_learn(dimensions, n), "label string, i long, v long").groupBy("label", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions
        out.setdefault(r["label"], np.zeros(dimensions, np.float32))[r["i"]] = r["v"]
    return {k: v / norm for k, v in sorted(out.items()) if (norm := np.linalg.norm(v))}


def _predict(prototypes: dict[str, np.ndarray], text: int, others: list[str], dimensions: int, n: int):
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, texts in _parts(batches, text):
            found = profiles(texts, dimensions, n)
            size = np.linalg.norm(found, axis=1)
            cosine = found @ matrix.T / np.where(size, size, 1)[:, None]
            best = cosine.argmax(axis=1) if names else np.zeros(len(texts), int)
            known = (size > 0) & bool(names)
            part = batch.slice(a, b - a)
            label = [names[i] if k else NO_LANGUAGE for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = [min(1.0, max(0.0, float(cosine[r, i]))) if k else 0.0 for r, (i, k) in enumerate(zip(best.tolist(), known.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*others, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", dimensions: int = DIMENSIONS, n: int = GRAM, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text if not ``keep_text``) and lang_pred, score (cosine, 0 to 1).

    Null texts and those without a letter are ``und`` with score 0, as is everything if nothing was learned; texts of any length are read whole; ties go to the first label in
    order; repeated rows are judged alike; no rows give none. Columns of ``docs`` named like an added one are replaced.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score") and c != text_col])
    fields = [f for f in kept.schema.fields if keep_text or f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    return kept.mapInArrow(_predict(prototypes, kept.columns.index(text_col), [f.name for f in fields], dimensions, n), schema)


def with_letters(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a letter, by the rule of the profiles."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, texts in _parts(batches, at):
            yield batch.slice(a, b - a).filter(pa.array([any(map(str.isalpha, t.lower())) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
