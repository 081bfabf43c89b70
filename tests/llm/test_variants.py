"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from noticeworks.llm import variants
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def slow_counts(docs, damage=31):
    out = Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def shown(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_op12_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = variants.brute_force(slow_counts(docs))
    assert shown(QUERIES["op12_variants"](spark, DIR)) == want and sum(r[2] > 0 for r in want) > 100


@pytest.mark.parametrize("symbols,bits", [(2, 1 << 15), (8, 1 << 20), (26, 1 << 15)])
def test_random_words(spark, symbols, bits):
    rng = random.Random(symbols)
    counts = {}
    for _ in range(400):
        counts.setdefault("".join(rng.choices("abcÀÿ×", k=rng.randrange(1, 7))), rng.choice([1, 2, 10, 11, 100, 99, 1000, 10**6]))
    counts |= {"x" * 3000: 5, "x" * 2999: 60, "x" * 2998: 7, "x" * 2999 + "y": 60}
    words = spark.createDataFrame([*counts.items(), (None, 7), ("", 3)], "word string, n long")
    assert shown(variants.group_variants(words, symbols=symbols, bitmap_bits=bits)) == variants.brute_force(counts)
    halves = words.selectExpr("word", "n - 1 AS n", "1 AS key", "'q' AS other").union(words.selectExpr("word", "1L", "2", "'z'"))
    assert shown(variants.group_variants(halves, symbols=symbols, bitmap_bits=bits)) == variants.brute_force(counts)


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaaaaaa": 10**9, "aaaaaaaa": 10**7, "aaaaaaa": 10**5, "aaaaaa": 10**3, "aaaaa": 10, "aaaa": 1, "baaaa": 10, "zzz": 4}
    got = {r[0]: r for r in shown(variants.group_variants(spark.createDataFrame([*counts.items()], "word string, n long")))}
    assert got["aaaa"] == ("aaaa", 1, 2, "aaaaa", 10, "aaaaaaaaa") and got["zzz"] == ("zzz", 4, 0, None, None, "zzz")
    assert got["baaaa"][3:] == (None, None, "baaaa") or got["baaaa"][3] == "aaaaaa"
    assert sorted(got.values()) == variants.brute_force(counts)


def test_neighbourhoods_are_whole():
    words = ["abcde", "bbbbb", "aÿabc"]
    points = np.array([[ord(c) for c in w] for w in words])
    word, key = variants.Reduced(points, 5).neighbours()
    rng = random.Random(1)
    for i, w in enumerate(words):
        mine = set(key[word == i].tolist())
        assert len(mine) == (word == i).sum()
        for _ in range(300):
            at, c = rng.randrange(len(w) + 1), chr(rng.randrange(97, 123))
            for x in (w, w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]):
                assert variants.Reduced(np.array([[ord(y) for y in x]]), 5).own()[0] in mine


def test_words_of_texts(spark):
    text = "Äpfelbaum äpfelbaum APFELBAUM apfelbaum×÷ kurz Straßenbahn1Straßenbahn_straßenbahn İstanbulda"
    docs = [(1, text), (1, text), (None, text), (3, None), (4, "")]
    rows = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n int")
    for damage in (31, 2, None):
        got = {r.word: r.n for r in variants.count_words(rows, damage=damage).collect()}
        assert got == slow_counts(docs, damage or 1 << 40)
    empty = variants.count_words(rows.limit(0))
    assert empty.count() == 0 and variants.group_variants(empty).collect() == []
    assert variants.group_variants(empty).columns == list(COLUMNS)
    with pytest.raises(ValueError):
        variants.group_variants(empty, ratio=1)
