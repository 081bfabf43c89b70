"""Packing: exact round trip of ids, gapless sequences, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticeworks.llm import packing
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def checked(docs, rows, window):
    """Every id in one piece, pieces gapless; returns the padding."""
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for (d, _), ids in zip(docs, ids_of([t for _, t in docs]), strict=True):
        at = 0
        for r in sorted(of.pop(d), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not of
    sequences, padding = defaultdict(list), 0
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_op3_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op3_packing"](spark, DIR).collect()
    assert checked(docs, rows, 2048) <= 0.01 * sum(r.length for r in rows)


@pytest.mark.parametrize("window,slack", [(4, 0), (32, 0), (256, 8)])
def test_odd_texts_and_a_hot_length(spark, window, slack):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("one two é 4 x\n it's".split(" "), k=rng.randrange(90))) for _ in range(80)]
    docs = list(enumerate([*texts, *["a b c d e"] * 60, None, "", "z" * 3000, "\x1c \x00   q"]))
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, task int, `left` int").repartition(5)
    out = packing.pack(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, window=window, slack=slack)
    got = out.collect()
    assert checked(docs, got, window) <= slack * len(got)
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert all(n >= window - slack or n & (n - 1) == 0 for n in used.values())


def test_repeated_rows_and_none(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    got = packing.pack(rows, path, pattern).collect()
    assert sum(r.length for r in got) == 9 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(rows.limit(0), path, pattern).count() == 0


def test_plan_fills_exactly_where_it_can():
    rng = random.Random(5)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 2048), 400)}
    patterns, cut = packing.plan(histogram, 2048)
    used = defaultdict(int, cut)
    for p, times in patterns:
        assert 2016 <= sum(n * c for n, c in p.items()) <= 2048
        for n, c in p.items():
            used[n] += c * times
    assert dict(used) == histogram
    assert sum(n * c for n, c in cut.items()) < 0.2 * sum(n * c for n, c in histogram.items())
    best = packing.fill({3: 1, 5: 2, 9: 1}, [3, 5, 9], 16)
    assert best == {5: 2, 3: 1} or sum(n * c for n, c in best.items()) == 14
