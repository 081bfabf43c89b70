"""Decontamination and near-duplicates against plain loops."""

import random

import pytest
import xxhash
from pyspark.sql import types as T

from noticeworks.llm import decontam, simhash
from noticeworks.llm.components import components
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_op1_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op1_decontamination"](spark, DIR).collect())
    assert got == sorted(decontam.brute_force(docs, items))


@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_odd_texts_and_blocks(spark, block_bytes):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("a b c É Z9".split(), k=rng.randrange(60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "x a b"), (7, docs[7][1]), (102, "... --- "), (103, "a, B. c" * 3000)]
    items = [(1, "a b c"), (2, "A"), (3, None), (4, ""), (5, " ".join(rng.choices("a b c é z9".split(), k=14))), (5, docs[9][1]), (1, "a b c"), (12, docs[20][1])]
    frame = spark.createDataFrame([(i, t, 5, True) for i, t in docs], "doc_id long, text string, n_words int, Contaminated boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_contamination(frame, bench, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "text", "bench_items", "n_words", "n_hit", "contaminated"]
    got = [(r.doc_id, r.n_words, r.n_hit, len(r.bench_items), r.contaminated) for r in out.collect()]
    want = [(d, n, h, i, c) for d, n, h, i, _, c in decontam.brute_force(docs, items)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.bench_items) for r in decontam.find_contamination(some, bench).collect()] == [(2, 0, [])]
    assert simhash.near_duplicates(none).count() == 0


def slow_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, bits=2):
    """{fingerprint: set of fingerprints} by comparing all pairs."""
    left, out = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            todo += near
        out |= dict.fromkeys(group, group)
    return out


def test_op8_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: slow_fingerprint(t) for d, t in docs}
    groups = slow_components(prints.values())
    want = [(d, f"{f:016x}", min(e for e, g in prints.items() if g in groups[f])) for d, f in prints.items()]
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, DIR).collect())) == sorted(want)


def test_odd_texts_simhash(spark):
    docs = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "One two", 0), (5, "one  TWO", 0), (None, "é ß Ü x y", 0), (7, "w " * 70_000, 0), (7, "q", 0), (8, "q", 0), (8, "q", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, fingerprint int")).collect()
    got = sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in out), key=str)
    texts = {i: t for i, t, _ in docs if i != 7}
    assert [g for g in got if g[0] not in (7, None)] == sorted([(i, slow_fingerprint(texts[i]), c) for i, c in ((1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 7), (8, 7))], key=str)
    assert (None, slow_fingerprint("é ß Ü x y"), None) in got


@pytest.mark.parametrize("pairs", [0, 3, 64])
def test_links_of_close_fingerprints(spark, pairs):
    """Crowds of near fingerprints, by pairs and by points, give the same components as all pairs."""
    rng = random.Random(pairs)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), pairs).collect()
    m = 2**64 - 1
    assert all(((r.a & m) ^ (r.b & m)).bit_count() <= 2 for r in links)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[find(r.a & m)] = find(r.b & m)
    groups = slow_components(prints)
    assert {frozenset(q for q in prints if find(q) == find(p)) for p in prints} == {frozenset(g) for g in groups.values()}


def test_golay_keys_meet():
    """Any two words at most one bit apart share a key."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    near, _, _ = simhash.golay_indices(x)
    for flip in (0, *(1 << i for i in range(23))):
        _, row, index = simhash.golay_indices(x ^ flip)
        keys = set(zip(row.tolist(), index.tolist(), strict=True))
        assert all((i, n) in keys for i, n in enumerate(near.tolist()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(5, 5), (7, 6), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def test_a_batch_is_searched_in_small_parts(monkeypatch):
    """What a worker keeps from one batch of many texts is as for a part of half a megabyte."""
    import pyarrow as pa

    from noticeworks.llm import textbytes as tb

    class Block:
        value = decontam.compile_items([("i", "alpha beta gamma")], 3)

    monkeypatch.setattr(tb, "_POWERS", {})
    texts = [f"{'word ' * 20}alpha beta gamma"] * 30_000
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.list_(pa.string()))], names=["text", "__places", "bench_items"])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("n_words", "n_hit")])
    found = pa.Table.from_batches(decontam._search(Block, "text", True, schema)(iter([batch])))
    assert found.num_rows == len(texts) and set(found["n_hit"].to_pylist()) == {3} and set(found["n_words"].to_pylist()) == {23}
    assert 0 < max(len(p) for p in tb._POWERS.values()) < 1 << 20
