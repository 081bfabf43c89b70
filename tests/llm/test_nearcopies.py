"""Near copies against comparisons of all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from noticeworks.llm import nearcopies

DIR = "/root/testdata/sf0.01"


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def similar_pairs(sets, similarity=0.8):
    """Pairs of different sets at a similarity, by shared shingles."""
    holders, out = {}, set()
    for s in sets:
        for x in s:
            holders.setdefault(x, []).append(s)
    for s in sets:
        shared = {}
        for x in s:
            for t in holders[x]:
                shared[t] = shared.get(t, 0) + 1
        out |= {frozenset((s, t)) for t, n in shared.items() if t != s and n >= similarity * (len(s) + len(t) - n)}
    return out


def similar_groups(texts, words=5, similarity=0.8):
    """A group per text."""
    sets = [shingles(t, words) for t in texts]
    parent = {s: s for s in sets}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for pair in similar_pairs(set(sets), similarity):
        a, b = pair
        parent[find(a)] = find(b)
    return [find(s) for s in sets]


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    groups = similar_groups([r.text for r in docs])
    least = {}
    for r, g in zip(docs, groups, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    got = nearcopies.near_copies(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert got.columns == ["doc_id", "component_id"]
    assert {r.doc_id: r.component_id for r in got.collect()} == {r.doc_id: least[g] for r, g in zip(docs, groups, strict=True)}


def edited(rng, words, share, block):
    """A copy with some words replaced, spread or in one place."""
    words = list(words)
    n = max(1, round(share * len(words)))
    at = range(s := rng.randrange(max(1, len(words) - n)), s + n) if block else rng.sample(range(len(words)), n)
    for i in at:
        words[i] = f"new{rng.randrange(10**6)}"
    return words


def test_recall_of_planted_copies(spark):
    rng = random.Random(8)
    vocabulary = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{i}" for i in range(900)]
    texts, pairs = [], 0
    for i in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 150, 600, 2000]))]
        copy = edited(rng, words, rng.uniform(0.002, 0.025), False) if i % 2 else edited(rng, words, rng.uniform(0.01, 0.1), True)
        texts += [" ".join(words), " ".join(copy)]
    found = nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root = {r.doc_id: r.component_id for r in found}
    sets = [shingles(t) for t in texts]
    hit = total = 0
    for i in range(0, len(texts), 2):
        a, b = sets[i], sets[i + 1]
        alike = len(a & b) >= 0.8 * len(a | b)
        total += alike
        hit += alike and root[i] == root[i + 1]
        assert alike or root[i] != root[i + 1]
        assert root[i] == i
    assert total > 300 and hit >= 0.95 * total, (hit, total)


def test_a_crowd_of_copies(spark):
    """Hundreds of near copies and two crowds that share their keys are linked, without all pairs."""
    rng = random.Random(9)
    one = [f"w{rng.randrange(5000)}" for _ in range(400)]
    far = edited(rng, one, 0.12, True)
    texts = [" ".join(edited(rng, base, 0.004, False)) for base in (one, far) for _ in range(150)]
    found = nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = similar_groups(texts)
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    got = {r.doc_id: r.component_id for r in found}
    assert sum(got[i] == least[g] for i, g in enumerate(groups)) >= 0.95 * len(texts) and len({*got.values()}) <= 0.05 * len(texts) + 2


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(300))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "One two", 0), (5, "one  TWO", 0), (None, long, 0), (7, long + " more", 0), (7, long + " more", 0), (8, "w " * 70_000, 0), (9, "two one", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit int")
    got = sorted(((r.doc_id, r.component_id) for r in nearcopies.near_copies(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 7), (7, 7), (7, 7), (8, 8), (9, 9)], key=str)
    assert nearcopies.near_copies(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [40, 200])
def test_pairs_of_a_key(n):
    """Two kinds of sketches in one key: every row meets the least index row of its kind, none of its own group; far ones beyond those tried meet the head."""
    rng = np.random.default_rng(n)
    unit, kind = rng.permutation(10 * n)[:n], np.arange(n) % 2
    near = np.where(kind, np.uint64(2**64 - 1), np.uint64(0)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    columns = {"keys": np.full(n, 5, np.uint64), "units": unit, "groups": unit, "sketches": near, "probes": np.arange(n) > 9}

    def paired(**changed):
        parts = (slice(0, n // 3), slice(n // 3, n))
        found = nearcopies._paired(pa.table({c: pa.array([v[p].tobytes() for p in parts], pa.binary()) for c, v in (columns | changed).items()}))
        return {(a, b, c) for a, b, c in zip(*(x.to_pylist() for x in found.columns), strict=True)}

    heads = [sorted(int(u) for u, k in zip(unit[:10], kind[:10], strict=True) if k == side) for side in (0, 1)]
    assert paired() == {(*sorted((next(h for h in heads[k] if h != u), int(u))), 0) for u, k in zip(unit, kind, strict=True)}
    assert paired(groups=kind) == set()
    far = rng.integers(0, 1 << 63, n).astype(np.uint64)
    crowd = [x for x in paired(sketches=far, probes=np.arange(n) >= n) if x[2]]
    assert len(crowd) > n / 2 if n > nearcopies.TRIED else not crowd


def components_of(texts, **options):
    """(texts that got another component than by brute force, components)."""
    groups, least = similar_groups(texts), {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    spark = options.pop("spark")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
    return [i for i, g in enumerate(groups) if got[i] != least[g]], len({*got.values()})


def loose_crowd(n, size=100):
    """Texts that differ from one pattern by one to six words each: many pairs stand next to the similarity, on both sides."""
    rng = random.Random(12)
    one = [f"w{rng.randrange(5000)}" for _ in range(size)]
    texts = []
    for _ in range(n):
        words = list(one)
        for i in rng.sample(range(size), rng.randint(1, 6)):
            words[i] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_links_that_no_fingerprint_finds(spark):
    """No two fingerprints are taken for near, and keys are compared in several blocks and rounds: the groups are the same."""
    texts = loose_crowd(200)
    wrong, n = components_of(texts, spark=spark, different=0.0)
    assert not wrong and 50 < n < 200


def test_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 30)
    monkeypatch.setattr(nearcopies, "ROWS", 64)
    monkeypatch.setattr(nearcopies, "NEAREST", 1)
    monkeypatch.setattr(nearcopies, "MORE", 2)
    wrong, n = components_of(loose_crowd(150), spark=spark, different=0.0)
    assert not wrong and 40 < n < 150


def test_a_loose_crowd_gives_few_pairs(spark, monkeypatch):
    """All groups of a crowd, in a number of compared pairs that follows the number of texts."""
    compared, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda spark, rows, units, near, *more: compared.append(near.count()) or similar(spark, rows, units, near, *more))
    counts = []
    for n in (250, 1000):
        compared.clear()
        wrong, _ = components_of(loose_crowd(n), spark=spark)
        assert not wrong
        counts.append(sum(compared))
    assert counts[1] <= 8 * counts[0], counts


def test_left_pairs_are_named():
    """Of a key each text gives its nearest; both texts of every pair that is left are named."""
    n = 40
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 2**63, (1, nearcopies.PARITY // 64), dtype=np.uint64).repeat(n, axis=0)
    bins[:, 0] ^= np.uint64(1) << rng.integers(0, 60, n).astype(np.uint64)
    columns = {"run": np.ones(n, np.int64), "unit": np.arange(n), "group": np.arange(n) // 2, "size": np.full(n, 146, np.int32), "place": np.zeros(n, np.int32), "side": np.zeros(n, np.int32)}

    def pairs(nearest, **changed):
        found = nearcopies._possible(nearest, 0.8)(pa.table({k: pa.array(v) for k, v in (columns | changed).items()} | {"parities": [b.tobytes() for b in bins]}))
        return {*zip(*(x.to_pylist() for x in found.columns), strict=True)}

    every = {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2}
    assert pairs(n) == every
    some = pairs(3)
    assert every - some and all((a, a) in some and (b, b) in some for a, b in every - some)
    assert pairs(n, side=np.arange(n, dtype=np.int32) % 2 + 1) == {(a, b) for a, b in every if a % 2 != b % 2}
    assert pairs(n, place=np.full(n, 20, np.int32)) == set()
