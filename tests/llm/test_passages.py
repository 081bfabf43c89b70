"""Removal of passages that other documents have too, against plain loops."""

import random

import pytest

from noticeworks.llm import passages
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def shown(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_op11_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = passages.brute_force(docs)
    assert shown(QUERIES["op11_passages"](spark, DIR)) == want and sum(n for _, _, n, _ in want) > 1000


@pytest.mark.parametrize("window,block", [(50, 3000), (50, 1 << 20), (7, 900), (2, 400), (1, 400)])
def test_small_blocks_and_windows(spark, window, block):
    rng = random.Random(window)
    words = ["a", "bé", "日本", "xyz", " ", "q q", "-", "Ende"]
    shared = [" ".join(rng.choices(words, k=rng.randrange(window, 4 * window + 2))) for _ in range(6)]
    gap = ["\t", "\n", " ", "\r\n  ", "\x0b", "\x0c"]
    docs = [(i * 3 - 20, "".join(f"{rng.choice(shared)}{rng.choice(gap)}{' '.join(str(rng.random()) for _ in range(rng.randrange(8)))}{rng.choice(gap)}" for _ in range(rng.randrange(6)))) for i in range(50)]
    docs += [(1000 + i, docs[5][1]) for i in range(9)] + [(2000, None), (2001, ""), (2002, " \n"), (-40, docs[7][1]), (3000, "w " * 900), (3001, "w " * 400), (3002, "v " * 400)]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, `rank` int")
    assert shown(passages.remove_shared(rows, window=window, block_bytes=block)) == sorted(passages.brute_force(docs, window))


def test_cut_passages_and_repeats_inside_a_document(spark):
    rng = random.Random(3)

    def text(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    long, lone = text(400), text(60)
    docs = [
        (1, text(30) + long + text(30)),
        (2, long[70:119]),  # 49 words: no window
        (3, long[70:120] + text(5)),
        (4, text(3) + long[:99] + text(1) + long[99:200]),
        (5, lone + lone + lone),  # only within one document
        (6, long[10:80] + long[300:360]),
    ]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.remove_shared(rows).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 0, 3: 50, 4: 200, 5: 0, 6: 130}
    assert bytes(got[3].kept).decode() == " ".join(docs[2][1][50:]) and bytes(got[6].kept) == b""


def test_one_id_null_ids_and_no_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = spark.createDataFrame([(1, a), (1, a), (1, a + " more"), (2, a), (2, b), (None, b), (None, b + " x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in passages.remove_shared(rows).collect()), key=str)
    assert got == sorted([(1, 80, 0, a), (1, 80, 0, a), (1, 81, 0, a + " more"), (2, 80, 80, ""), (2, 80, 80, ""), (None, 80, 0, b), (None, 81, 0, b + " x")], key=str)
    assert passages.remove_shared(rows.limit(0)).collect() == []
    assert passages.remove_shared(rows.limit(0), keep=False).columns == list(COLUMNS)


def test_many_owners_of_one_phrase(spark):
    """A phrase that stands in hundreds of different passages, each in two documents."""
    rng = random.Random(5)
    phrase = " ".join(f"p{i}" for i in range(30))
    around = [(" ".join(f"{rng.random()}" for _ in range(30)), " ".join(f"{rng.random()}" for _ in range(30))) for _ in range(200)]
    docs = [(i, f"{a} {phrase} {z}") for i, (a, z) in enumerate(around)] + [(1000 + i, f"start {a} {phrase} {z} end") for i, (a, z) in enumerate(around)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert shown(passages.remove_shared(rows, block_bytes=20_000)) == passages.brute_force(docs)
