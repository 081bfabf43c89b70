"""Removal of repeated substrings against plain loops."""

import random

import pytest

from noticeworks.llm import substrings
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def shown(df, *more):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *more).collect()]


def test_op10_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(shown(QUERIES["op10_substrings"](spark, DIR))) == substrings.brute_force(docs)


@pytest.mark.parametrize("window,block,bucket", [(100, 500, 40), (20, 3000, 1000), (9, 200, 30), (3, 1 << 20, 1 << 20)])
def test_small_blocks_and_windows(spark, window, block, bucket):
    rng = random.Random(window)
    passages = ["".join(rng.choices("abé ", k=rng.randrange(5, 160))) for _ in range(6)]
    docs = [(i * 7, "".join(rng.choice(passages) + "".join(rng.choices("xyz", k=rng.randrange(12))) for _ in range(rng.randrange(6)))) for i in range(40)]
    docs += [(1000 + i, docs[5][1]) for i in range(9)] + [(2000, None), (2001, ""), (-4, docs[7][1]), (3000, "q" * 5000)]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, block string, `key` string")
    got = shown(substrings.remove_repeats(rows, window=window, block_bytes=block, bucket_names=bucket))
    assert sorted(got) == substrings.brute_force(docs, window)


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = spark.createDataFrame([(1, t), (1, t), (None, t[:120]), (2, t[:40])], "doc_id long, text string")
    got = sorted(shown(substrings.remove_repeats(rows), "kept"), key=str)
    assert [(r[0], r[1], r[2], r[3], bytes(r[5]).decode()) for r in got] == [(1, 150, 120, 1, t[120:]), (1, 150, 120, 1, t[120:]), (2, 40, 0, 0, t[:40]), (None, 120, 0, 0, t[:120])]
    assert substrings.remove_repeats(rows.limit(0)).count() == 0


def test_covers():
    for window in (3, 8, 14, 20, 100):
        modulus, mask = substrings.difference_cover(window)
        assert all(any(mask[(i + k) % modulus] and mask[(j + k) % modulus] for k in range(modulus)) for i in range(modulus) for j in range(modulus))


def test_blocks_hold_bounded_bytes(spark, tmp_path, monkeypatch):
    rng, passes, folder = random.Random(10), substrings._passes, str(tmp_path)

    def spied(window, buckets):
        first, *others = passes(window, buckets)

        def seen(docs, messages):
            import pathlib
            import uuid

            import zstandard

            sizes = [len(zstandard.ZstdDecompressor().decompress(p)) for p in docs["packed"].to_pylist()]
            pathlib.Path(folder, uuid.uuid4().hex).write_text(f"{len(sizes)} {sum(sizes)}")
            return first(docs, messages)

        return seen, *others

    def text(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    monkeypatch.setattr(substrings, "_passes", spied)
    books, pages, nulls, same = [text(1500) for _ in range(40)], [text(120) for _ in range(300)], [text(200) for _ in range(60)], [text(200) for _ in range(60)]
    docs = [*enumerate(books), *((1000 + i, t) for i, t in enumerate(pages)), *((None, t) for t in nulls), *((500, t) for t in same), (501, text(9000)), (5000, books[3]), (5001, nulls[0])] + [(700, pages[0])] * 400
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block_bytes=4000, bucket_names=2000).collect()
    blocks = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert sum(n for n, _ in blocks) <= len(docs) and all(size <= 4000 or n == 1 for n, size in blocks if n), sorted(blocks)[-5:]
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert len(got) == len(docs) and removed[5000, 1500] == 1500 and removed[5001, 200] == 200 and removed[1000, 120] == 120 and removed[700, 120] == 0
    assert sum(r.n_removed for r in got) == 1500 + 200 + 120
