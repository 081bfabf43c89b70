"""Language identification: held-out accuracy, and profiles against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from noticeworks.llm import langid
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def test_op6_held_out_accuracy(spark):
    got = QUERIES["op6_language"](spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.filter("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert got.count() == 1000 and n > 200 and right >= 0.98 * n
    assert got.filter("score < 0 or score > 1").count() == 0


def slow_profile(text, dimensions, n):
    out = np.zeros(dimensions)
    padded = [0]
    for c in text.lower():
        if c.isalpha():
            padded.append(ord(c))
        elif padded[-1]:
            padded.append(0)
    padded += [0] if padded[-1] else []
    for i in range(len(padded) - n + 1):
        gram = padded[i : i + n]
        if all(gram[1:-1]):
            v = np.ones(dimensions)
            for k, c in enumerate(gram):
                v = v * np.roll(langid.letter_vector(c, dimensions), n - 1 - k)
            out += v
    return out


def test_profiles_equal_plain_loops():
    texts = ["Hello, hello wörld!", "", "a", "日本語 text", "...", "ŐŰ 12 x", "İstanbul", "tail"]
    found = langid.profiles(texts, 64, 3)
    for row, t in zip(found, texts, strict=True):
        assert np.array_equal(row, slow_profile(t, 64, 3)), t


def test_odd_texts(spark):
    train = spark.createDataFrame([("aa", "lorem ipsum dolor"), ("bb", "zyx qwv jkq"), (None, "x"), ("cc", None)], "lang string, text string")
    known = langid.learn(train)
    assert list(known) == ["aa", "bb"]
    docs = [(1, None), (2, ""), (3, "12 ?!"), (4, "lorem dolor"), (4, "lorem dolor"), (None, "qwv " * 200_000)]
    rows = spark.createDataFrame([(i, t, "en", 7.5) for i, t in docs], "doc_id long, text string, lang_pred string, score double")
    out = langid.identify(rows, known)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = sorted([(r.doc_id, r.lang_pred) for r in out.collect()], key=str)
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (None, "bb")]
    assert langid.identify(rows.limit(0), known).count() == 0
    nothing = langid.identify(rows, langid.learn(train.limit(0)))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_copies_are_learned_once(spark):
    rng = np.random.default_rng(6)
    texts = {label: ["".join(rng.choice(list(letters), 80)) for _ in range(k)] for label, letters, k in (("aa", "abcde ", 10), ("bb", "uvwxyz ", 10), ("cc", "klmnop ", 300))}
    once = [(label, t) for label, group in texts.items() for t in group]
    copies = once + [("aa", t) for t in texts["aa"] for _ in range(200)] + [("bb", texts["bb"][0])] * 2000 + [("cc", t) for t in texts["cc"][:20] for _ in range(50)]
    frames = [spark.createDataFrame(rows, "lang string, text string") for rows in (once, copies)]
    plain, known = (langid.learn(f, per_language=20) for f in frames)
    assert list(plain) == list(known) == ["aa", "bb", "cc"]
    for label, group in texts.items():
        assert np.array_equal(plain[label], known[label]), label
        if len(group) <= 20:
            whole = langid.profiles(group, langid.DIMENSIONS, langid.GRAM).sum(axis=0, dtype=np.float64)
            assert np.allclose(known[label], whole / np.linalg.norm(whole), atol=1e-6), label


def test_long_texts_of_many_letters():
    """200,000 random ideographs, far more different n-grams than real text has, within a stated time."""
    import time

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 200_000)))
    start = time.perf_counter()
    found = langid.profiles([text, "short"], langid.DIMENSIONS, langid.GRAM)
    assert time.perf_counter() - start < 8  # 0.6 MB
    assert np.array_equal(langid.profiles([text[:300]], 64, 3)[0], slow_profile(text[:300], 64, 3)) and found[1].any()


def test_null_ids_are_neither_learned_from_nor_held_out(spark):
    from noticeworks.llm.queries import held_out

    rows = spark.createDataFrame([(None, "aa", "abc"), (1, "bb", "xyz"), (2, "bb", "xyzz"), (3, "bb", "zyx"), (4, "bb", "yyy")], "doc_id long, lang string, text string")
    assert "aa" not in langid.learn(rows.filter(~held_out()))
    assert [r.h for r in rows.filter("doc_id IS NULL").select(held_out().alias("h")).collect()] == [None]
