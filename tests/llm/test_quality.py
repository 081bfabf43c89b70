"""Quality rules against plain loops."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from noticeworks.llm import quality
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(tri)
    repeat = len({i + k for i, x in enumerate(tri) if times[x] > 1 for k in range(3)})
    dup = len(lines) - len(set(lines))
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    bad = (
        chars > 15 * len(w) or chars < 2 * len(w) or 10 * symbols > len(w) or 3 * len(re.findall("[!?]", t)) > len(w)
        or 2 * sum(c.isupper() for c in t) > sum(c.isalpha() for c in t) or 2 * len(re.findall("[0-9]", t)) > len(t)
        or 2 * dup > len(lines) or 20 * len(set(w)) < len(w)
    )
    return len(w), chars, symbols, dup, repeat, failed, not failed and not bad


def shown(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()]


def test_op2_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_quality"](spark, DIR)
    rows = got.collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {d: slow(t) for d, t in docs.items()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert got.join(labels, "doc_id").filter("quality = 1 and n_words >= 50 and not kept").count() == 0
    assert got.join(labels, "doc_id").filter("quality = 0 and kept").count() == 0


def test_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \x0b\n", "a b c", "a b c a b c", "x " * 60, "# " * 80, "É" * 900, "12 " * 90, "    é\x85b", "\n\nl 1\nl 1\n l 1\n", "wörd " * 30_000]
    texts += [" ".join(rng.choices("ab cd EF ! 12 é #".split(), k=rng.randrange(3, 130))) + "\n" * rng.randrange(2) for _ in range(150)]
    texts += ["\n".join(rng.choices([" ".join(rng.choices("pqrstuvwxyz", k=6)) for _ in range(9)], k=rng.randrange(5, 30))) for _ in range(60)]
    texts += [texts[20], texts[20]]
    rows = spark.createDataFrame([(t, 1, "x") for t in texts], "text string, N_words int, kept string")
    out = quality.judge_quality(rows)
    assert out.columns == ["text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(shown(out)) == sorted(map(slow, texts))
    assert quality.judge_quality(rows.limit(0)).count() == 0


def test_order_never_changes_the_verdict(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(F.col("text").alias("t")).withColumn("w", quality.words_of(F.col("t")))
    ordered = quality.order_rules(docs, text_col="t", sample=300)
    assert {r.name for r, _, _ in ordered} == {r.name for r in quality.RULES}
    assert all(a[2] / a[1] >= b[2] / b[1] for a, b in zip(ordered, ordered[1:], strict=False))
    forth, back = (quality.cascade([r for r, _, _ in x], F.col("t"), F.col("w")) for x in (ordered, ordered[::-1]))
    assert all(a == b for a, b in docs.select(forth.alias("forth"), back.alias("back")).collect())


def test_rules_of_known_cost_are_ordered_by_it(spark):
    """Of equal rejection the cheaper goes first, of equal cost the one that rejects more; every time."""
    from pyspark.sql import functions as F

    def dear(times):
        return lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0), lambda a, i: a + F.levenshtein(F.left(d.text, F.lit(50) + i % 2), F.reverse(F.left(d.text, F.lit(60))))) >= 0

    rules = (quality.Rule("dearest", dear(40)), quality.Rule("dear", dear(8)), quality.Rule("cheap", lambda d: d.n_words >= 0), quality.Rule("rare", lambda d: d.n_words < 0))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _ in range(3):
        ordered = quality.order_rules(docs, rules, sample=400)
        assert [r.name for r, _, _ in ordered] == ["cheap", "dear", "dearest", "rare"], [(r.name, c, s) for r, c, s in ordered]
        assert [s for _, _, s in ordered] == [1.0, 1.0, 1.0, 0.0]


def test_sample_is_fixed_and_bounded(spark):
    texts = [f"text {i} of some words" for i in range(500)] + ["one text many times"] * 3000
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    shares = {tuple(s for _, _, s in sorted(quality.order_rules(docs, (quality.Rule("sevens", lambda d: d.text.contains("7")),), sample=100))) for _ in range(2)}
    assert len(shares) == 1 and 0.05 < shares.pop()[0] < 0.6


def test_without_counts_the_verdict_is_the_same(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.lit("x").alias("words"), F.lit(1).alias("row"))
    slim = quality.judge_quality(docs, counts=False, keep_text=False)
    assert slim.columns == ["doc_id", "words", "row", "kept"]
    full = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert {r.doc_id: r.kept for r in slim.collect()} == full
    assert quality.judge_quality(docs.select("text"), counts=False, keep_text=False).columns == ["kept"]


def test_plan_is_native_and_narrow(spark):
    plan = QUERIES["op2_quality"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
