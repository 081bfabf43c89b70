"""Literals that patterns need, and folds that stop early."""

import random
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import dates, fields, literals, text
from noticeworks.profile import LATIN_TEST, ZH_TENDER


@pytest.mark.parametrize("pattern, want", [
    ("招标(公告|通知)", ("and", ("招标", ("or", ("公告", "通知"))))), ("(?i)\\b(award|winner)\\b", ("or", ("award", "winner"))),
    (r"a(?:bc)?d{2,}(?=xyz)", ("and", ("a", "d"))), (r"(?:ab|c*)", None), (r"\p{L}+=", "="), (r"[a[b]]c", None), (r"[^&&]c", None), ("(?U)ab", None), ("a(?i)b", None),
    (r"a\x{41}", None), (r"\Qa.b\E", None), ("(?:x|y", None), (r"电\s*话", ("and", ("电", "话"))),
])
def test_needed_literals(pattern, want):
    assert literals.needs(pattern) == want


@pytest.mark.parametrize("profile", [ZH_TENDER, LATIN_TEST])
def test_no_match_without_them(spark, profile):
    """Texts of pieces of the patterns: what a pattern finds, its literals do not rule out; classes are those of the patterns alone."""
    rng = random.Random(5)
    pieces = ["招标", "中标", "公告", "公示", "合同", "签约", "更正", "通知", "采购", "需求", "意向", "终止", "AWARD", "the", "Amend", "ed", "correction", " ", "，", "İK", "结果", "验收"]
    texts = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randint(0, 5))),) for _ in range(800)], "t string")
    for _, pattern in [*profile.notice_types, ("junk", profile.junk), ("nav", profile.nav_words)]:
        held = literals.may_match(F.lower("t"), pattern, cased=False)
        assert texts.where(F.rlike("t", F.lit(pattern)) & ~held).isEmpty()
    plain = F.coalesce(*[F.when(F.rlike(F.concat(F.lit("x "), "t"), F.lit(p)), F.lit(n)) for n, p in profile.notice_types])
    assert texts.where(~plain.eqNullSafe(fields.notice_type(F.lit("x"), F.col("t"), profile))).isEmpty()


def test_classes_are_ruled_out_by_words(spark):
    plan = spark.range(1).select(fields.notice_type(F.lit(""), F.lit("x"), ZH_TENDER))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Contains") > 20 or plan.lower().count("contains(") > 20


def test_dates_behind_later_hints(evaluate):
    found = evaluate(lambda c: dates.date_near(c, ("甲", "乙", "丙"), 12, [(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", False)]), "丙2024-01-03乙2024-01-02", "甲2024-13-01 乙2024-01-02", "甲" + "x" * 12 + "2024-01-01", None)
    assert found == [dt(2024, 1, 2), dt(2024, 1, 2), None, None]


def test_nothing_is_looked_at_behind_the_limit(spark):
    parts = F.array(*[F.lit(p) for p in ("abcd", "no", "efgh", "boom", "boom")])
    wanted = lambda p: F.when(p == "boom", F.raise_error(F.lit("looked at"))).otherwise(p != "no")
    assert spark.range(1).select(text.take_until_length(parts, 6, wanted)).first()[0] == ["abcd", "efgh"]


def test_sentence_breaks_are_the_same(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([("".join(rng.choices("a。！;. \n\t；字", k=rng.randint(0, 12))),) for _ in range(3000)], "t string")
    before = r"(?<=[。！？；\n])\s*|(?<=\.\s)|(?<=;\s)"
    assert rows.where(F.split("t", before, -1) != F.split("t", ZH_TENDER.sentence_break, -1)).isEmpty()
