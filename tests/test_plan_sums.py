"""Sums of a plan that is made in arrays are those of its rows, text by text."""

import hashlib
import random

import numpy as np
import pytest

from noticeworks import schemas
from noticeworks.operators import planning as P
from noticeworks.operators import querysums as Q

SOURCES = "id bigint, name string, source_category string, search_url_template string, max_pages int, enabled boolean"
# ids repeat or are missing, and so are names
REGIONS = [
    (1, "r", None, "district", None, True), (1, "r", None, "district", None, True), (None, "n", None, "city", None, True),
    (2, "v", None, "village", 1, True), (3, "o", None, "city", None, False), (4, None, None, "city", None, True), (5, "大" * 40, None, "city", None, True),
]


def tables(spark, regions):
    src = [(2, "site", "government", None, 0, True), (2, None, "government", None, 0, True), (1, "a", "search_engine", "http://x", 5, True),
           (1, "a", "search_engine", "http://x", -3, True), (None, "b", "search_engine", "http://y", 0, True), (4, "off", "search_engine", "http://z", 5, False),
           (7, "c", "search_engine", "http://c", None, True)]
    kws = spark.createDataFrame([(i // 2, None if i == 3 else "道路" * i, True) for i in range(9)], schemas.SEARCH_KEYWORDS)
    suffixes = spark.createDataFrame([(1, "s", True), (1, None, True), (2, "采购公告", True)], schemas.SEARCH_SUFFIXES)
    return spark.createDataFrame(src, SOURCES), kws, spark.createDataFrame(regions, schemas.SEARCH_REGIONS), suffixes


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("regions, cap, skip, sizes", [
    (REGIONS, None, 0, (64, 100, 200, 200, 1 << 16)), (REGIONS, None, 37, (2, 3, 4, 2, 16)), (REGIONS, 50, 5, (3, 2, 2, 1, 8)),
    (REGIONS, 3, 0, (1, 1, 1, 1, 1)), ([], None, 0, (2, 2, 2, 2, 64)), (REGIONS, 1000, 401, (2, 4, 9, 3, 40)),
])
def test_sums_of_arrays(spark, monkeypatch, regions, cap, skip, sizes):
    for name, size in zip(("ENGINES", "REGIONS", "KEYWORDS", "SUFFIXES", "TEXTS"), sizes):
        monkeypatch.setattr(Q, name, size)
    t = tables(spark, regions)
    want = P.sum_queries(P.plan_queries(*t, cap=cap, skip=skip))
    got = P.plan_queries(*t, cap=cap, skip=skip, summed=True)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes


def test_nothing_to_sum(spark):
    sources, kws, regions, suffixes = tables(spark, REGIONS)
    for t in ((sources.where("false"), kws, regions, suffixes), (sources, kws.where("false"), regions, suffixes), (sources, kws, regions, suffixes.where("false"))):
        assert rows(P.query_combos(*t, summed=True)) == rows(P.sum_queries(P.query_combos(*t)))


def test_no_row_for_a_query(spark):
    plan = P.query_combos(*tables(spark, REGIONS), summed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "explode(sequence(_region" not in plan


def test_hashes_of_texts():
    rng = random.Random(3)
    tails = [rng.randbytes(n) for n in range(180)]
    for start in (1, 8, 95, 9_990, 99_999_950, 999_999_900, 10**15):
        numbers = np.array([[start], [3 * start + 1]]) + np.arange(len(tails))
        want = [[int(hashlib.md5(b"%d %s" % (n, tail)).hexdigest()[:7], 16) for n, tail in zip(row, tails)] for row in numbers]
        assert Q.text_heads(numbers, tails).tolist() == want
