"""Deep pages against offsets."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import paging as P


def rows(spark, n, seed):
    rng = random.Random(seed)
    day = datetime(2024, 1, 1)
    data = [
        (i, rng.choice([None, day, day, day + timedelta(microseconds=rng.randrange(10**15))]), rng.choice([None, "", "a", "ab", "long prefix of a text " + str(rng.randrange(500)), "é" + str(i)]),
         rng.choice([None, 0.5, -1.25, rng.random() * 10, float("nan"), float("inf")]), rng.choice([None, date(1969, 1, 1), date(2024, 1, 1 + rng.randrange(28))]), rng.choice([None, True, False]))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id bigint, at timestamp, text string, x double, day date, flag boolean").repartition(4).cache()


@pytest.mark.parametrize("keys", [
    [P.SortKey("at", True), P.SortKey("id", True)], [P.SortKey("at"), P.SortKey("id")], [P.SortKey("text"), P.SortKey("id")],
    [P.SortKey("text", True), P.SortKey("id")], [P.SortKey("x"), P.SortKey("id", True)], [P.SortKey("x", True), P.SortKey("id", True)], [P.SortKey("flag", True), P.SortKey("day"), P.SortKey("id", True)],
])
def test_pages_equal_offsets(spark, keys):
    df = rows(spark, 3000, 7)
    want = [r.id for r in df.orderBy(*(k.order() for k in keys)).select("id").collect()]
    for page in (1, 2, 40, 77, 120, 149, 150, 151, 999):
        got = [r.id for r in P.deep_page(df, keys, page, 20, rows=100, ranges=16).collect()]
        assert got == want[(page - 1) * 20 : page * 20], (keys, page)


def test_one_range_is_sorted(spark):
    df = spark.range(200_000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    keys = [P.SortKey("k"), P.SortKey("id")]
    condition, left = P.page_start(df, keys, 150_000, rows=1000, ranges=64)
    assert left <= 1000 and df.where(condition).count() <= 200_000 - 150_000 + 1000
    out = P.deep_page(df, keys, 7501, 20, rows=1000, ranges=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert [r.id for r in out.collect()] == [3 * (150_000 - 66_667 * 2 + i) + 2 for i in range(20)]
    assert P.deep_page(df.limit(0), keys, 10_000, 20, rows=10).collect() == []
