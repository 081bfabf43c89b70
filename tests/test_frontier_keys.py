"""The crawl frontier keeps URLs without hashes beside them."""

from pyspark.sql import functions as F

from noticeworks.operators import links as L


def test_levels_by_url(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), (None, "x"), ("c", "a")], "url string, link string")
    visited = spark.createDataFrame([("a", 0), (None, 0)], "url string, depth int")
    first = L.next_level(edges, visited, 1, "url")
    assert first.columns == ["url", "depth"] and sorted(map(tuple, first.collect())) == [("b", 1), ("c", 1)]
    assert sorted(map(tuple, L.next_level(edges, visited.union(first), 2, "url").collect())) == [("d", 2)]


def test_missing_and_repeated_seeds(spark):
    pages = spark.createDataFrame([("1", "http://h.cn/0", '<a href="/1">x</a>'), ("2", None, '<a href="/2">x</a>')], "id string, url string, html string")
    seeds = spark.createDataFrame([("http://h.cn/0",), ("http://h.cn/0",), (None,)], "url string")
    out = L.crawl_frontier(pages.withColumn("crawled_at", F.lit(None).cast("timestamp")), seeds)
    assert out.columns == ["url", "url_hash", "depth"] and out.where("NOT url_hash <=> md5(url)").count() == 0
    assert {(r.url, r.depth) for r in out.collect()} == {("http://h.cn/0", 0), ("http://h.cn/1", 1), (None, 0)} and out.count() == 3
