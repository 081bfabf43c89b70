from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import urls as U
from noticeworks.operators import links as L


@pytest.mark.parametrize("base", ["http://h.cn", "http://h.cn/", "http://h.cn/a/b", "http://h.cn/a/b/?x=1", "https://h.cn:8/a/b/c.html"])
def test_join_url_like_urljoin(spark, base):
    hrefs = ["c", "./c", "../c", "../../../c", "/x", "/x/../y", "?q=2", "//z.cn/q", "https://z.cn/q?u", "c/d/..", "c?x=1", "a//b", "c/"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    out = df.select("h", U.join_url(F.col("b"), F.col("h")).alias("j")).collect()
    assert {r.h: r.j for r in out} == {h: urljoin(base, h) for h in hrefs}


def test_serp_url(evaluate):
    got = evaluate(
        U.is_serp_url, "https://WWW.BAIDU.com/s?wd=1", "https://www.baidu.com/link?url=1", "https://www.baidu.com:80/s", "",
        "https://duckduckgo.com", "http://x.cn/s", None, "https://www.sogou.com/sogou?x",
    )
    assert got == [True, False, False, False, True, False, False, True]


def test_result_url(evaluate):
    got = evaluate(lambda v: U.is_result_url(v, "x.cn"), "http://a.cn/1", "http://b.x.cn", "http://ax.cn", "ftp://a.cn", "http://m.baidu.com", "//a.cn")
    assert got == [True, False, True, False, False, False]


def test_domain_suffix(evaluate):
    assert evaluate(lambda v: U.domain_matches(v, ".X.cn"), "x.cn", "a.x.cn", "abcx.cn", None) == [True, True, False, False]


def test_page_links(spark):
    many = "".join(f'<a href="/n/{i}">x</a>' for i in range(205))
    html = (
        '<a href="#top">a</a><a href="javascript:x()">b</a><a HREF=\'rel.html#f\'>c</a><a href="/root?x=1#f">d</a>'
        '<a href="//h.cn/s">e</a><a href="http://other.cn/">f</a><a href="/p.PDF">g</a><a href="rel.html">again</a>'
        '<a href="http://extra.cn/z;j=1?k">h</a>' + many
    )
    rows = L.page_links(spark.createDataFrame([("http://h.cn/a/b", html)], "url string, html string"), ["extra.cn"]).collect()
    got = [r.link for r in sorted(rows, key=lambda r: r.position)]
    assert got[:4] == ["http://h.cn/a/rel.html", "http://h.cn/root?x=1", "http://h.cn/s", "http://extra.cn/z?k"]
    assert len(got) == 209 and got[-1] == "http://h.cn/n/204"
    page = spark.createDataFrame([("http://extra.cn/a", html)], "url string, html string")
    cut = L.page_links(page, base_url="http://h.cn/", max_links=3).collect()
    assert [r.link for r in sorted(cut, key=lambda r: r.position)] == ["http://h.cn/s"]
    assert all(urlsplit(u).netloc in ("h.cn", "extra.cn") for u in got)


def test_serp_engines(spark):
    pages = [
        ("https://www.baidu.com/s?wd=x", '<div mu="http://a.cn/1"></div><h3><a href="http://www.baidu.com/link?u=1">L</a></h3>'
         '<h3 class=t> <a x href="http://b.cn/2"> <em>标</em>题 </a></h3><div data-url="http://c.cn/3">', [("http://a.cn/1", ""), ("http://c.cn/3", ""), ("http://b.cn/2", "标题")]),
        ("https://cn.bing.com/search?q=x", '<li class="b_algo x"><h2><a h href="http://a.cn/1">一</a></h2></li><a class=y href="http://z.cn/">', [("http://a.cn/1", "一")]),
        ("https://cn.bing.com/search?q=y", '<a class=y href="http://z.cn/"><a class=y href="http://z.cn/"><a class=y href="http://q.bing.com/">', [("http://z.cn/", "")]),
        ("https://www.so.com/s?q=x", '<h3 class="r"><a h href="http://a.cn/1">一</a></h3><h3><a h href="http://a.cn/1">二</a></h3>', [("http://a.cn/1", "一")]),
        ("https://x.search.cn/s?q=x", '<a b href="http://x.search.cn/1"><a b href="http://a.cn/1">', [("http://a.cn/1", "")]),
    ]
    df = spark.createDataFrame([(u, h) for u, h, _ in pages], "url string, html string")
    got = {}
    for r in L.serp_results(df).orderBy("serp_url", "position").collect():
        got.setdefault(r.serp_url, []).append((r.url, r.title))
    assert got == {u: want for u, _, want in pages}


def test_frontier_depths(spark):
    pages = [
        ("1", "http://h.cn/", '<a href="/a"></a><a href="/b"></a>'), ("2", "http://h.cn/a", '<a href="/c"></a><a href="/"></a>'),
        ("3", "http://h.cn/c", '<a href="/d"></a><a href="/a"></a>'), ("4", "http://h.cn/b", '<a href="/c"></a>'),
    ]
    df = spark.createDataFrame([(*p, None) for p in pages], "id string, url string, html string, crawled_at timestamp")
    seeds = spark.createDataFrame([("http://h.cn/",)], "url string")
    out = {r.url[11:]: r.depth for r in L.crawl_frontier(df, seeds, 5).collect()}
    assert out == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/d": 3}
    assert {r.url[11:] for r in L.crawl_frontier(df, seeds, 1).collect()} == {"/", "/a", "/b"}


def test_frontier_of_a_long_chain(spark):
    pages = [(str(i), f"http://h.cn/{i}", f'<a href="/{i + 1}"></a><a href="/{max(i - 3, 0)}"></a>', None) for i in range(200)]
    df = spark.createDataFrame(pages, "id string, url string, html string, crawled_at timestamp")
    out = {r.url: r.depth for r in L.crawl_frontier(df, spark.createDataFrame([("http://h.cn/0",)], "url string")).collect()}
    assert out == {f"http://h.cn/{i}": i for i in range(201)}


def test_frontier_of_a_page_with_many_links(spark):
    many = "".join(f'<a href="/n/{i}"></a>' for i in range(100_000))
    pages = [("1", "http://h.cn/", many, None), ("2", "http://h.cn/n/7", '<a href="/"></a><a href="/last"></a>', None)]
    df = spark.createDataFrame(pages, "id string, url string, html string, crawled_at timestamp")
    seeds = spark.createDataFrame([("http://h.cn/",), ("http://h.cn/",)], "url string")
    depths = L.crawl_frontier(df, seeds).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in depths} == {0: 1, 1: 100_000, 2: 1}


def test_a_level_shuffles_its_candidates_only(spark):
    from noticeworks.session import GrowingCut, cut_bucketed

    edges = cut_bucketed(spark.range(400).selectExpr("md5(string(id)) AS from_hash", "string(id + 1) AS link", "md5(string(id + 1)) AS link_hash"), "from_hash")
    visited = GrowingCut(spark.range(3).selectExpr("md5(string(id * 50)) AS url_hash", "string(id * 50) AS url", "0 AS depth"), "url_hash")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for depth in range(1, 4):
            step = L.next_level(edges, visited.rows(), depth)
            assert step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
            visited.add(step)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(int(r.url) for r in visited.rows().collect()) == sorted(b + k for b in (0, 50, 100) for k in range(4))
