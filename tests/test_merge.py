from datetime import datetime as dt

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import merge as M
from noticeworks.operators import reconcile as R

PAGE = "id string, url string, html string, content_hash string, crawled_at timestamp, search_query string, source_name string, meta struct<title: string, source_type: string>, note string"


def page(i, url, html, at=None, note=None):
    return (i, url, html, None, at and dt(2024, 1, at), "q", "s", ("t" + html, "website"), note)


def test_dedup(spark):
    rows = [page("1", "u", "a", 1), page("2", "u", "b", 3), page("3", "u", "c"), page("9", "v", "x", 2), page("8", "v", "y", 2), page("5", "w", "z")]
    df = spark.createDataFrame(rows, PAGE)
    newest = {r.url: r.id for r in M.dedup_pages(df).collect()}
    assert newest == {"u": "2", "v": "9", "w": "5"}
    assert {r.url: r.id for r in M.dedup_pages(df, "oldest").collect()} == {"u": "3", "v": "8", "w": "5"}
    once = M.dedup_pages(df)
    assert sorted(map(str, M.dedup_pages(once).collect())) == sorted(map(str, once.collect()))
    assert M.dedup_pages(df).columns == df.columns
    assert R.dup_report(df).first().asDict() == {"dup_urls": 2, "extra_docs": 3}
    assert R.dup_ratio(df).first().asDict() == {"documents": 6, "urls": 3, "ratio": 2.0, "needs_dedup": True}


def test_merge_pages(spark):
    base = spark.createDataFrame([page("1", "u", "a", 5, "kept"), page("2", "v", "b", 1, "kept")], PAGE)
    upd = spark.createDataFrame([page("9", "u", "late", 3), page("8", "v", "new", 2), page("7", "v", "newer", 4), page("6", "w", "first", 1)], PAGE).drop("note")
    out = {r.url: r for r in M.merge_raw_pages(base, upd).collect()}
    assert (out["u"].html, out["u"].id, out["u"].note) == ("a", "1", "kept")
    assert (out["v"].html, out["v"].id, out["v"].note, out["v"].meta.title) == ("newer", "2", "kept", "tnewer")
    assert (out["w"].id, out["w"].note) == ("6", None) and len(out["w"].content_hash) == 64
    twice = M.merge_raw_pages(M.merge_raw_pages(base, upd), upd)
    assert sorted(map(str, twice.collect())) == sorted(map(str, out.values()))


def test_upsert_ownership(spark):
    cols = "id bigint, url_hash string, title string, domain string, publish_date timestamp, search_query string, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([(1, "h1", "t1", "d1", None, "q1", dt(2024, 1, 1), None), (2, "h2", "t2", "d2", None, "q2", dt(2024, 1, 1), None)], cols)
    upd = spark.createDataFrame([(5, "h1", "n", "dx", dt(2024, 2, 2), None, dt(2024, 3, 1), None), (6, "h3", "n3", "d3", None, "q3", dt(2024, 3, 1), None)], cols)
    out = {r.url_hash: r for r in M.upsert_results(old, upd).collect()}
    assert (out["h1"].id, out["h1"].title, out["h1"].domain, out["h1"].search_query) == (1, "n", "d1", None)
    assert out["h2"].title == "t2" and out["h3"].id == 6


def test_ledger_keeps_first_visit(spark):
    old = spark.createDataFrame([(1, "u", "h", "q", 200, dt(2024, 1, 1))], schemas.VISITED_URLS)
    upd = spark.createDataFrame([(2, "u", "h", "q2", 404, dt(2024, 2, 1)), (3, "u", "h", "q3", 500, dt(2024, 3, 1)), (4, "v", "k", "q", 200, dt(2024, 3, 1))], schemas.VISITED_URLS)
    out = {r.url: r for r in M.merge_visited(old, upd).collect()}
    assert (out["u"].id, out["u"].status, out["u"].search_query, out["u"].visited_at) == (1, 500, "q3", dt(2024, 1, 1))
    assert len(out) == 2


def test_new_and_forced(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 5)], "url_hash string, position int")
    known = spark.createDataFrame([("b",), ("c",)], "url_hash string")
    assert [tuple(r) for r in M.unvisited(df, known).collect()] == [("a", 1)]
    forced = df.where("url_hash = 'c'")
    out = {r.url_hash: r.forced for r in M.union_forced(df, forced, known).collect()}
    assert out == {"a": False, "c": True}


def test_pending_and_orphans(spark):
    res = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, url_hash string")
    par = spark.createDataFrame(
        [(1, "b", None, None), (2, "x", "search_serp", "search_serp: z"), (3, "y", "合同", None), (4, "z", None, "content_invalid: q"), (5, "w", None, None)],
        "id bigint, url_hash string, notice_type string, parse_errors string",
    )
    pages = spark.createDataFrame([(1,)], "id bigint")
    health = R.parse_health(res, par, pages).first().asDict()
    assert health == {"results": 2, "parsed_ok": 3, "parsed_error": 2, "pending": 1, "orphans": 4, "raw_pages": 1}
    assert {r.id for r in R.drop_orphans(par, res).collect()} == {1, 3, 5}
    assert {r.id for r in R.drop_orphans(par, res, "all").collect()} == {1}
    assert [tuple(r) for r in R.orphan_by_type(par, res).collect()] == [("<null>", 2), ("search_serp", 1), ("合同", 1)]


def test_hot_url_is_combined_before_the_shuffle(spark):
    pages = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.lit("x").alias("html"), F.lit(None).cast("timestamp").alias("crawled_at"),
    )
    plan = M.dedup_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    assert M.dedup_pages(pages).count() == 1000 - 334 + 1
