import random
import re
from dataclasses import replace
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from driver_checks.model import Model
from driver_checks.pages import listing_pages
from noticeworks import schemas
from noticeworks.operators import extract as E
from noticeworks.operators import merge as M
from noticeworks.plans import jobs
from noticeworks.profile import ZH_TENDER

HAN = "本项目资金来源为财政资金，出资比例为百分之百，现对该项目进行公开说明，欢迎各单位参加。"
AS_OF = dt(2024, 6, 1)


def plain_listing(html, pattern=ZH_TENDER.list_date):
    """Listing rule as a plain loop, for comparison."""
    found = list(re.finditer(r"<a\b[^>]*>(.*?)</a>", html, re.I | re.S))
    if len(found) < 8:
        return None
    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s))
    text = dated = 0
    for m in found:
        inner = clean(m.group(1)).strip()
        if len(inner) < 4 or not re.search("[一-鿿]", inner):
            continue
        text += 1
        around = (inner, clean(html[max(0, m.start() - 220):m.start()])[-120:], clean(html[m.end():m.end() + 220])[:120])
        dated += any(re.search(pattern, a) for a in around)
    if text < 8 or dated < 8:
        return None
    if dated >= 15:
        return text, dated, round(dated / text, 3), "abs>=15"
    return (text, dated, round(dated / text, 3), "ratio>=0.30") if dated / text >= 0.30 else None


def link(i, before="", after="", text="公告标题内容"):
    return f'<li>{before}<a class="x" href="/{i}">{text}{i}</a>{after}</li>\n'


PAD = "<p>" + "填" * 230 + "</p>"

LISTINGS = {
    "seven": "".join(link(i, "2024-03-15") for i in range(7)),
    "eight": "".join(link(i, "2024-03-15") for i in range(8)),
    "after": "".join(link(i, "", "<span>3月15日</span>") for i in range(9)),
    "inside": "".join(PAD + link(i, text="关于2025年10月17日的公示") for i in range(9)),
    "low_ratio": "".join(link(i, PAD + "2024/3/15") for i in range(8)) + "".join(PAD + link(i) for i in range(30)),
    "edge_ratio": "".join(PAD + link(i, "2024/3/15", PAD) for i in range(9)) + "".join(PAD + link(i, "", PAD) for i in range(21)),
    "fifteen": "".join(PAD + link(i, "2024/3/15", PAD) for i in range(15)) + "".join(PAD + link(i, "", PAD) for i in range(60)),
    "far_date": "".join("2024-03-15" + "远" * 121 + link(i) for i in range(12)),
    "near_date": "".join("2024-03-15" + "近" * 100 + link(i) for i in range(12)),
    "short_text": "".join(f"2024-03-15<a>下页</a>" for i in range(20)),
    "latin": "".join(f"2024-03-15<a>next page</a>" for i in range(20)),
    "tiny": "<a>一二三四1</a>" * 200 + "1-1",
    "nested": "".join(f'<A HREF="x"><b>公告</b> <i>内容{i}</i></A>2024.3.15 ' for i in range(10)),
    "none": HAN,
}


def test_listing_matches_plain_loop(spark):
    df = spark.createDataFrame(list(LISTINGS.items()), "name string, html string")
    rows = df.select("name", E.listing_info(F.col("html")).alias("i")).collect()
    got = {r.name: tuple(r.i) if r.i else None for r in rows}
    assert got == {name: plain_listing(html) for name, html in LISTINGS.items()}
    assert got["seven"] is None and got["eight"] and got["low_ratio"] is None and got["edge_ratio"]
    assert got["far_date"][:2] == (12, 11)  # a date also counts for the link before it


@pytest.mark.parametrize("pattern", [ZH_TENDER.list_date, r"3-15$", r"3-15(?!\s)", r"3-15\b"])
def test_listing_of_mixed_pages(spark, pattern):
    """Dates before, in and after anchors, near and far, behind tags, open tags and astral characters."""
    rng = random.Random(4)
    bits = ["2024-03-15", " 2024-3-15 ", "<b>3-15</b>", "<i\n title='3-15'>", "<", ">", " \u3000\n", "远" * 60, "𠀀" * 50, "x <y " * 9, "&nbsp;", ""]
    pages = {str(k): "".join(link(i, rng.choice(bits) + rng.choice(bits), rng.choice(bits) + rng.choice(bits), rng.choice(["公告标题内容", "公告 <b>3-15</b>", "下"])) for i in range(rng.choice([9, 14, 40]))) for k in range(60)}
    profile = replace(ZH_TENDER, list_date=pattern)
    rows = spark.createDataFrame(list(pages.items()), "name string, html string").select("name", E.listing_info(F.col("html"), profile).alias("i")).collect()
    assert {r.name: tuple(r.i) if r.i else None for r in rows} == {name: plain_listing(html, pattern) for name, html in pages.items()}
    assert pattern != ZH_TENDER.list_date or sum(r.i is not None for r in rows) > 20


def test_contexts_are_cut_when_needed_alone(spark):
    """Pages are dealt, and the text before anchors (the split) is cut in a branch for pages with undated anchors."""
    plan = listing_pages(Model(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert 0 < plan.index("exists(") < plan.index("split(")


def page(i, url, html, source_type="website", title="", at=1):
    return (str(i), url, html, "", dt(2024, 1, at), "词", "源", (title, source_type, None))


GOOD = f"<title>某县道路工程招标公告</title><p>发布时间：2024-03-05 {HAN}招标人：某县交通局，预算：5万元。</p>"


def pages_table(spark):
    rows = [
        page(1, "http://a.cn/1", GOOD), page(2, "https://www.baidu.com/s?wd=x", GOOD), page(3, "http://a.cn/3", "<p>" + "x" * 60 + "</p>"),
        page(4, "http://a.cn/4", "<p>" + HAN * 2 + "</p>" + LISTINGS["eight"], title="栏目"), page(5, "http://a.cn/5", GOOD, "search_engine"),
        page(6, "http://a.cn/6", "x" * 49), page(7, "http://a.cn/1", "<p>old</p>" + "x" * 60, at=1), page(8, "http://a.cn/8", GOOD, at=2),
    ]
    return spark.createDataFrame(rows, schemas.RAW_PAGES).where("id <> '7'")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_outcomes(spark):
    out = {r.mongo_doc_id: r for r in jobs.parse_updates(pages_table(spark), empty(spark, schemas.PARSED_RESULTS), ["财政", "绿化"], "all").collect()}
    assert set(out) == {"1", "2", "3", "4", "6", "8"}
    assert (out["6"].outcome, out["6"].is_relevant, out["6"].parse_errors[:9]) == ("too_short", False, "too_short")
    ok = out["1"]
    assert (ok.title, ok.publish_date, ok.bidder, ok.amount, ok.amount_value) == (
        "某县道路工程招标公告", dt(2024, 3, 5), "某县交通局", "5万元", 50000.0,
    )
    assert (ok.is_relevant, ok.relevance_score, ok.matched_keywords, ok.notice_type, ok.parse_errors) == (True, 0.5, "财政", "招标", None)
    serp = out["2"]
    assert (serp.notice_type, serp.relevance_score, serp.is_relevant, serp.summary) == ("search_serp", 0.0, False, None)
    assert serp.parse_errors.startswith("search_serp:")
    bad = out["3"]
    assert (bad.notice_type, bad.relevance_score, bad.is_relevant) == (None, None, False)
    assert bad.parse_errors.startswith("content_invalid:")
    listed = out["4"]
    assert (listed.notice_type, listed.title, listed.relevance_score) == ("list_page", "栏目", 0.0)
    assert "链接条目=8, 含日期条目=8, 占比=1.0, 命中规则=ratio>=0.30" in listed.parse_errors


def test_no_keywords_means_unknown(spark):
    out = E.extract_notices(pages_table(spark).where("id = '1'"), []).collect()[0]
    assert (out.is_relevant, out.relevance_score, out.matched_keywords) == (None, None, "")


def test_keyword_table_and_case(spark):
    words = spark.createDataFrame([(2, "交通局", True), (1, "道路", True), (3, "绿化", False)], schemas.SEARCH_KEYWORDS)
    out = E.extract_notices(pages_table(spark).where("id = '1'"), words).collect()[0]
    assert (out.matched_keywords, out.relevance_score) == ("道路,交通局", 1.0)


def test_scorer_and_registered_field(spark):
    saved = dict(E._FIELDS)
    try:
        E.register_field("shout", lambda text, html, ctx, p: F.upper(ctx["source_name"]))
        E.register_field("reserved", lambda text, html, ctx, p: F.lit(None).cast("string"))
        out = E.extract_notices(
            pages_table(spark).where("id = '1'"), ["x"],
            scorer=lambda df: df.withColumns({"score": F.lit(0.71234), "model_type": F.lit("合同"), "type_confidence": F.lit(0.9)}),
        ).collect()[0]
    finally:
        E._FIELDS.clear()
        E._FIELDS.update(saved)
    assert (out.is_relevant, out.relevance_score, out.notice_type, out.shout, out.reserved) == (True, 0.7123, "合同", "源", None)


def parsed_row(spark, *rows):
    base = empty(spark, schemas.PARSED_RESULTS)
    cols = ["id", "url", "url_hash", "parse_errors", "summary", "notice_type", "created_by", "title"]
    df = spark.createDataFrame(rows, "id bigint, url string, parse_errors string, summary string, notice_type string, created_by string, title string")
    return base.unionByName(df.withColumn("url_hash", F.md5("url")).select(*cols), allowMissingColumns=True)


def test_modes_partition_pages(spark):
    parsed = parsed_row(
        spark, (1, "http://a.cn/1", None, "s", "t", "u", "x"), (3, "http://a.cn/3", "content_invalid: x", None, None, "u", "x"),
        (4, "http://a.cn/4", "", None, None, "u", "x"),
    )
    keyed = M.with_page_keys(pages_table(spark))
    ids = lambda mode: {r.id for r in M.select_pages_to_parse(keyed, parsed, mode).collect()}
    assert ids("all") == {"1", "2", "3", "4", "6", "8"}
    assert ids("unparsed_only") == {"2", "6", "8"}
    assert ids("errors_only") == {"3"}
    assert ids("unparsed_and_errors") == ids("whatever") == {"2", "3", "6", "8"}


def test_parse_job_keeps_fields_of_bad_reparse(spark):
    parsed = parsed_row(
        spark, (77, "http://a.cn/3", "content_invalid: x", "kept", "合同", "me", "old"), (78, "http://zz.cn", None, "s", "t", "me", "y"),
    )
    out = {r.url: r for r in jobs.parse_job(pages_table(spark), parsed, ["财政"], AS_OF).collect()}
    assert len(out) == 7
    bad = out["http://a.cn/3"]
    assert (bad.id, bad.summary, bad.notice_type, bad.created_by, bad.is_relevant) == (77, "kept", "合同", "me", False)
    assert out["http://zz.cn"].title == "y"
    fresh = sorted((r.url_hash, r.id) for r in out.values() if r.id > 78)  # new ids follow the largest, by url_hash
    assert [i for _, i in fresh] == [79, 80, 81, 82, 83] and out["http://a.cn/1"].created_at == AS_OF
    again = jobs.parse_job(pages_table(spark), jobs.parse_job(pages_table(spark), parsed, ["财政"], AS_OF), ["财政"], AS_OF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.values())) or again.count() == 7


def test_rejudge(spark):
    parsed = parsed_row(
        spark, (1, "http://a.cn/1", None, "s", None, "u", "招标公告"), (2, "https://www.baidu.com/s?x", None, "s", None, "u", "x"),
        (3, "http://a.cn/9", None, " ", None, "u", ""), (4, "http://a.cn/4", None, "s", "合同", "u", "x"), (5, "http://a.cn/5", "e", "s", "list_page", "u", "x"),
    ).withColumn("mongo_doc_id", F.when(F.col("id") == 4, F.lit("4")).when(F.col("id") == 1, F.lit("1")))
    out = {
        r.id: r for r in jobs.rejudge_job(parsed, pages_table(spark), ["财政"], lambda df: df.withColumn("score", F.lit(0.49999))).collect()
    }
    assert {i: r.action for i, r in out.items()} == {1: "scored", 2: "serp", 3: "blank", 4: "listing", 5: "skipped"}
    assert (out[1].is_relevant, out[1].relevance_score, out[1].notice_type, out[1].matched_keywords) == (False, 0.5, "招标", "财政")
    assert (out[2].notice_type, out[2].relevance_score, out[2].is_relevant) == ("search_serp", 0.0, False)
    assert out[4].notice_type == "list_page" and out[4].parse_errors.endswith("ratio>=0.30）")
    try:
        jobs.rejudge_job(parsed, pages_table(spark), [], None)
    except ValueError as e:
        assert "model" in str(e)
    else:
        raise AssertionError("a missing model must fail the job")


def test_keywords_count_once_for_any_number(spark):
    """Inline and joined keywords give the same hits, order and count."""
    words = ["zebra", "apple", "zebra", "", "none", "AP"]
    texts = spark.createDataFrame([("a", "an Apple and a zebra"), ("b", "nothing"), ("c", None)], "url_hash string, text string")
    few = spark.createDataFrame([(i, w, True) for i, w in enumerate(words)], "id int, keyword string, enabled boolean")
    more = few.union(spark.range(3000).selectExpr("cast(id + 100 as int)", "concat('word', id % 2600, repeat('x', cast(id % 300 as int)))", "true"))
    small = {r.url_hash: (r.matched, r.n_keywords) for r in E.with_keyword_hits(texts, few).collect()}
    listed = {r.url_hash: (r.matched, r.n_keywords) for r in E.with_keyword_hits(texts, words).collect()}
    large = {r.url_hash: r for r in E.with_keyword_hits(texts, more).collect()}
    assert small["a"] == listed["a"] == (["zebra", "apple", "AP"], 4)
    assert large["a"].matched == ["zebra", "apple", "AP"] and not large["b"].matched
    assert {r.n_keywords for r in large.values()} == {more.where("keyword <> ''").select("keyword").distinct().count()}
