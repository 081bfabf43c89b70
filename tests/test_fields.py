from datetime import datetime as dt

from pyspark.sql import functions as F

from noticeworks.functions import dates as D
from noticeworks.functions import encoding as E
from noticeworks.functions import fields as X
from noticeworks.functions import labelling as L
from noticeworks.functions import lists
from noticeworks.profile import ZH_TENDER as Z


def test_publish_date(evaluate):
    got = evaluate(
        lambda v: X.publish_date(v, Z),
        "发布时间：2024-13-40",
        "发布时间：2024年13月1日 然后 2024-03-05",
        "公告日期：2024-01-02 发布时间：2024-01-03",
        "没有 2024年3月5日",
        "发布时间：２０２４年３月５日",
        "发布时间：" + "x" * 90 + "2024-03-05",
        "x" * 2000 + "2024-03-05",
        "0000-01-01",
    )
    assert got == [
        None, dt(2024, 3, 5), dt(2024, 1, 3), dt(2024, 3, 5), dt(2024, 3, 5), dt(2024, 3, 5), dt(2024, 3, 5), None,
    ]


def test_hint_beyond_span_uses_next_hint(evaluate):
    text = "发布时间" + "x" * 100 + "公示时间 2024-05-06 " + "开头 2020-01-01"
    assert evaluate(lambda v: X.publish_date(v, Z), "2020-01-01 " + text) == [dt(2024, 5, 6)]


def test_bid_times(evaluate):
    got = evaluate(
        lambda v: X.bid_end_time(v, Z),
        "开标时间：2024年4月1日9时30分 投标截止：2024年4月2日",
        "截止时间 2024-04-01 25:00",
        "截止时间 2024-04-01 08:05",
        "报名时间 2024-04-01",
    )
    assert got == [dt(2024, 4, 2), dt(2024, 4, 1), dt(2024, 4, 1, 8, 5), None]
    assert evaluate(lambda v: X.bid_start_time(v, Z), "报名时间 2024-04-01") == [dt(2024, 4, 1)]


def test_amount(evaluate):
    got = evaluate(
        lambda v: X.amount(v, Z),
        "预算金额：1,234.5万元", "合同金额 2亿元", "中标价：100元", "费用 30元", "预算 1.2.3元 另 5万元",
        "总金额：1，000元", "预算：１２万元",
    )
    assert [tuple(g) if g else None for g in got] == [
        ("1234.5万元", 12345000.0), ("2亿元", 2e8), ("100元", 100.0), None, ("5万元", 50000.0), ("1000元", 1000.0),
        ("１２万元", 120000.0),
    ]


def test_bidder_and_location(evaluate):
    got = evaluate(
        lambda v: X.bidder(v, Z),
        "招标人：某某 单位，后面", "甲方：A", "采购人:" + "长" * 51 + "。", "采购人:" + "长" * 50 + "。", "业主 无",
    )
    assert got == ["某某单位", None, None, "长" * 50, None]
    got = evaluate(
        lambda v: X.location(v, Z),
        "项目地点：四川省 内江市；其他", "在内江市 东兴区 和 内江市 威远县 隆昌市", "市 区", "无",
    )
    assert got == ["四川省内江市", "在内江市、东兴区、内江市", None, None]


def test_contact(evaluate):
    got = evaluate(
        lambda v: X.contact(v, Z),
        "联系人：张三丰 联系电话：028-1234567 13812345678", "手机号13812345678", "写信 a.b+c@x-y.com.cn。", "无",
    )
    assert got == [
        "联系人: 张三丰; 电话: 028-1234567 13812345", "手机: 13812345678", "邮箱: a.b+c@x-y.com.cn", None,
    ]


def test_title_steps(spark):
    page = "<meta name='ArticleTitle' content='{a}'><meta property='og:title' content='{o}'><title>{t}</title><h1>{h}</h1>"
    rows = [
        ("很好的标题 - 政采网", page.format(a="甲甲甲甲", o="", t="", h=""), "正文", "很好的标题"),
        ("首页", page.format(a="文章标题一", o="x", t="x", h="x"), "正文", "文章标题一"),
        ("", page.format(a="短", o="另一标题二", t="x", h="x"), "正文", "另一标题二"),
        ("", page.format(a="短", o="短", t="页面<b>标题</b>三 | 政采网", h="x"), "正文", "页面 标题 三"),
        ("", page.format(a="短", o="短", t="某某首页", h="大标题四"), "正文", "大标题四"),
        ("首页", page.format(a="短", o="短", t="短", h="短"), "正文", "首页"),
        ("", page.format(a="短", o="短", t="短", h="短"), "正文第一行 后面", "正文第一行 后面"),
        ("长" * 600, "", "正文", "长" * 500),
        (None, "", "", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, h string, t string, want string")
    out = df.select("want", X.title(F.col("s"), F.col("h"), F.col("t"), Z).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_notice_type_priority(evaluate):
    got = evaluate(lambda v: X.notice_type(F.lit(""), v, Z), "招标公告 中标公告", "招标文件", "无", "采购意向 终止公告")
    assert got == ["中标", "招标", None, "废标公告"]


def test_model_type_wins_above_threshold(spark):
    df = spark.createDataFrame([("招标公告", "合同", 0.6), ("招标公告", "合同", 0.61)], "t string, m string, c double")
    out = df.select(X.notice_type(F.lit(""), F.col("t"), Z, F.col("m"), F.col("c")).alias("x")).collect()
    assert [r.x for r in out] == ["招标", "合同"]


def test_relevance_cascade(spark):
    rows = [
        (["a"], 3, None, None, None), ([], 3, None, None, None), ([], 0, None, None, None), (["a"], 3, 0.5, None, None),
        (["a"], 3, None, "irrelevant", 0.71), (["a"], 3, None, "irrelevant", 0.7),
    ]
    df = spark.createDataFrame(rows, "m array<string>, n int, s double, l string, c double")
    rel = X.relevance(F.col("m"), F.col("n"), score=F.col("s"), label=F.col("l"), confidence=F.col("c"))
    got = [tuple(r.r) for r in df.select(rel.alias("r")).collect()]
    assert got == [
        (True, 0.33, "keyword"), (False, 0.0, "keyword"), (None, None, "keyword"), (True, 0.5, "score"),
        (False, 0.29, "classifier"), (True, 0.33, "classifier"),
    ]


def test_page_flags(evaluate):
    pages = (None, "", "x" * 1023, "x" * 1024, "x" * 2000 + "robot check", "x" * 8192 + "robot check")
    assert evaluate(X.is_antibot_page, *pages) == [True, True, False, False, True, True]
    assert evaluate(lambda c: X.is_antibot_page(c, 1024), *pages) == [True, True, True, False, True, True]
    assert evaluate(lambda c: X.antibot_reason(c, 1024), None, "x", "x" * 1024 + "robot check", "x" * 1024) == ["missing", "short", "phrase", None]
    assert evaluate(X.antibot_reason, None, "", "x", "a robot check") == ["missing", "missing", None, "phrase"]


def test_list_and_feed_dates(evaluate):
    as_of = F.lit(dt(2023, 6, 1))
    got = evaluate(
        lambda v: D.list_date(v, as_of), "【2024-3-5】", "2024/03/05 10:11:12", "2024-03-05 10:11", "2024.03.05",
        "03-05", "3/5", "02-29", "2024-02-30", "x", None,
    )
    assert got == [
        dt(2024, 3, 5), dt(2024, 3, 5, 10, 11, 12), dt(2024, 3, 5, 10, 11), dt(2024, 3, 5), dt(2023, 3, 5),
        dt(2023, 3, 5), None, None, None, None,
    ]
    assert evaluate(D.feed_date, "2024-03-05 10:11", " 2024/3/5 ", "2024-03-05 10:11:60") == [None, dt(2024, 3, 5), None]


def test_replies_and_prompts(evaluate):
    got = evaluate(
        L.read_reply, '{"label": 1, "reason": "好"}', '```json\n{"label": "0"}\n```', '{"label": 2}', "no", '{"reason": 1}', None
    )
    assert [tuple(g) if g else None for g in got] == [(1, "好"), (0, ""), None, None, None, None]
    [filled] = evaluate(lambda v: L.prompt("{title} {{x}} {later}", title=v), "{later}")
    assert filled == "{later} {x} {later}"


def test_suffix_and_days(evaluate):
    assert evaluate(lists.strip_region_suffix, "龙华区", "城区", "观澜街道", "东兴", "市区") == ["龙华", "城区", "观澜", "东兴", "市区"]
    assert [lists.filter_days(3, 5), lists.filter_days(0, 0)] == [95, 90]


def test_decode_page():
    assert E.decode_page("<meta charset=gbk>中文".encode("gbk"), None) == "<meta charset=gbk>中文"
    assert E.decode_page("中文".encode("gbk"), "ISO-8859-1") == "中文"
    assert E.decode_page("中文".encode("big5"), "big5") == "中文"
    assert E.decode_page(b"\xff\xff\xff", None) == "�" * 3


def test_mojibake(spark):
    good = "这是一个测试文档内容很多很多"
    bad = good.encode().decode("latin-1")
    rows = [(f"{bad} x {bad} y {bad}",), (f"{bad} x {bad} y {bad}一",), ("plain english",), (good,)]
    out = E.fix_mojibake(spark.createDataFrame(rows, "html string")).collect()
    assert [r.action for r in out] == ["fixed", "unfixable", "clean", "clean"]
    assert out[0].html == f"{good} x {good} y {good}"
