from collections import Counter
from datetime import datetime as dt
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import cleanup, crawl, ml
from noticeworks.operators import planning as P
from noticeworks.operators import samples as S


def test_split_is_exact_per_class(spark):
    rows = [(f"h{i}", 0 if i % 10 else 1) for i in range(997)] + [("only", 5)]
    df = spark.createDataFrame(rows, "url_hash string, label int")
    got = {r.url_hash: r.split for r in S.stratified_split(df).collect()}
    assert len(got) == len(rows)
    for label in (0, 1, 5):
        keys = sorted((h for h, la in rows if la == label), key=lambda h: md5(f"42:{h}".encode()).hexdigest())
        n = max(1, int(len(keys) * 0.15))
        assert {h for h in keys if got[h] == "val"} == set(keys[:n])


def test_metrics_and_weights(spark):
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "prediction int, label int")
    m = S.binary_metrics(scored).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.accuracy) == (2, 1, 1, 1, 0.6) and m.precision == m.recall == pytest.approx(2 / 3)
    zero = S.binary_metrics(scored.where("false")).first()
    assert (zero.accuracy, zero.precision, zero.recall, zero.f1) == (0, 0, 0, 0)
    w = {r.label: (r.sample_weight, r.class_weight) for r in S.class_weights(spark.createDataFrame([(1,), (1,), (1,), (0,)], "label int")).collect()}
    assert w == {1: (1 / 3, 4 / 6), 0: (1.0, 2.0)}


@pytest.mark.parametrize(("pos", "neg", "strategy"), [(15, 5, "none"), (16, 5, "both"), (5, 16, "both"), (3, 0, "none")])
def test_balance_strategy(spark, pos, neg, strategy):
    df = spark.createDataFrame([(1, "t", "c")] * pos + [(0, "t", "c")] * neg + [(1, " ", "")], "label int, title string, content string")
    row = S.label_balance(df).first()
    assert (row.strategy, row.total, row.enough) == (strategy, pos + neg, pos + neg >= 20 and min(pos, neg) >= 5)


def sample_tables(spark):
    parsed = spark.createDataFrame(
        [(1, "a", "招标", None, "1", dt(2024, 1, 1)), (2, "b", None, None, "2", dt(2024, 1, 2)), (3, "c", "list_page", None, "3", dt(2024, 1, 3)),
         (4, "d", "招标", "e", "4", dt(2024, 1, 4)), (5, "e", "中标", None, None, dt(2024, 1, 5)), (6, "f", "合同", None, "6", None)],
        "id bigint, url_hash string, notice_type string, parse_errors string, mongo_doc_id string, created_at timestamp",
    ).withColumns({"title": F.concat(F.lit("t\x00"), "url_hash"), "summary": F.lit(""), "url": F.col("url_hash"), "search_query": F.lit(None).cast("string"), "source_name": F.lit("s")})
    results = spark.createDataFrame([("a", "x.cn"), ("e", "abcx.cn"), ("f", "g.X.cn")], "url_hash string, domain string")
    pages = spark.createDataFrame([("1", "<p>正文一</p>"), ("6", "<p></p>")], "id string, html string")
    return parsed, results, pages


def test_import(spark):
    parsed, results, pages = sample_tables(spark)
    none = spark.createDataFrame([], "url_hash string")
    out = {r.parsed_id: (r.title, r.content) for r in S.import_samples(parsed, results, pages, none).collect()}
    assert out == {1: ("ta", "正文一"), 5: ("te", "te"), 6: ("tf", "tf")}
    known = spark.createDataFrame([("a",)], "url_hash string")
    ids = lambda **kw: {r.parsed_id for r in S.import_samples(parsed, results, pages, kw.pop("samples", none), **kw).collect()}
    assert ids(samples=known) == {5, 6}
    assert ids(domain=".X.cn") == {1, 6}
    assert ids(include_low_quality=True) == {1, 2, 3, 4, 5, 6}
    assert ids(include_low_quality=True, limit=2) == {6, 5}
    assert ids(domain="nowhere.cn") == set()


def test_training_text_and_labels(spark):
    df = spark.createDataFrame([(1, "标题", "正文\n二", 1), (2, "", "x" * 3000, 0), (3, "", " ", 1), (4, "t", "c", None)], "id bigint, title string, content string, label int")
    lines = {r.value for r in S.export_training_text(df).collect()}
    assert lines == {"__label__relevant 标题 标题 标题 正文 二", "__label__irrelevant " + "x" * 3000}
    assert {r.value for r in S.export_training_text(df, 2000).collect()} >= {"__label__irrelevant " + "x" * 2000}
    df = df.withColumns({"labeled_by": F.lit(None).cast("string"), "labeled_at": F.lit(None).cast("timestamp")})
    cmds = spark.createDataFrame([(4, 0, "ai", dt(2024, 1, 1)), (4, 1, "admin", dt(2024, 1, 2)), (1, 7, "admin", dt(2024, 1, 2))], "id bigint, label int, labeled_by string, at timestamp")
    out = {r.id: (r.label, r.labeled_by) for r in S.apply_labels(df, cmds).collect()}
    assert out == {1: (1, None), 2: (0, None), 3: (1, None), 4: (1, "admin")}


def test_sampler_draws_with_replacement(spark):
    """As many rows as there are, both classes alike, every row of the small class, weights of the sizes before."""
    df = spark.range(1000).selectExpr("md5(cast(id as string)) as url_hash", "cast(id < 100 as int) as label", "'t' as title", "'c' as content")
    drawn = S.with_balance(df, "both")
    rows = {r.label: (r.n, r.urls, r.w) for r in drawn.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("url_hash").alias("urls"), F.first("weight").alias("w")).collect()}
    assert rows[1][0] == 500 and rows[1][1] == 100 and 420 < rows[0][0] == rows[0][1] < 580
    assert (round(rows[0][2], 3), rows[1][2]) == (0.556, 5.0)
    again = S.with_balance(df.repartition(7), "both")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))


def test_uncertain(spark):
    df = spark.createDataFrame([(i, None if i else 1, f"t{i}", "c", dt(2024, 1, 1 + i % 28)) for i in range(100)], "id bigint, label int, title string, content string, created_at timestamp")
    df = df.withColumns({"url": F.lit("u"), "search_query": F.lit(None).cast("string"), "source_name": F.lit(None).cast("string")})
    out = S.uncertain_topk(df, lambda d: d.withColumn("score", F.col("id") / 100), take=5).collect()
    assert [r.id for r in out] == [50, 49, 51, 48, 52]
    newest = S.uncertain_topk(df, lambda d: d.withColumn("score", F.col("id") / 100), scan=4, take=5).collect()
    assert {r.id for r in newest} <= {27, 55, 83}


def test_batch_scores_keep_going(spark):
    def predict(texts):
        if texts.str.contains("boom").any():
            raise RuntimeError("boom")
        return texts.str.len() / 100

    df = spark.createDataFrame([("t", "abc")], "title string, text string")
    assert [r.score for r in ml.score_with(df, predict).collect()] == [0.11]
    bad = spark.createDataFrame([("boom", "abc")], "title string, text string")
    assert [(r.score, r.score_error) for r in ml.score_with(bad, predict).collect()] == [(None, "RuntimeError: boom")]
    assert [(r.score, r.score_error) for r in ml.score_with(df, lambda t: [1, 2]).collect()] == [(None, "2 scores for 1 texts")]


def test_training(spark):
    rows = [(f"h{i}", i % 2, "道路工程招标" if i % 2 else "绿化养护通知", "内容" + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "url_hash string, label int, title string, content string")
    model, metrics = ml.train_relevance(df, features=1 << 10, iterations=5)
    assert metrics.first().f1 == 1.0
    scores = ml.score_text(df.limit(4), model, text="content").collect()
    assert [r.score > 0.5 for r in scores] == [bool(r.label) for r in scores]
    with pytest.raises(ValueError):
        ml.train_relevance(df.limit(5))


def plan_tables(spark):
    src = [(2, "网站", "government", None, 0, True), (1, "引擎一", "search_engine", "http://x", 5, True), (3, "引擎二", "search_engine", "http://y", 0, True),
           (4, "关", "search_engine", "http://z", 5, False), (5, "空", "search_engine", None, 5, True)]
    sources = spark.createDataFrame(src, "id bigint, name string, source_category string, search_url_template string, max_pages int, enabled boolean")
    kws = spark.createDataFrame([(1, "甲", True), (7, "乙", True), (8, "丙", False)], schemas.SEARCH_KEYWORDS)
    regions = spark.createDataFrame([(1, "东兴区", None, "district", None, False), (2, "田家镇", None, "town", 1, True), (3, "内江市", None, "city", None, True)], schemas.SEARCH_REGIONS)
    suffixes = spark.createDataFrame([(1, "招标", True), (2, "采购", True)], schemas.SEARCH_SUFFIXES)
    return sources, kws, regions, suffixes


def test_query_plan(spark):
    sources, kws, regions, suffixes = plan_tables(spark)
    want = ["[BFS] 网站"] + [f"{k} {r} {s}" for _ in range(2) for k in ("甲", "乙") for r in ("东兴区 田家镇", "内江市") for s in ("招标", "采购")]
    out = P.plan_queries(sources, kws, regions, suffixes).orderBy("query_no").collect()
    assert [r.query for r in out] == want and [r.query_no for r in out] == list(range(1, 18))
    assert [out[0].estimated_pages, out[1].estimated_pages, out[9].estimated_pages] == [50, 5, 10]
    same = P.query_combos(sources, kws, regions, suffixes).orderBy("query_no").collect()
    assert [tuple(r) for r in same] == [tuple(r) for r in out]
    capped = P.plan_queries(sources, kws, regions, suffixes, cap=3, skip=2).orderBy("query_no").collect()
    assert [(r.query_no, r.source_id, r.query) for r in capped] == [
        (3, 1, want[2]), (4, 1, want[3]), (5, 3, want[1]), (6, 3, want[2]), (7, 3, want[3]),
    ]
    bare = P.plan_queries(sources, kws, regions.where("false"), suffixes.where("false")).orderBy("query_no").collect()
    assert [r.query for r in bare] == ["[BFS] 网站", "甲", "乙", "甲", "乙"]
    assert P.plan_queries(sources, kws.where("false"), regions, suffixes).count() == 1


def test_incremental_stop(spark):
    rows = [("a", p, n) for p, n in enumerate([3, 0, 1, 0, 0, 9, 0, 0], 1)] + [("b", p, n) for p, n in enumerate([0, 1, 0, 1], 1)] + [("c", 1, 0), ("c", 2, 0), ("c", 3, 5)]
    df = spark.createDataFrame([(s, "k", "m", p, n) for s, p, n in rows], "source string, category string, month string, page int, new int")
    got = Counter(r.source for r in crawl.incremental_stop(df).collect())
    assert got == {"a": 5, "b": 4, "c": 2}
    assert Counter(r.source for r in crawl.incremental_stop(df, patience=1).collect()) == {"a": 2, "b": 1, "c": 1}


def test_incremental_stop_with_gaps_and_repeats(spark):
    import random

    rng, rows, want = random.Random(4), [], []
    for seg in range(60):
        pages = sorted(rng.sample(range(500), rng.randrange(1, 60)))
        visits = {p: [rng.choice([0, 0, 0, 1]) for _ in range(rng.choice([1, 1, 1, 3]))] for p in pages}
        run, stop = 0, None
        for p in pages:
            run = 0 if sum(visits[p]) else run + 1
            if run == 3:
                stop = p
                break
        for p in pages:
            rows += [(f"s{seg}", "k", "m", p, n) for n in visits[p]]
            want += [(f"s{seg}", p)] * len(visits[p]) if stop is None or p <= stop else []
    df = spark.createDataFrame(rows, "source string, category string, month string, page int, new int")
    out = crawl.incremental_stop(df, patience=3)
    assert sorted((r.source, r.page) for r in out.collect()) == sorted(want) and len(want) < len(rows)


def test_yield_and_delete_ids(spark):
    cand = spark.createDataFrame([("s", "c", 1, "h1", True), ("s", "c", 1, "h2", False), ("s", "c", 1, "h3", True), ("s", "c", 1, "h3", True)], "source string, category string, page int, url_hash string, ok boolean")
    led = spark.createDataFrame([("h3",), ("h3",)], "url_hash string")
    assert crawl.crawl_yield(cand, led).first()[3:] == (4, 1, 2, 1)
    ids = spark.createDataFrame([("pr:1",), ("sr:2",), ("3",), ("zz:4",), ("sr:x",), ("5",)], "id string")
    assert {tuple(r) for r in cleanup.delete_targets(ids).collect()} == {("pr", 1), ("sr", 2), ("pr", 3), ("pr", 4), ("pr", 5)}


def test_numbers_of_hashed_ids(spark):
    from noticeworks.operators import planning as P

    ids = spark.range(25_000).selectExpr("xxhash64(id) as id")
    got = [(r.id, r.idx) for r in P.numbered(ids, "id").collect()]
    assert sorted(got) == [(x, i) for i, x in enumerate(sorted(i for i, _ in got))]
    assert P.numbered(ids.limit(0), "id").count() == 0


def test_numbers_of_clustered_and_long_keys(spark):
    from noticeworks.operators import planning as P

    ids = [*range(5000), *range(10**15, 10**15 + 50), -(10**17)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert {r.id: r.idx for r in P.numbered(rows, "id").collect()} == {v: i for i, v in enumerate(sorted(ids))}
    words = spark.createDataFrame([(f"{i:x}",) for i in range(300)], "w string")
    assert {r.w: r.idx for r in P.numbered(words, "w").collect()} == {w: i for i, w in enumerate(sorted(f"{i:x}" for i in range(300)))}
    assert P.numbered(rows.limit(0), "id").count() == 0


def test_new_ids_follow_the_largest(spark):
    from noticeworks.operators import planning as P

    stored = spark.createDataFrame([(7, "b"), (3, "x")], "id bigint, url_hash string")
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 3, None), ("c", 4, None)], "url_hash string, v int, id bigint")
    got = sorted((r.url_hash, r.v, r.id) for r in P.with_new_ids(rows, stored, "url_hash").collect())
    assert got == [("a", 1, 8), ("b", 2, 7), ("c", 3, 9), ("c", 4, 9)]
    assert sorted(r.id for r in P.with_new_ids(rows, stored.limit(0), "url_hash").collect()) == [1, 2, 3, 3]
