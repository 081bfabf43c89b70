from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import alerts as A
from noticeworks.operators import merge as M
from noticeworks.plans import jobs
from noticeworks.sources import tables as T
from noticeworks.streaming import jobs as J

HAN = "本项目资金来源为财政资金，出资比例为百分之百，现对该项目进行公开说明，欢迎各单位参加。"
AS_OF = dt(2024, 6, 15)


def page(i, url, text, hour):
    return (i, url, f"<title>招标公告{i}</title><p>发布时间：2024-06-01 {text}</p>", None, dt(2024, 1, 1, hour), "q", "s", ("", "website", None))


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture
def feed(spark, tmp_path):
    path = str(tmp_path / "feed")

    def add(*rows):
        spark.createDataFrame(rows, schemas.RAW_PAGES).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return spark.readStream.schema(spark.createDataFrame([], schemas.RAW_PAGES).schema).option("maxFilesPerTrigger", 1).parquet(path)

    return add, stream, path


def test_pages_stream_equals_batch_merge(spark, feed, tmp_path):
    add, stream, path = feed
    target, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    a, b, back = page("1", "u", "A" + HAN, 1), page("2", "u", "B" + HAN, 2), page("3", "u", "A" + HAN, 3)
    add(a, page("9", "v", HAN, 1))
    run(J.stream_new_pages(stream(), target, ckpt))
    add(b, b)
    add(back, page("8", "v", "late", 0))
    run(J.stream_new_pages(stream(), target, ckpt))
    run(J.stream_new_pages(stream(), target, ckpt))
    current = {r.url: r for r in T.current_pages(T.read_log(spark, J.PAGE_LOG, target)).collect()}
    batch = spark.read.schema(schemas.RAW_PAGES).parquet(path)
    want = {r.url: r.html for r in M.dedup_pages(batch).collect()}
    assert {u: r.html for u, r in current.items()} == want
    assert current["u"].html == back[2] and current["u"].id == "1" and len(current["u"].content_hash) == 64


def test_late_and_undated_pages_stay(spark, feed, tmp_path):
    """A first-ever page far behind the newest ones, and one without a time, are in the log."""
    add, stream, path = feed
    target, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    for row in (page("1", "u", HAN, 20), page("2", "late", HAN, 1), ("3", "undated", HAN, "", None, "q", "s", ("", "website", None))):
        add(row)
        run(J.stream_new_pages(stream(), target, ckpt))
    log = T.current_pages(T.read_log(spark, J.PAGE_LOG, target))
    batch = M.dedup_pages(spark.read.schema(schemas.RAW_PAGES).parquet(path))
    assert {r.url for r in log.collect()} == {"u", "late", "undated"} == {r.url for r in batch.collect()}


def test_extract_stream_equals_batch(spark, feed, tmp_path):
    add, stream, path = feed
    target, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    add(page("1", "u", HAN, 1), page("2", "v", HAN, 1))
    run(J.stream_extract(stream(), target, ckpt, ["财政"]))
    add(("3", "u", "<p>" + "x" * 60 + "</p>", None, dt(2024, 1, 2), "q", "s", ("", "website", None)))
    run(J.stream_extract(stream(), target, ckpt, ["财政"]))
    log = T.read_log(spark, J.PARSED_LOG, target)
    got = {r.url: r for r in T.current_parsed(log).collect()}
    # a later invalid crawl marks the row and keeps its fields, as the batch merge does
    assert got["u"].parse_errors.startswith("content_invalid") and got["u"].publish_date == dt(2024, 6, 1) and got["u"].notice_type == "招标"
    empty = spark.createDataFrame([], schemas.PARSED_RESULTS)
    first = jobs.parse_job(spark.createDataFrame([page("1", "u", HAN, 1), page("2", "v", HAN, 1)], schemas.RAW_PAGES), empty, ["财政"], AS_OF)
    both = jobs.parse_job(spark.read.schema(schemas.RAW_PAGES).parquet(path), first, ["财政"], AS_OF, "all")
    cols = ["url", "title", "publish_date", "notice_type", "is_relevant", "relevance_score", "matched_keywords", "parse_errors", "summary", "created_by"]
    assert sorted(map(str, T.current_parsed(log).select(cols).collect())) == sorted(map(str, both.select(cols).collect()))


def test_alert_stream_adds_once(spark, tmp_path):
    regions = spark.createDataFrame([(1, "东兴区", None, "district", None, True)], schemas.SEARCH_REGIONS)
    channels = spark.createDataFrame([(1, "a", "qq", "{}", True), (2, "b", "qq", "{}", True)], schemas.NOTIFY_CHANNELS)
    rows = spark.createDataFrame([(i, f"u{i}", "东兴区", True, dt(2024, 6, 1)) for i in range(3)], "id bigint, url string, title string, is_relevant boolean, publish_date timestamp")
    parsed = spark.createDataFrame([], schemas.PARSED_RESULTS).unionByName(rows.withColumn("url_hash", F.md5("url")), allowMissingColumns=True)
    feed, target, ckpt = (str(tmp_path / n) for n in ("feed", "log", "ckpt"))
    parsed.write.parquet(feed)
    stream = spark.readStream.schema(parsed.schema).parquet(feed)
    for _ in range(2):
        run(J.stream_alerts(stream, target, ckpt, channels, regions, A.NotifyConfig(), AS_OF))
        parsed.write.mode("append").parquet(feed)
    run(J.stream_alerts(stream, target, ckpt, channels, regions, A.NotifyConfig(), AS_OF))
    log = T.read_log(spark, J.OUTBOX_LOG, target)
    batch = A.prepare_notifications(parsed, channels, spark.createDataFrame([], schemas.NOTIFY_MESSAGES), regions, A.NotifyConfig(), AS_OF)
    assert log.count() == T.current_outbox(log).count() == batch.count() == 6


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("u", 1)], "url string, x int")
    T.append_batch(df, path, 3)
    T.append_batch(df, path, 3)
    T.append_batch(df, path, 4)
    assert sorted(r.batch_id for r in T.read_log(spark, "url string, x int", path).collect()) == [3, 4]
    assert T.read_log(spark, "url string, x int", str(tmp_path / "none")).count() == 0


def test_metrics_windows(spark, tmp_path):
    feed = str(tmp_path / "feed")
    rows = [(dt(2024, 1, 1, 0, 10), "s", 200), (dt(2024, 1, 1, 0, 50), "s", 404), (dt(2024, 1, 1, 1, 0), "s", -1), (dt(2024, 1, 1, 1, 5), "t", 200)]
    spark.createDataFrame(rows, "ts timestamp, source_name string, status int").write.parquet(feed)
    stream = spark.readStream.schema("ts timestamp, source_name string, status int").parquet(feed)
    run(J.stream_crawl_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("fetch_metrics"))
    out = {(r.window_start.hour, r.source_name): (r.fetched, r.ok, r.refused, r.failed) for r in spark.table("fetch_metrics").collect()}
    assert out == {(0, "s"): (2, 1, 1, 0), (1, "s"): (1, 0, 0, 1), (1, "t"): (1, 1, 0, 0)}


def test_bucketed_table_is_not_shuffled(spark):
    results = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("url_hash"), "id")
    spark.sql("DROP TABLE IF EXISTS nw_results")
    spark.sql("DROP TABLE IF EXISTS nw_parsed")
    T.save_bucketed(results, "nw_results", buckets=4)
    T.save_bucketed(results.where("id % 2 = 0"), "nw_parsed", buckets=4)
    from noticeworks.operators.reconcile import pending_results

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = pending_results(spark.table("nw_results"), spark.table("nw_parsed"))
        assert df.count() == 50
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE nw_results")
        spark.sql("DROP TABLE nw_parsed")


def test_bucketed_merges_are_not_shuffled(spark):
    """Pages and parsed rows bucketed by url_hash merge without an exchange, and as unbucketed ones do."""
    rows = [page(str(i), f"u{i % 30}", HAN, i % 20) for i in range(60)]
    pages = M.with_page_keys(spark.createDataFrame(rows, schemas.RAW_PAGES))
    base, news = M.dedup_pages(pages.where("id < '3'")), pages.where("id >= '3'")
    for name, df in (("nw_base", base), ("nw_news", news)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        T.save_bucketed(df, name, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = M.merge_raw_pages(spark.table("nw_base"), spark.table("nw_news"))
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        plain = M.merge_raw_pages(base.drop("url_hash"), news.drop("url_hash"))
        cols = ["id", "url", "crawled_at"]
        assert sorted(map(tuple, merged.select(cols).collect()), key=str) == sorted(map(tuple, plain.select(cols).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE nw_base")
        spark.sql("DROP TABLE nw_news")


def test_cuts_are_deleted(spark):
    import os

    from noticeworks import session

    session.drop_cuts(spark)
    cut = session.cut_lineage(spark.range(3).toDF("x"))
    folder = cut.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    folder = "/" + folder.lstrip("/")
    assert cut.count() == 3 and os.path.exists(folder)
    assert session.drop_cuts(spark) == 1 and not os.path.exists(folder)
