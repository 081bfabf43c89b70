"""Work that costs much is dealt to several tasks a core, whatever its bytes."""

from datetime import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import alerts, ml
from noticeworks.plans import jobs
from noticeworks.streaming import jobs as streaming

AS_OF = dt(2024, 6, 1)


def raw_pages(spark, n=400):
    html = F.concat(F.lit("<p>本项目资金来源为财政资金，出资比例为百分之百，现对该项目进行公开说明，欢迎各单位参加。"), F.col("id"), F.lit("</p>"))
    rows = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("http://x.cn/"), "id").alias("url")).withColumns(
        {"html": html, "crawled_at": F.lit(AS_OF), "search_query": F.lit("q"), "source_name": F.lit("s")}
    )
    return spark.createDataFrame([], schemas.RAW_PAGES).unionByName(rows, allowMissingColumns=True)


def test_extraction_is_dealt(spark):
    none = spark.createDataFrame([], schemas.PARSED_RESULTS)
    updates = jobs.parse_updates(raw_pages(spark), none, ["财政"])
    assert updates.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert updates.count() == 400 and updates.where("outcome = 'ok'").count() == 400


def test_streamed_pages_are_dealt(spark, tmp_path):
    feed, target = str(tmp_path / "feed"), str(tmp_path / "log")
    raw_pages(spark).write.parquet(feed)
    stream = spark.readStream.schema(raw_pages(spark).schema).parquet(feed)
    streaming.stream_extract(stream, target, str(tmp_path / "ckpt"), ["财政"]).trigger(availableNow=True).start().awaitTermination()
    assert len(list(Path(target).glob("run-*/*.parquet"))) > 2 * spark.sparkContext.defaultParallelism
    assert streaming.parsed_log(spark, target).read().where("outcome = 'ok'").count() == 400


def test_pair_counts_are_dealt(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("id AS url_hash", "concat('text ', id) AS features_text")
    counted = ml._counted(rows, 64)
    assert len(counted.inputFiles()) > 2 * spark.sparkContext.defaultParallelism and counted.count() == 400


def test_crawl_merges_once(spark):
    """The merged table is written; what is made from it does not merge again."""
    parsed, outbox = spark.createDataFrame([], schemas.PARSED_RESULTS), spark.createDataFrame([], schemas.NOTIFY_MESSAGES)
    channels, regions = spark.createDataFrame([(1, "c", "sms", "{}", True)], schemas.NOTIFY_CHANNELS), spark.createDataFrame([], schemas.SEARCH_REGIONS)
    done = jobs.run_after_crawl(raw_pages(spark, 20), parsed, ["财政"], channels, outbox, regions, alerts.NotifyConfig(filter_region=False), AS_OF, auto_notify=False)
    assert done["parsed"].inputFiles() and done["parsed"].count() == 20
    assert "FullOuter" not in done["new_messages"]._jdf.queryExecution().optimizedPlan().toString()
