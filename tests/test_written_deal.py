"""Pages stay dealt when a job writes what it extracts from them."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.plans import jobs
from noticeworks.session import cut_lineage


def test_pages_stay_dealt_when_written(spark):
    """Also where the shuffles of the session have as many tasks as the dealing, and where pages come twice."""
    html = F.concat(F.lit("<p>本项目资金来源为财政资金，出资比例为百分之百，现对该项目进行公开说明，欢迎各单位参加。"), F.col("id"), F.lit("</p>"))
    rows = spark.range(0, 800, 1, 1).select((F.col("id") % 400).cast("string").alias("id")).withColumns(
        {"url": F.concat(F.lit("http://x.cn/"), "id"), "html": html, "crawled_at": F.lit(dt(2024, 6, 1)), "search_query": F.lit("q"), "source_name": F.lit("s")}
    )
    pages = spark.createDataFrame([], schemas.RAW_PAGES).unionByName(rows, allowMissingColumns=True)
    tasks, was = 4 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        written = cut_lineage(jobs.parse_updates(pages, spark.createDataFrame([], schemas.PARSED_RESULTS), ["财政"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert written.count() == 400 and len(written.inputFiles()) > tasks // 2
