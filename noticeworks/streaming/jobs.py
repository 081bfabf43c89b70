"""Streams of pages, parsed rows and fetch events.

Sinks are logs of runs: a micro-batch is written under its batch id, so a replay
after a failure replaces it, and full levels of runs are compacted after each batch.  The current
table of a log is a merge on read over what is not compacted.  A log belongs to one checkpoint.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from noticeworks import schemas
from noticeworks.functions.urls import content_hash, url_hash
from noticeworks.operators import alerts
from noticeworks.operators.extract import extract_notices
from noticeworks.operators.merge import dedup_pages, drop_serp_pages, one_per_key
from noticeworks.profile import ZH_TENDER, Profile
from noticeworks.session import dealt
from noticeworks.sources.runs import BUCKETS, RunTable
from noticeworks.sources.tables import spread, surviving_messages, surviving_pages, surviving_parsed

PARSED_LOG = """
    url string, url_hash string, mongo_doc_id string, title string, summary string,
    publish_date timestamp, bidder string, location string, bid_start_time timestamp,
    bid_end_time timestamp, amount string, amount_value double, contact string,
    search_query string, source_name string, is_relevant boolean, relevance_score double,
    notice_type string, matched_keywords string, parser_version string, parse_errors string,
    created_by string, outcome string
"""
OUTBOX_LOG = """
    channel_id bigint, parsed_id bigint, url_hash string, status string, title string, url string,
    notice_type string, publish_date timestamp, content string, skip_reason string,
    matched_region string, created_at timestamp
"""


def page_log(spark: SparkSession, path: str, buckets: int = BUCKETS) -> RunTable:
    return RunTable(spark, path, PAGE_LOG, "url", buckets)


def parsed_log(spark: SparkSession, path: str, buckets: int = BUCKETS) -> RunTable:
    return RunTable(spark, path, PARSED_LOG, "url_hash", buckets)


def outbox_log(spark: SparkSession, path: str, buckets: int = BUCKETS) -> RunTable:
    return RunTable(spark, path, OUTBOX_LOG, "url_hash", buckets)


def stream_new_pages(stream: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Fetched pages to the page log.

    The log is merged on read and replayed under its batch ids, so repeated deliveries are harmless,
    and no page is dropped for being late or without a crawl time: which one is newest is decided on read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = page_log(batch.sparkSession, target, buckets)
        log.append(dedup_pages(batch).withColumn("content_hash", content_hash(F.col("html"))), batch_id)
        log.compact(surviving_pages)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_extract(
    pages: DataFrame, target: str, checkpoint: str, keywords: list[str], profile: Profile = ZH_TENDER, buckets: int = BUCKETS
) -> DataStreamWriter:
    """New pages to the parsed log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = dedup_pages(drop_serp_pages(spread(batch)).withColumn("url_hash", url_hash(F.col("url"))))
        log = parsed_log(batch.sparkSession, target, buckets)
        log.append(extract_notices(dealt(newest, "url_hash"), keywords, profile), batch_id)
        log.compact(surviving_parsed)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_alerts(
    parsed: DataFrame, target: str, checkpoint: str, channels: DataFrame, regions: DataFrame,
    cfg: alerts.NotifyConfig, as_of: datetime | None = None, buckets: int = BUCKETS,
) -> DataStreamWriter:
    """New parsed rows to the outbox log, once per channel and notice.

    Of the outbox only the buckets of the batch's URLs are read, and of those the messages about
    them, not those of the batch itself, so a replay writes the same messages again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = outbox_log(batch.sparkSession, target, buckets)
        newest = one_per_key(batch, ["url_hash"], ["id"])
        known = log.read(log.touched(batch)).where(F.col("batch_id") != batch_id)
        touched = known.join(newest.select("url_hash"), "url_hash", "left_semi")
        now = as_of or datetime.now()
        new = alerts.prepare_notifications(newest, channels, touched, regions, cfg, now)
        log.append(new, batch_id)
        log.compact(surviving_messages)

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_crawl_metrics(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Fetch events (``ts``, ``source_name``, ``status``) counted per window and source."""
    status = F.col("status")
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "source_name")
        .agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count_if(status == 200).alias("ok"),
            F.count_if((status != 200) & status.between(100, 599)).alias("refused"),
            F.count_if(~status.between(100, 599)).alias("failed"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "source_name", "fetched", "ok", "refused", "failed",
        )
    )


def crawl_metrics_sink(metrics: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Closed windows as files: each is written once, and nothing passes through the driver."""
    return metrics.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)


PAGE_LOG = schemas.PAGE_DOCUMENTS
