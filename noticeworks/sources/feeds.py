"""Listing feeds and detail records stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.functions.basics import strip
from noticeworks.functions.dates import feed_date
from noticeworks.functions.urls import fill_template, netloc, url_hash

# Labelled detail fields in the order they are shown.
DETAIL_FIELDS = (
    ("发布时间", "noticeTime"),
    ("发布机构", "author"),
    ("地区", "regionName"),
    ("公告类型", "noticeTypeName"),
    ("项目编号", "openTenderCode"),
    ("预算金额", "budget"),
    ("成交金额", "successfulMoney"),
    ("采购人", "purchaser"),
    ("代理机构", "agency"),
    ("联系人", "contactPerson"),
    ("联系电话", "contactNumber"),
    ("中标供应商", "bidCompany"),
)
TITLE_MAX = 500


def _given(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def listing_records(feed: DataFrame, base_url: str) -> DataFrame:
    """One row per record of a listing feed (``body``); records without a link are dropped."""
    rest = [c for c in feed.columns if c != "body"]
    parsed = feed.select(*rest, F.from_json("body", schemas.LISTING_FEED).alias("feed"))
    rows = parsed.select(*rest, F.posexplode("feed.result.records").alias("position", "r"))
    link = strip(F.coalesce("r.linkurl", F.lit("")))
    url = F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(base_url.rstrip("/")), link))
    return rows.where(link != "").select(
        *rest, "position", url.alias("url"), url_hash(url).alias("url_hash"), netloc(url).alias("domain"),
        F.left(strip(_given("r.title", "r.titlenew")), F.lit(TITLE_MAX)).alias("title"),
        feed_date(_given("r.webdate", "r.infodate")).alias("publish_date"),
        F.nullif(strip(_given("r.zhuanzai")), F.lit("")).alias("source_name"),
    )


def portal_records(feed: DataFrame, url_template: str) -> DataFrame:
    """One row per record of a portal feed (``body``), with the address of its detail page."""
    rest = [c for c in feed.columns if c != "body"]
    parsed = feed.select(*rest, F.from_json("body", schemas.PORTAL_FEED).alias("feed"))
    rows = parsed.select(*rest, F.posexplode("feed.data.rows").alias("position", "r"))
    url = fill_template(url_template, id=F.col("r.id"))
    return rows.where(_given("r.id") != "").select(
        *rest, "position", F.col("r.id").alias("record_id"), url.alias("url"), url_hash(url).alias("url_hash"),
        F.left(F.coalesce(F.nullif(strip(_given("r.title")), F.lit("")), "r.id"), F.lit(TITLE_MAX)).alias("title"),
        feed_date(_given("r.noticeTime", "r.publishTime")).alias("publish_date"),
        F.col("r.regionName").alias("region_name"), F.col("r.noticeTypeName").alias("notice_type"),
    )


def detail_records(feed: DataFrame) -> DataFrame:
    """Detail fields of successful answers (``body`` with code 200)."""
    rest = [c for c in feed.columns if c != "body"]
    answer = F.from_json("body", f"code string, data struct<{schemas.DETAIL_RECORD.replace(' string', ': string')}>")
    return (
        feed.select(*rest, answer.alias("a")).where(F.col("a.code") == "200")
        .where(F.col("a.data").isNotNull()).select(*rest, "a.data.*")
    )


def render_detail_html(details: DataFrame) -> DataFrame:
    """Add ``html``: the record as a plain page the extraction can read."""
    title = F.coalesce("title", F.lit(""))
    fields = F.concat_ws(
        "",
        *[
            F.when(F.col(name) != "", F.concat(F.lit(f"<p><b>{shown}：</b>"), F.col(name), F.lit("</p>")))
            for shown, name in DETAIL_FIELDS
        ],
    )
    described = F.when(
        F.col("description") != "", F.concat(F.lit("<div class='summary'>"), "description", F.lit("</div>"))
    )
    body = F.coalesce(F.nullif("content", F.lit("")), described, F.lit(""))
    return details.withColumn(
        "html",
        F.concat(
            F.lit("<html><head><meta charset='utf-8'><title>"), title, F.lit("</title></head><body><h1>"), title,
            F.lit("</h1>"), fields, F.lit("<div class='content'>"), body, F.lit("</div></body></html>"),
        ),
    )
