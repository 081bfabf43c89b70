"""Crawl logs: yield per listing page, incremental stop, blocked responses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.fields import is_antibot_page, is_captcha_page, is_login_page
from noticeworks.operators.planning import numbered
from noticeworks.profile import ZH_TENDER, Profile

PAGE_KEYS = ("source", "category", "page")
SEGMENT_KEYS = ("source", "category", "month")
# Statuses that mean the crawler is locked out.
BLOCKED_STATUSES = (403, 429, 503, 407)


def crawl_yield(candidates: DataFrame, ledger: DataFrame, keys: Iterable[str] = PAGE_KEYS) -> DataFrame:
    """Per listing page: records returned, new, skipped as known, failed.

    Candidates (with ``url_hash`` and ``ok``) are counted per URL before the join
    with the ledger, so a URL listed very often is one row of the join.
    """
    keys = list(keys)
    counted = candidates.groupBy(*keys, "url_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok")
    )
    known = ledger.select("url_hash").distinct().withColumn("_known", F.lit(True))
    seen = F.col("_known").isNotNull()
    return (
        counted.join(known, "url_hash", "left").groupBy(*keys).agg(
            F.sum("n").alias("returned"),
            F.sum(F.when(~seen, F.col("n_ok")).otherwise(F.lit(0))).alias("new"),
            F.sum(F.when(seen, F.col("n")).otherwise(F.lit(0))).alias("skipped"),
            F.sum(F.when(~seen, F.col("n") - F.col("n_ok")).otherwise(F.lit(0))).alias("failed"),
        )
    )


def incremental_stop(
    page_yield: DataFrame, patience: int = 2, keys: Iterable[str] = SEGMENT_KEYS
) -> DataFrame:
    """Pages an incremental crawl would fetch: it stops after ``patience`` pages without news.

    Pages (``page``, ``new``) are visited in the order of their numbers, which may have gaps;
    rows of one page are one visit, and their news add up.  Positions come from ranges of pages of
    all segments, so no segment is sorted in one task.  An empty page at position p takes
    part in the runs that end at p .. p + patience - 1; a run is complete when ``patience``
    empty pages of a segment take part.
    """
    keys = list(keys)
    visits = page_yield.groupBy(*keys, "page").agg(F.sum("new").alias("new"))
    placed = numbered(visits.withColumn("_at", F.struct(*keys, "page")), "_at")
    ends = (
        placed.where(F.col("new") == 0)
        .withColumn("end", F.explode(F.sequence(F.col("idx"), F.col("idx") + (patience - 1))))
        .groupBy(*keys, "end").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("page"))
        .where(F.col("n") >= patience)
        .groupBy(*keys).agg(F.min_by("page", "end").alias("last_page"))
    )
    return (
        page_yield.join(ends, keys, "left")
        .where(F.col("last_page").isNull() | (F.col("page") <= F.col("last_page")))
        .select(*page_yield.columns)
    )


def response_flags(responses: DataFrame, profile: Profile = ZH_TENDER) -> DataFrame:
    """Stored responses (``status``, ``body``, ``location``) with what is wrong with them."""
    status, body = F.col("status"), F.col("body")
    return responses.withColumns(
        {
            "blocked": F.coalesce(status.isin(*BLOCKED_STATUSES), F.lit(False)),
            "captcha": is_captcha_page(status, body),
            "login": is_login_page(status, body, F.col("location")),
            "antibot": is_antibot_page(body, profile.min_page_chars),
        }
    )
