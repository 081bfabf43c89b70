"""The jobs a user starts: parse, rejudge, clean up, diagnose, parse-then-alert."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import fields as X
from noticeworks.functions.basics import blank_to_null, strip
from noticeworks.functions.encoding import fix_mojibake
from noticeworks.functions.text import html_to_text
from noticeworks.functions.urls import is_serp_url, url_hash
from noticeworks.operators import alerts, merge, reconcile
from noticeworks.operators.extract import (
    extract_notices, listing_error, listing_info, with_keyword_hits,
)
from noticeworks.operators.planning import with_new_ids
from noticeworks.profile import LIST_PAGE, SEARCH_SERP, ZH_TENDER, Profile
from noticeworks.session import cut_lineage, dealt

Scorer = Callable[[DataFrame], DataFrame]

SERP_REJUDGED = "search_serp: 搜索引擎结果页（如百度/Bing/Google），无业务正文"


def parse_updates(
    pages: DataFrame, parsed: DataFrame, keywords: DataFrame | list[str],
    mode: str = "unparsed_and_errors", profile: Profile = ZH_TENDER, scorer: Scorer | None = None,
) -> DataFrame:
    """Parsed rows for the pages the mode selects.

    The newest page of each URL is chosen, and known ones are left out, without html; html is
    read only for the pages that remain.
    """
    keyed = pages.select(
        "id", "url", url_hash(F.col("url")).alias("url_hash"), "html", "crawled_at", "search_query", "source_name", "meta"
    )
    slim = merge.drop_serp_pages(keyed).select("url_hash", "crawled_at", "id", "meta")
    chosen = merge.select_pages_to_parse(merge.dedup_pages(slim), parsed, mode).select("url_hash", "crawled_at", "id")
    same = [keyed[c].eqNullSafe(chosen[c]) for c in ("url_hash", "crawled_at", "id")]
    # dealt before the last dedup, which needs the rows by url_hash anyway: dealt after it, a job that writes the rows would fold
    # the dealing into the shuffle of the dedup and join its tasks by their bytes
    work = dealt(merge.drop_serp_pages(keyed).join(chosen, same, "left_semi"), "url_hash")
    return extract_notices(merge.dedup_pages(work), keywords, profile, scorer)


def parse_job(
    pages: DataFrame, parsed: DataFrame, keywords: DataFrame | list[str], as_of: datetime,
    mode: str = "unparsed_and_errors", profile: Profile = ZH_TENDER, scorer: Scorer | None = None,
) -> DataFrame:
    """The parsed table after a parse run."""
    # the extraction is the expensive part, and its rows are numbered and merged: write it once
    updates = cut_lineage(parse_updates(pages, parsed, keywords, mode, profile, scorer))
    return apply_updates(parsed, updates, as_of)


def apply_updates(parsed: DataFrame, updates: DataFrame, as_of: datetime) -> DataFrame:
    """The parsed table after bringing in the rows of a parse run, which are read several times."""
    stamped = with_new_ids(updates, parsed, "url_hash").withColumns(
        {"created_at": F.lit(as_of), "updated_at": F.lit(as_of), "updated_by": F.lit(None).cast("string")}
    )
    return merge.merge_parsed(parsed, stamped)


def parse_totals(updates: DataFrame) -> DataFrame:
    """Rows per outcome of a parse run."""
    return reconcile.action_report(updates.withColumnRenamed("outcome", "action"))


def rejudge_job(
    parsed: DataFrame, pages: DataFrame, keywords: DataFrame | list[str], scorer: Scorer | None,
    profile: Profile = ZH_TENDER, threshold: float = 0.5,
) -> DataFrame:
    """Judge all parsed rows again with a model; ``action`` tells what happened to each.

    Result and listing pages are marked, rows without text stay, all others get a
    new relevance, and a notice type if they have none.
    """
    if scorer is None:
        raise ValueError("no relevance model: train one first")
    typed = F.coalesce(F.col("notice_type").isin(LIST_PAGE, SEARCH_SERP), F.lit(False))
    staged = parsed.withColumn("_done", typed).withColumn(
        "_serp", ~F.col("_done") & is_serp_url(F.coalesce("url", F.lit("")))
    )
    html = pages.select(F.col("id").cast("string").alias("_page"), "html")
    open_page = F.when(~F.col("_done") & ~F.col("_serp"), F.col("mongo_doc_id"))
    wanting = staged.withColumn("_want", open_page)
    # rows that need no page would all meet at the NULL key: they skip the join
    fetched = wanting.where(F.col("_want").isNotNull()).join(html, F.col("_want") == F.col("_page"), "left").drop("_page")
    joined = fetched.unionByName(wanting.where(F.col("_want").isNull()).withColumn("html", F.lit(None).cast("string")))
    fallback = F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    page_text = blank_to_null(html_to_text(F.col("html")))
    texts = joined.withColumn("text", F.coalesce(page_text, fallback))
    texts = texts.withColumn("_info", F.when(F.col("html") != "", listing_info(F.col("html"), profile)))
    action = (
        F.when(F.col("_done"), F.lit("skipped"))
        .when(F.col("_serp"), F.lit("serp"))
        .when(strip(F.col("text")) == "", F.lit("blank"))
        .when(F.col("_info").isNotNull(), F.lit("listing"))
        .otherwise(F.lit("scored"))
    )
    ready = texts.withColumn("action", action).drop("html", "_want", "_done", "_serp")
    scored = scorer(with_keyword_hits(ready, keywords))

    def given(name: str):
        return F.col(name) if name in scored.columns else None

    rel = X.relevance(
        F.col("matched"), F.col("n_keywords"), score=given("score"), label=given("label"),
        confidence=given("confidence"), threshold=threshold, digits=4,
    )
    judged = scored.withColumn("_rel", F.when(F.col("action") == "scored", rel)).withColumn(
        "_type",
        F.when(
            (F.col("action") == "scored") & blank_to_null(F.col("notice_type")).isNull(),
            X.notice_type(F.col("title"), F.col("text"), profile, given("model_type"), given("type_confidence")),
        ),
    )
    act = F.col("action")
    flagged = act.isin("serp", "listing")
    values = {
        "is_relevant": F.when(flagged, F.lit(False)).when(act == "scored", F.col("_rel.is_relevant")).otherwise(F.col("is_relevant")),
        "relevance_score": F.when(flagged, F.lit(0.0)).when(act == "scored", F.col("_rel.relevance_score")).otherwise(F.col("relevance_score")),
        "matched_keywords": F.when(act == "scored", F.array_join("matched", ",")).otherwise(F.col("matched_keywords")),
        "notice_type": F.when(act == "serp", F.lit(SEARCH_SERP)).when(act == "listing", F.lit(LIST_PAGE))
        .otherwise(F.coalesce(F.col("_type"), F.col("notice_type"))),
        "parse_errors": F.when(act == "serp", F.lit(SERP_REJUDGED)).when(act == "listing", listing_error(F.col("_info")))
        .otherwise(F.col("parse_errors")),
    }
    return judged.select(*[values[c].alias(c) if c in values else F.col(c) for c in parsed.columns], "action")


def run_after_rejudge(
    parsed: DataFrame, pages: DataFrame, keywords: DataFrame | list[str], scorer: Scorer, channels: DataFrame,
    outbox: DataFrame, regions: DataFrame, cfg: alerts.NotifyConfig, as_of: datetime, profile: Profile = ZH_TENDER,
) -> dict[str, DataFrame]:
    """Judge again and prepare the messages of notices that became relevant."""
    judged = cut_lineage(rejudge_job(parsed, pages, keywords, scorer, profile))
    kept = judged.drop("action")
    return {"parsed": kept, "actions": judged, "new_messages": alerts.prepare_notifications(kept, channels, outbox, regions, cfg, as_of)}


def clean_pages(pages: DataFrame, keep: str = "newest") -> tuple[DataFrame, DataFrame]:
    """Pages after dedup, and what was removed."""
    return merge.dedup_pages(pages, keep), reconcile.dup_report(pages)


def clean_serp_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge.drop_serp_pages(pages), merge.serp_report(pages)


def clean_orphans(parsed: DataFrame, results: DataFrame, mode: str = "safe") -> tuple[DataFrame, DataFrame]:
    kept = reconcile.drop_orphans(parsed, results, mode)
    report = parsed.agg(F.count(F.lit(1)).alias("before")).withColumn(
        "kept", kept.agg(F.count(F.lit(1))).scalar()
    ).withColumn("dropped", F.col("before") - F.col("kept"))
    return kept, report


def repair_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    fixed = fix_mojibake(pages)
    return fixed.drop("action"), reconcile.action_report(fixed)


def diagnose(results: DataFrame, parsed: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All read-only health reports."""
    return {
        "health": reconcile.parse_health(results, parsed, pages),
        "duplication": reconcile.dup_ratio(pages),
        "errors": reconcile.error_prefix_top(parsed),
        "notice_types": reconcile.notice_type_top(parsed),
        "orphan_types": reconcile.orphan_by_type(parsed, results),
        "newest_orphans": reconcile.newest_orphans(parsed, results),
    }


def run_after_crawl(
    pages: DataFrame, parsed: DataFrame, keywords: DataFrame | list[str], channels: DataFrame,
    outbox: DataFrame, regions: DataFrame, cfg: alerts.NotifyConfig, as_of: datetime, *,
    auto_parse: bool = True, auto_notify: bool = True, profile: Profile = ZH_TENDER,
    scorer: Scorer | None = None,
) -> dict[str, DataFrame]:
    """Parse, prepare messages, and the batch to deliver, as the schedule's switches say."""
    if not auto_parse:
        return {}
    updates = cut_lineage(parse_updates(pages, parsed, keywords, profile=profile, scorer=scorer))
    # the merged table is a result, and the messages of both kinds are made from it
    merged = cut_lineage(apply_updates(parsed, updates, as_of))
    new = alerts.prepare_notifications(merged, channels, outbox, regions, cfg, as_of)
    out = {"parsed": merged, "new_messages": new}
    if auto_notify:
        told = F.concat_ws("/", "channel_id", "url_hash")
        numbered = with_new_ids(cut_lineage(new.withColumn("_message", told)), outbox.withColumn("_message", told), "_message").drop("_message")
        out["to_deliver"] = alerts.send_batch(outbox.unionByName(numbered, allowMissingColumns=True), channels)
    return out
