"""Results, pages and parsed rows set against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.merge import pages_latest
from noticeworks.profile import LIST_PAGE, SEARCH_SERP

# Fixed values.
NO_TITLE = "(未抓到标题)"
NULL_GROUP = "<null>"
LOW_VALUE_ERRORS = ("search_serp:", "listing_page:", "content_invalid:")
DUPLICATION_LIMIT = 1.2


def pending_results(results: DataFrame, parsed: DataFrame) -> DataFrame:
    """Results without a parsed row."""
    return results.join(parsed.select("url_hash"), "url_hash", "left_anti").select(*results.columns)


def orphan_parsed(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """Parsed rows without a result."""
    return parsed.join(results.select("url_hash"), "url_hash", "left_anti").select(*parsed.columns)


def low_value(parsed: DataFrame) -> Column:
    errors = F.coalesce("parse_errors", F.lit(""))
    prefixed = F.lit(False)
    for prefix in LOW_VALUE_ERRORS:
        prefixed = prefixed | F.startswith(errors, F.lit(prefix))
    return F.coalesce(parsed["notice_type"].isin(SEARCH_SERP, LIST_PAGE), F.lit(False)) | prefixed


def drop_orphans(parsed: DataFrame, results: DataFrame, mode: str = "safe") -> DataFrame:
    """Parsed rows left after cleaning: 'safe' drops orphans without value, 'all' every orphan."""
    if mode == "all":
        return parsed.join(results.select("url_hash"), "url_hash", "left_semi").select(*parsed.columns)
    known = results.select("url_hash", F.lit(True).alias("_known"))
    return (
        parsed.join(known, "url_hash", "left")
        .where(F.col("_known").isNotNull() | ~low_value(parsed))
        .select(*parsed.columns)
    )


def status_view(results: DataFrame, pages: DataFrame, parsed: DataFrame, driver: str = "results") -> DataFrame:
    """Result, latest page and parsed row side by side, with the parse status.

    ``driver`` says which table keeps all its rows: results or parsed.
    """
    page = pages_latest(pages).select(
        "url_hash",
        F.struct("id", "url", "crawled_at", "search_query", "source_name", "meta").alias("page"),
    )
    result = results.select("url_hash", F.struct(*[c for c in results.columns if c != "url_hash"]).alias("sr"))
    notice = parsed.select("url_hash", F.struct(*[c for c in parsed.columns if c != "url_hash"]).alias("pr"))
    first, second = (notice, result) if driver == "parsed" else (result, notice)
    rows = first.join(page, "url_hash", "left").join(second, "url_hash", "left")

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])

    own_title = F.when(~F.startswith(F.col("sr.title"), F.lit("http")), F.nullif(F.col("sr.title"), F.lit("")))
    errors = F.nullif(F.col("pr.parse_errors"), F.lit(""))
    status = (
        F.when(F.col("pr").isNotNull(), F.when(errors.isNotNull(), F.lit("error")).otherwise(F.lit("parsed")))
        .when(F.col("page").isNotNull(), F.lit("unparsed"))
        .otherwise(F.lit("unfetched"))
    )
    from_parsed = (
        "summary", "notice_type", "bidder", "location", "amount", "amount_value", "bid_end_time",
        "contact", "is_relevant", "relevance_score", "matched_keywords", "parser_version",
    )
    return rows.select(
        "url_hash",
        F.col("pr.id").alias("parsed_id"),
        F.col("sr.id").alias("result_id"),
        F.coalesce(F.col("page.id").cast("string"), F.col("pr.mongo_doc_id")).alias("page_id"),
        F.coalesce(filled("page.url", "pr.url"), F.col("sr.url"), F.lit("")).alias("url"),
        F.coalesce(
            F.nullif(F.col("pr.title"), F.lit("")), own_title,
            F.nullif(F.col("page.meta.title"), F.lit("")), F.lit(NO_TITLE),
        ).alias("title"),
        *[F.col(f"pr.{c}").alias(c) for c in from_parsed],
        F.coalesce("pr.publish_date", "sr.publish_date").alias("publish_date"),
        F.coalesce(filled("page.search_query", "pr.search_query", "sr.search_query"), F.lit("")).alias("search_query"),
        F.coalesce(filled("page.source_name", "pr.source_name", "sr.source_name"), F.lit("")).alias("source_name"),
        F.coalesce(filled("page.meta.source_type", "sr.source_type"), F.lit("")).alias("source_type"),
        F.coalesce("pr.created_at", "page.crawled_at", "sr.created_at").alias("created_at"),
        F.col("page.crawled_at").alias("crawled_at"),
        F.col("sr.created_at").alias("fetched_at"),
        status.alias("parse_status"),
        F.col("pr.parse_errors").alias("parse_errors"),
    )


def registry_counts(**tables: DataFrame) -> DataFrame:
    """Total and enabled rows per settings table (enabled is NULL where there is no switch)."""
    out = None
    for name, df in tables.items():
        enabled = F.count_if("enabled") if "enabled" in df.columns else F.lit(None).cast("bigint")
        row = df.agg(
            F.lit(name).alias("registry"), F.count(F.lit(1)).alias("total"), enabled.alias("enabled")
        )
        out = row if out is None else out.unionByName(row)
    return out


def parse_health(results: DataFrame, parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Results, parsed ok and with errors, pending, orphans and raw pages, in one row.

    One full outer join on the hash gives pending and orphans together.
    """
    sides = results.select("url_hash", F.lit(1).alias("r")).join(
        parsed.select(
            "url_hash", F.lit(1).alias("p"), F.col("parse_errors").isNotNull().alias("failed")
        ),
        "url_hash", "full_outer",
    )
    counts = sides.agg(
        F.count("r").alias("results"),
        F.count_if(~F.col("failed")).alias("parsed_ok"),
        F.count_if("failed").alias("parsed_error"),
        F.count_if(F.col("p").isNull()).alias("pending"),
        F.count_if(F.col("r").isNull()).alias("orphans"),
    )
    raw = pages.agg(F.count(F.lit(1)).alias("raw_pages"))
    return counts.withColumn("raw_pages", raw.scalar())


def _top(df: DataFrame, key: Column, name: str, n: int | None) -> DataFrame:
    grouped = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("cnt"))
    ordered = grouped.orderBy(F.col("cnt").desc(), F.col(name).asc())
    return ordered if n is None else ordered.limit(n)


def orphan_by_type(parsed: DataFrame, results: DataFrame) -> DataFrame:
    return _top(orphan_parsed(parsed, results), F.coalesce("notice_type", F.lit(NULL_GROUP)), "notice_type", None)


def error_prefix_top(parsed: DataFrame, n: int = 20) -> DataFrame:
    failed = parsed.where(F.col("parse_errors").isNotNull())
    return _top(failed, F.left("parse_errors", F.lit(60)), "err_prefix", n)


def notice_type_top(parsed: DataFrame, n: int = 20) -> DataFrame:
    return _top(parsed, F.coalesce("notice_type", F.lit(NULL_GROUP)), "notice_type", n)


def domain_top(results: DataFrame, n: int = 200) -> DataFrame:
    return _top(results.where(F.col("domain") != ""), F.col("domain"), "domain", n)


def dup_report(pages: DataFrame) -> DataFrame:
    """URLs stored more than once, and how many documents are too many."""
    return (
        pages.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .agg(F.count(F.lit(1)).alias("dup_urls"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_docs"))
    )


def dup_ratio(pages: DataFrame, threshold: float = DUPLICATION_LIMIT, approx: bool = False) -> DataFrame:
    """Documents per URL and whether the table needs a dedup run.

    Distinct URLs are counted in two aggregation steps, so no task holds the set;
    ``approx`` uses a sketch instead.
    """
    if approx:
        counts = pages.agg(
            F.count(F.lit(1)).alias("documents"), F.approx_count_distinct("url").alias("urls")
        )
    else:
        counts = pages.groupBy("url").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("url").alias("urls")
        )
    ratio = F.col("documents") / F.greatest("urls", F.lit(1))
    return counts.select(
        "documents", "urls", F.round(ratio, 4).alias("ratio"),
        ((F.col("urls") > 0) & (ratio > threshold)).alias("needs_dedup"),
    )


def newest_orphans(parsed: DataFrame, results: DataFrame, n: int = 10) -> DataFrame:
    return (
        orphan_parsed(parsed, results)
        .select("id", "url", "created_at", "source_name", F.col("parse_errors").isNotNull().alias("has_err"))
        .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
        .limit(n)
    )


def action_report(actions: DataFrame) -> DataFrame:
    """Rows per action of a job that labels what it did."""
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("cnt"))
