"""Searches, admin filters, ordering and pages.

Filters are conjunctions of Columns, so they reach the scan; a page is one
``orderBy`` + ``offset`` + ``limit``, which Spark runs as a top-k per task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import bounded_values, contains_any, strip
from noticeworks.functions.matching import INLINE_NAMES, with_name_hits
from noticeworks.operators.regions import region_name_set, with_region_name
from noticeworks.session import cut_lineage
from noticeworks.sources.gramindex import GramIndex

PER_PAGE = 20
PARSED_SORTS = (
    "created_at", "publish_date", "amount_value", "relevance_score",
    "title", "bidder", "location", "notice_type",
)
RESULT_SORTS = ("created_at", "publish_date", "title")


@dataclass(frozen=True)
class SearchParams:
    keyword: str = ""
    region: str = ""
    notice_type: str = ""
    date_range: str = ""
    date_from: str = ""
    date_to: str = ""


def all_of(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for condition in conditions:
        if condition is not None:
            out = out & condition
    return out


def has(column: str, text: str | None) -> Column | None:
    """Case-sensitive containment; no condition for an empty text."""
    text = (text or "").strip()
    return F.contains(F.col(column), F.lit(text)) if text else None


def _day(text: str) -> datetime | None:
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d")
    except ValueError:
        return None


def date_bounds(params: SearchParams, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    """Inclusive publish-date bounds of a search; bounds that do not parse are ignored."""
    if params.date_range == "today":
        return as_of.replace(hour=0, minute=0, second=0) - timedelta(hours=8), None
    if params.date_range in ("3d", "7d", "30d"):
        return as_of - timedelta(days=int(params.date_range[:-1])), None
    if params.date_range == "custom":
        low = _day(params.date_from)
        high = _day(params.date_to)
        return low, high.replace(hour=23, minute=59, second=59) if high else None
    return None, None


def filter_by_region(df: DataFrame, names: DataFrame, limit: int = INLINE_NAMES) -> DataFrame:
    """Rows without a location, or whose location contains a known region name."""
    unplaced = F.coalesce(F.col("location"), F.lit("")) == ""
    inline = bounded_values(names, "name", limit)
    if inline is not None:
        return df.where(unplaced | contains_any(F.col("location"), inline))
    # written, so that names are looked for once a location: a filter on the hits would be pushed below the
    # distinct, where Spark does not take the Python function out of it
    places = cut_lineage(df.where(~unplaced).select("location").distinct())
    known = (
        with_name_hits(places, "location", F.col("location"), names, "hits", limit=limit)
        .where(F.size("hits") > 0)
        .select("location", F.lit(True).alias("_known"))
    )
    return df.join(known, "location", "left").where(unplaced | F.col("_known").isNotNull()).select(*df.columns)


def search_notices(
    parsed: DataFrame, regions: DataFrame, params: SearchParams, as_of: datetime
) -> DataFrame:
    """All notices a public search finds, before ordering and paging.

    Notices whose relevance is unknown are hidden, as ``<> false`` hides NULL.
    """
    keyword, region = params.keyword.strip(), params.region.strip()
    low, high = date_bounds(params, as_of)
    found = parsed.where(
        all_of(
            F.col("is_relevant") != F.lit(False),
            has("title", keyword) | has("summary", keyword) | has("search_query", keyword) if keyword else None,
            has("location", region) | has("search_query", region) if region else None,
            F.col("notice_type") == params.notice_type if params.notice_type else None,
            F.col("publish_date") >= F.lit(low) if low else None,
            F.col("publish_date") <= F.lit(high) if high else None,
        )
    )
    return found if region else filter_by_region(found, region_name_set(regions))


#: Columns a keyword is looked for in.
SEARCHED = ("title", "summary", "search_query")


def search_indexed(index: GramIndex, regions: DataFrame, params: SearchParams, as_of: datetime, keywords: DataFrame | None = None) -> DataFrame:
    """The same notices, read from the files that the index names for the keyword.

    With ``keywords`` (column ``keyword``) those of every different keyword, which is added: the rows are read once and
    looked through for all keywords together, instead of once for each.
    """
    if keywords is not None:
        # a keyword without text finds all notices, as in a single search
        terms = cut_lineage(keywords.where(F.col("keyword").isNotNull()).select("keyword", strip(F.col("keyword")).alias("term")).distinct())
        names = terms.where("term <> ''").select(F.col("term").alias("name")).distinct()
        found = search_notices(index.rows_with_any(terms.select("term")), regions, replace(params, keyword=""), as_of)
        columns = found.columns
        hits = with_name_hits(found, "url_hash", F.concat_ws("\0", *SEARCHED), names, "_hits", limit=0)
        every = F.col("_hits") if terms.where("term = ''").isEmpty() else F.array_append("_hits", F.lit(""))
        listed = hits.withColumn("term", F.explode(every)).join(terms, "term")
        # a term that spans two columns is in none
        own = F.lit(False)
        for c in SEARCHED:
            own |= F.coalesce(F.contains(c, F.col("term")), F.lit(False))
        return listed.where((F.col("term") == "") | own).select("keyword", *columns)
    return search_notices(index.rows_with(params.keyword.strip()), regions, params, as_of)


def newest_first(column: str = "publish_date", tie: str = "id") -> list[Column]:
    return [F.col(column).desc_nulls_first(), F.col(tie).desc()]


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    return df.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, column: str, last: tuple, tie: str = "id", per_page: int = PER_PAGE) -> DataFrame:
    """The page behind the row with ``last`` (value of ``column``, of ``tie``) in newest-first order.

    Unlike an offset, which gathers all rows before the page, this filters them in the scan.
    """
    value, at = last
    same = F.col(column).isNull() if value is None else F.col(column) == F.lit(value)
    older = F.col(column).isNotNull() if value is None else F.col(column) < F.lit(value)
    return df.where(older | (same & (F.col(tie) < F.lit(at)))).orderBy(*newest_first(column, tie)).limit(per_page)


def page_count(df: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Exact number of rows and pages; one page when there is nothing."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.greatest(F.ceil(total / per_page), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def sorted_by(column: str, direction: str, allowed: tuple[str, ...], tie: str = "id") -> list[Column]:
    """Order for a requested column if it is allowed, else newest first.

    Missing values come first when descending and last when ascending.
    """
    name = column if column in allowed else "created_at"
    if direction == "asc":
        return [F.col(name).asc_nulls_last(), F.col(tie).asc()]
    return [F.col(name).desc_nulls_first(), F.col(tie).desc()]


def latest(df: DataFrame, order: str, n: int, tie: str = "id") -> DataFrame:
    """The ``n`` rows latest by ``order``, equal ones by ``tie``."""
    return df.orderBy(F.col(order).desc_nulls_first(), F.col(tie).desc()).limit(n)


def enabled_rows(registry: DataFrame) -> DataFrame:
    """Enabled rows of a settings table, in id order."""
    return registry.where("enabled").orderBy("id")


def search_results_api(
    results: DataFrame, regions: DataFrame, *, keyword: str = "", region_id: int | None = None,
    source_type: str = "", page: int = 1, per_page: int = PER_PAGE,
) -> DataFrame:
    """One page of search results with the region name; the page is cut before the join."""
    found = results.where(
        all_of(
            has("title", keyword),
            F.col("region_id") == region_id if region_id else None,
            F.col("source_type") == source_type if source_type else None,
        )
    )
    rows = with_region_name(page_of(found, newest_first("created_at"), page, per_page), regions)
    return rows.select("id", "title", "url", "source_type", "region", "publish_date", "created_at").orderBy(
        *newest_first("created_at")
    )


def browse_results(results: DataFrame, *, domain: str = "", title: str = "", query: str = "", url: str = "") -> DataFrame:
    return results.where(
        all_of(has("domain", domain), has("title", title), has("search_query", query), has("url", url))
    )


def browse_parsed(
    parsed: DataFrame, *, title: str = "", url: str = "", bidder: str = "", location: str = "",
    relevant: str = "", notice_type: str = "", status: str = "",
) -> DataFrame:
    return parsed.where(
        all_of(
            has("title", title), has("url", url), has("bidder", bidder), has("location", location),
            {"yes": F.col("is_relevant"), "no": ~F.col("is_relevant")}.get(relevant),
            F.col("notice_type") == notice_type if notice_type else None,
            {"error": F.col("parse_errors").isNotNull(), "parsed": F.col("parse_errors").isNull()}.get(status),
        )
    )


def browse_messages(
    outbox: DataFrame, channels: DataFrame, as_of: datetime, *, status: str = "", days: int | None = None,
    title: str = "", url: str = "", notice_type: str = "",
) -> DataFrame:
    """Messages with the name of their channel."""
    found = outbox.where(
        all_of(
            F.col("status") == status if status else None,
            F.col("created_at") >= F.lit(as_of - timedelta(days=days)) if days is not None else None,
            has("title", title), has("url", url),
            F.col("notice_type") == notice_type if notice_type else None,
        )
    )
    names = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel"))
    return found.join(names, "channel_id", "left")


def browse_samples(
    samples: DataFrame, *, label: str = "", labeled_by: str = "", query: str = "", title: str = "",
    url: str = "", sample_id: int | None = None,
) -> DataFrame:
    """Samples, labelled ones after unlabelled, newest first."""
    found = samples.where(
        all_of(
            {
                "unlabeled": F.col("label").isNull(), "relevant": F.col("label") == 1,
                "irrelevant": F.col("label") == 0,
            }.get(label),
            {
                "ai": F.col("labeled_by") == "ai", "human": F.col("labeled_by") == "admin",
                "none": F.col("labeled_by").isNull(),
            }.get(labeled_by),
            has("search_query", query), has("title", title), has("url", url),
            F.col("id") == sample_id if sample_id is not None else None,
        )
    )
    return found


SAMPLE_ORDER = ("label", "created_at")


def sample_order() -> list[Column]:
    return [*[F.col(c).desc_nulls_first() for c in SAMPLE_ORDER], F.col("id").desc()]
