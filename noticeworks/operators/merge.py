"""Dedup, upsert and ledger merges.

Every reduction to one row per key is a ``max_by``/``min_by`` aggregation.  It
combines on the map side, so a URL that holds a third of the rows reaches the
shuffle as one row per task, where a window would sort it in a single task.
Joins happen only after both sides hold one row per key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import let
from noticeworks.functions.urls import content_hash, url_hash
from noticeworks.profile import LIST_PAGE, SEARCH_SERP

PARSE_MODES = ("unparsed_only", "errors_only", "all", "unparsed_and_errors")
MIN_HTML = 50

# Which outcomes write which columns of a parsed row: all of them, all but unreadable pages, good pages only.
PARSED_ALWAYS = ("url", "mongo_doc_id", "title", "search_query", "source_name", "is_relevant", "parser_version", "parse_errors")
PARSED_TYPED = ("notice_type", "relevance_score")
PARSED_FIELDS = (
    "summary", "publish_date", "bidder", "location", "bid_start_time", "bid_end_time",
    "amount", "amount_value", "contact", "matched_keywords",
)
UNREADABLE = ("invalid", "too_short")


def one_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str], keep: str = "last") -> DataFrame:
    """One whole row per key: the last (or first) by ``order``; missing values come first."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    return one_per_key(df, keys, order, keep="first")


def with_page_keys(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {"url_hash": url_hash(F.col("url")), "content_hash": content_hash(F.col("html"))}
    )


def dedup_pages(pages: DataFrame, keep: str = "newest") -> DataFrame:
    """Newest (or oldest) crawl of every URL; a missing crawl time counts as oldest."""
    key = ["url_hash"] if "url_hash" in pages.columns else ["url"]
    return one_per_key(pages, key, ["crawled_at", "id"], "last" if keep == "newest" else "first")


def pages_latest(pages: DataFrame, columns: Iterable[str] = ("id", "url", "crawled_at", "search_query", "source_name", "meta")) -> DataFrame:
    """Newest crawl per URL hash for display; html stays out of the shuffle."""
    slim = pages.select(*columns).withColumn("url_hash", url_hash(F.col("url")))
    return one_per_key(slim, ["url_hash"], ["crawled_at", "id"])


def upsert(
    base: DataFrame, updates: DataFrame, key: str, order: Iterable[str],
    overwrite: dict[str, Column | None] | Iterable[str], newer: str | None = None,
) -> DataFrame:
    """Full outer join merge of ``updates`` into ``base`` (one row per key).

    Known keys get the ``overwrite`` columns from the update, either always or
    where the given condition over the update's columns holds; all other columns
    stay.  Unknown keys are inserted.  With ``newer`` an update is ignored when
    the stored value of that column is later.
    """
    rules = overwrite if isinstance(overwrite, dict) else dict.fromkeys(overwrite)
    last = one_per_key(updates, [key], order)
    new = last.select(
        F.col(key).alias("_key"),
        F.struct(*[c for c in last.columns if c != key]).alias("_u"),
        F.struct(*[
            (F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))).alias(c)
            for c, cond in rules.items()
        ]).alias("_rule"),
    )
    old = base.withColumn("_old", F.lit(True))
    joined = old.join(new, old[key] == new["_key"], "full_outer")
    known = F.col("_old").isNotNull()
    applies = F.col("_key").isNotNull()
    if newer is not None:
        stale = F.col(newer).isNotNull() & (
            F.col(f"_u.{newer}").isNull() | (F.col(f"_u.{newer}") < F.col(newer))
        )
        applies = applies & ~(known & stale)

    def column(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(name), F.col("_key")).alias(name)
        if name not in last.columns:
            return F.col(name)
        stored, fresh = F.col(name), F.col(f"_u.{name}")
        if name not in rules:
            return F.when(known, stored).otherwise(fresh).alias(name)
        wins = ~known | (applies & F.col(f"_rule.{name}"))
        return F.when(F.coalesce(wins, F.lit(False)), fresh).otherwise(stored).alias(name)

    return joined.select(*[column(c) for c in base.columns])


def rest_fields(rest: Column) -> Column:
    """Unknown fields of a page by name; null for none, fields without a value left out."""
    fields = F.try_variant_get(rest, "$", "map<string,variant>")
    return F.map_filter(fields, lambda _, v: F.coalesce(~F.is_variant_null(v), F.lit(False)))


def joined_rest(stored: Column, fresh: Column) -> Column:
    """Unknown fields of a stored page with those of a newer one, which win."""
    both = let(
        rest_fields(fresh),
        lambda new: F.map_concat(F.map_filter(rest_fields(stored), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new),
    )
    return F.when(stored.isNull(), fresh).when(fresh.isNull(), stored).otherwise(F.to_variant_object(both))


def latest_rest(pages: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """(key, rest): of each unknown field of a key the value of its last row. Rows without unknown fields are not shuffled."""
    entries = pages.where(F.col("rest").isNotNull()).select(key, F.struct(*order).alias("_at"), F.explode(rest_fields(F.col("rest"))).alias("_k", "_v"))
    last = entries.groupBy(key, "_k").agg(F.max_by("_v", "_at").alias("_v"))
    return last.groupBy(key).agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("_k", "_v")))).alias("rest"))


def merge_raw_pages(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert crawled pages by URL; the newest crawl wins, ids and unknown fields stay.

    Where both tables carry ``url_hash`` it is the key, so tables bucketed by it merge without an exchange. Where both carry ``rest``, the
    fields that the schema does not know, stored ones stay unless a newer page has them too.
    """
    key = "url_hash" if "url_hash" in base.columns and "url_hash" in updates.columns else "url"
    owned = ("html", "content_hash", "crawled_at", "search_query", "source_name", "meta")
    fresh = updates.withColumn("content_hash", content_hash(F.col("html")))
    if "rest" not in base.columns or "rest" not in updates.columns:
        return upsert(base, fresh, key, ["crawled_at", "id"], owned, newer="crawled_at")
    last = one_per_key(fresh.drop("rest"), [key], ["crawled_at", "id"])
    fresh = last.join(latest_rest(updates, key, ["crawled_at", "id"]), key, "left").withColumn("_fresh_rest", F.col("rest"))
    held = base.withColumn("_fresh_rest", F.lit(None).cast("variant"))
    merged = upsert(held, fresh, key, ["crawled_at", "id"], (*owned, "_fresh_rest"), newer="crawled_at")
    return merged.select(*[joined_rest(F.col("rest"), F.col("_fresh_rest")).alias("rest") if c == "rest" else c for c in base.columns])


def append_new_results(existing: DataFrame, candidates: DataFrame, order: Iterable[str] = ("id",)) -> DataFrame:
    """First candidate of every URL that is not known yet."""
    return first_wins(candidates, ["url_hash"], order).join(
        existing.select("url_hash"), "url_hash", "left_anti"
    ).select(*candidates.columns)


def upsert_results(existing: DataFrame, updates: DataFrame, order: Iterable[str] = ("created_at", "id")) -> DataFrame:
    return upsert(existing, updates, "url_hash", order, ("title", "publish_date", "search_query", "updated_at"))


def merge_visited(ledger: DataFrame, updates: DataFrame, order: Iterable[str] = ("visited_at", "id")) -> DataFrame:
    """Create or update status and query; the first visit time stays."""
    return upsert(ledger, updates, "url_hash", order, ("status", "search_query"))


def parse_outcome(df: DataFrame) -> Column:
    if "outcome" in df.columns:
        return F.col("outcome")
    return (
        F.when(F.startswith(F.col("parse_errors"), F.lit("content_invalid")), F.lit("invalid"))
        .when(F.startswith(F.col("parse_errors"), F.lit("too_short")), F.lit("too_short"))
        .when(F.col("notice_type").isin(LIST_PAGE, SEARCH_SERP), F.lit("listing"))
        .otherwise(F.lit("ok"))
    )


def merge_parsed(existing: DataFrame, parsed: DataFrame, order: Iterable[str] = ("updated_at", "id")) -> DataFrame:
    """Create or update parsed rows by URL hash.

    Invalid and listing outcomes only own a few columns, so an earlier good
    extraction of the same page keeps its fields.
    """
    outcome = parse_outcome(parsed)
    fresh = parsed.withColumn("_outcome", outcome)
    rules: dict[str, Column | None] = dict.fromkeys((*PARSED_ALWAYS, "updated_at", "updated_by"))
    rules |= {c: ~F.col("_outcome").isin(*UNREADABLE) for c in PARSED_TYPED}
    rules |= {c: F.col("_outcome") == "ok" for c in PARSED_FIELDS}
    fresh = fresh.withColumn("parse_errors", F.nullif("parse_errors", F.lit("")))
    rules = {c: r for c, r in rules.items() if c in fresh.columns}
    order = [c for c in order if c in fresh.columns] or ["url"]
    return upsert(existing, fresh, "url_hash", order, rules)


def has_errors(parsed: DataFrame) -> Column:
    return F.coalesce(parsed["parse_errors"] != "", F.lit(False))


def split_parsed(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages with their parse state: ok, error or unparsed."""
    state = parsed.select(
        "url_hash", F.when(has_errors(parsed), F.lit("error")).otherwise(F.lit("ok")).alias("parse_state")
    )
    return pages.join(state, "url_hash", "left").withColumn(
        "parse_state", F.coalesce("parse_state", F.lit("unparsed"))
    )


def select_pages_to_parse(pages: DataFrame, parsed: DataFrame, mode: str = "unparsed_and_errors") -> DataFrame:
    """Pages the parse job has to work on; an unknown mode means the default."""
    work = drop_serp_pages(pages)
    if mode == "all":
        return work
    if mode == "unparsed_only":
        return work.join(parsed.select("url_hash"), "url_hash", "left_anti").select(*pages.columns)
    failed = has_errors(parsed)
    if mode == "errors_only":
        wanted = parsed.where(failed).select("url_hash")
        return work.join(wanted, "url_hash", "left_semi").select(*pages.columns)
    done = parsed.where(~failed).select("url_hash")
    return work.join(done, "url_hash", "left_anti").select(*pages.columns)


def unvisited(candidates: DataFrame, ledger: DataFrame, order: Iterable[str] = ("position",)) -> DataFrame:
    """First occurrence of every URL that was not fetched before."""
    return first_wins(candidates, ["url_hash"], order).join(
        ledger.select("url_hash"), "url_hash", "left_anti"
    ).select(*candidates.columns)


def union_forced(listed: DataFrame, forced: DataFrame, ledger: DataFrame, order: Iterable[str] = ("position",)) -> DataFrame:
    """New listed URLs plus all forced ones; ``forced`` rows are upserted later."""
    wanted = first_wins(forced, ["url_hash"], order).withColumn("forced", F.lit(True))
    fresh = unvisited(listed, ledger, order).join(wanted.select("url_hash"), "url_hash", "left_anti")
    return wanted.unionByName(fresh.select(*listed.columns).withColumn("forced", F.lit(False)))


def drop_serp_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(F.col("meta.source_type"), F.lit("")) != "search_engine")


def serp_report(pages: DataFrame) -> DataFrame:
    """Pages in total, result pages among them, pages that stay."""
    serp = F.count_if(F.col("meta.source_type") == "search_engine")
    return pages.agg(
        F.count(F.lit(1)).alias("total"), serp.alias("serp"),
        (F.count(F.lit(1)) - serp).alias("kept"),
    )
