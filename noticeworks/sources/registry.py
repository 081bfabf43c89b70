"""Source settings: JSON configuration and registry sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.dates import month_windows

CONFIG_SCHEMA = """
    type string, endpoint string, page_size int, max_pages_per_category int, max_pages int,
    first_page int, stop_on_all_visited boolean, single_page_only boolean, fetch_detail boolean,
    categories array<struct<num: string, name: string>>,
    channels array<struct<id: string, name: string>>,
    rubrics array<struct<id: string, name: string>>,
    list_url_template string, detail_url_template string, encoding string, site_id string,
    time_partition string, start_date string, end_date string,
    force_urls array<string>, extra_domains array<string>
"""

# Settings a source has unless its configuration says otherwise.
CONFIG_DEFAULTS = {
    "page_size": 20, "max_pages_per_category": 100, "max_pages": 30, "first_page": 1,
    "stop_on_all_visited": True, "single_page_only": False, "fetch_detail": True,
}

# Columns the code owns and columns the user owns.
CODE_COLUMNS = ("source_category", "base_url", "search_url_template", "config", "notes")
USER_COLUMNS = ("enabled", "rate_limit", "max_depth", "max_pages")


def parse_config(config: Column) -> Column:
    """Configuration struct; NULL fields for text that is no JSON object."""
    text = F.trim(config)
    return F.from_json(F.when(F.startswith(text, F.lit("{")), text), CONFIG_SCHEMA)


def source_config(sources: DataFrame) -> DataFrame:
    """Sources with their settings as ``settings.*``, defaults filled in."""
    parsed = sources.withColumn("_c", parse_config(F.col("config")))
    fields = [f.name for f in parsed.schema["_c"].dataType.fields]
    filled = [
        F.coalesce(f"_c.{name}", F.lit(CONFIG_DEFAULTS[name])).alias(name) if name in CONFIG_DEFAULTS
        else F.col(f"_c.{name}").alias(name)
        for name in fields
    ]
    return parsed.withColumn("settings", F.struct(*filled)).drop("_c")


def source_windows(sources: DataFrame, as_of: Column) -> DataFrame:
    """Category x month windows a source is read in; one open window without a month split."""
    split = (F.lower("settings.time_partition") == "month") & (F.coalesce("settings.start_date", F.lit("")) != "")
    end = F.coalesce(F.nullif("settings.end_date", F.lit("")), F.date_format(as_of, "yyyy-MM"))
    whole = F.array(F.struct(F.lit("").alias("start_day"), F.lit("").alias("end_day")))
    windows = F.when(split, month_windows(F.col("settings.start_date"), end)).otherwise(whole)
    return (
        source_config(sources)
        .select("id", "name", "settings", F.explode("settings.categories").alias("category"))
        .where(F.coalesce("category.num", F.lit("")) != "")
        .select(
            "id", "name", F.col("category.num").alias("category_num"),
            F.coalesce("category.name", F.lit("")).alias("category_name"), F.explode(windows).alias("w"),
        )
        .select("id", "name", "category_num", "category_name", "w.start_day", "w.end_day")
    )


def sync_sources(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """Registry after bringing in the default sources, with the ``action`` per row.

    Code columns are overwritten, user columns stay; new sources are created with
    all their defaults.  Actions: created, updated, unchanged, kept (not a default).
    """
    code = [c for c in CODE_COLUMNS if c in defaults.columns]
    cols = [c for c in existing.columns if c != "name"]
    old = existing.select("name", F.struct(*cols).alias("e"))
    new = defaults.select("name", F.struct(*[c for c in defaults.columns if c != "name"]).alias("d"))
    rows = old.join(new, "name", "full_outer")
    is_new, is_kept = F.col("e").isNull(), F.col("d").isNull()
    differs = F.lit(False)
    for c in code:
        differs = differs | ~F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}"))

    def value(c: str) -> Column:
        if c not in defaults.columns:
            return F.col(f"e.{c}").alias(c)
        if c in code:
            return F.when(is_kept, F.col(f"e.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
        fresh = F.coalesce(f"d.{c}", F.lit(True)) if c == "enabled" else F.col(f"d.{c}")
        return F.when(is_new, fresh).otherwise(F.col(f"e.{c}")).alias(c)

    action = (
        F.when(is_new, F.lit("created")).when(is_kept, F.lit("kept"))
        .when(differs, F.lit("updated")).otherwise(F.lit("unchanged"))
    )
    return rows.select("name", *[value(c) for c in cols], action.alias("action"))
