"""Comma lists, region names and other small lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative suffixes for search and for alerts, level names.
SEARCH_SUFFIXES = ("市", "区", "县", "镇", "乡", "街道", "社区", "村")
ALERT_SUFFIXES = ("区", "县", "镇", "乡", "街道", "社区", "村")
LEVEL_LABELS = {
    "province": "省", "city": "市", "district": "区/县",
    "street": "街道", "town": "镇", "village": "村", "community": "社区",
}


def csv_set(col: Column) -> Column:
    """Comma or newline separated text as distinct trimmed entries."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), "[,\n]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def strip_region_suffix(name: Column, suffixes: tuple[str, ...] = SEARCH_SUFFIXES) -> Column:
    """Name without its administrative suffix, if two or more characters remain."""
    out = name
    for suffix in reversed(suffixes):
        fits = F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix) + 1)
        out = F.when(fits, F.left(name, F.length(name) - len(suffix))).otherwise(out)
    return out


def level_label(level: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LEVEL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, level), level)


def filter_days(months: int, extra: int) -> int:
    """Alert window in days; a window below one day falls back to 90."""
    days = months * 30 + extra
    return days if days >= 1 else 90
