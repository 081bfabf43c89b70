"""Any page of a long list, by order statistics.

An offset gathers all rows before the page in one task.  Here the rows are counted per range of
the sort key, the range of the page is cut into ranges again, and where very many rows share a value the next
sort key goes on.  What is sorted in the end are the rows from the start of that range on, and no task
keeps more of them than the range and the page hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_PAGE = 20
RANGES = 256
#: Rows of a range that a page is sorted from.
ROWS = 50_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_CHUNK = 7


@dataclass(frozen=True)
class SortKey:
    """A column to sort by; missing values come first when descending and last when ascending."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_first() if self.descending else F.col(self.column).asc_nulls_last()


def newest_keys(column: str = "publish_date", tie: str = "id") -> list[SortKey]:
    return [SortKey(column, True), SortKey(tie, True)]


@dataclass(frozen=True)
class _Place:
    """A number per row that never falls along the order; ``exact`` if equal numbers mean equal values."""

    number: Column
    exact: bool


def _places(df: DataFrame, key: SortKey) -> list[_Place]:
    """Numbers for a sort key: one for numbers and times, several pieces for a text."""
    kind, col = df.schema[key.column].dataType, F.col(key.column)

    def placed(number: Column) -> Column:
        # the least long is kept for missing values, so -1 - x cannot overflow
        turned = -1 - number if key.descending else number
        return F.coalesce(turned, F.lit(_LEAST if key.descending else _MOST))

    if isinstance(kind, T.StringType):
        return [
            _Place(placed(F.conv(F.hex(F.rpad(F.substring(F.col(key.column).cast("binary"), i * _CHUNK + 1, _CHUNK), _CHUNK, F.lit(b"\0"))), 16, 10).cast("bigint")), False)
            for i in range(4)
        ]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return [_Place(placed(col.cast("bigint")), True)]
    if isinstance(kind, T.DateType):
        return [_Place(placed(F.unix_date(col).cast("bigint")), True)]
    if isinstance(kind, T.TimestampType):
        return [_Place(placed(F.unix_micros(col)), True)]
    if isinstance(kind, T.TimestampNTZType):
        return [_Place(placed(F.unix_micros(col.cast("timestamp"))), True)]
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        held = F.least(F.greatest(col.cast("double"), F.lit(-9e18)), F.lit(9e18))
        return [_Place(placed(F.when(col.isNotNull(), F.floor(held))), False)]
    return []


def _histogram(rows: DataFrame, number: Column, ranges: int) -> list[tuple[int, int, int]]:
    """(least number, greatest number, rows) of about ``ranges`` ranges of about equal size, in order."""
    cuts = rows.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], ranges * 10)).first()[0]
    if not cuts:
        return []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))])
    place = F.size(F.filter(bounds, lambda b: b < F.col("_n")))
    counted = rows.select(number.alias("_n")).groupBy(place.alias("r")).agg(F.min("_n"), F.max("_n"), F.count(F.lit(1)))
    return [tuple(r)[1:] for r in sorted(counted.collect())]


def page_start(df: DataFrame, keys: list[SortKey], skip: int, rows: int = ROWS, ranges: int = RANGES) -> tuple[Column | None, int]:
    """(condition for the rows from a place at or shortly before position ``skip`` on, rows to skip behind it).

    None where the list is short, or too short for the position.
    """
    equal: list[tuple[Column, int]] = []
    places = [p for k in keys for p in _places(df, k)]
    bound = None
    for i, place in enumerate(places):
        here = reduce(lambda a, b: a & b, [n == v for n, v in equal], F.lit(True))
        low, high = _LEAST, _MOST
        while True:
            inside = df.where(here & place.number.between(low, high))
            found, before, size = None, 0, 0
            for least, greatest, size in _histogram(inside, place.number, ranges):
                if skip < before + size:
                    found = least, greatest
                    break
                before += size
            if found is None:  # behind the last row
                return _from(equal, bound), skip
            skip -= before
            bound = place.number, found[0]
            if size <= rows or found[0] == found[1] or found == (low, high):
                break
            low, high = found
        if size <= rows or found[0] != found[1] or i + 1 == len(places):
            break
        text_goes_on = not place.exact and i + 1 < len(places) and not places[i + 1].exact
        if not place.exact and not text_goes_on:
            break
        equal.append((place.number, found[0]))
        bound = None
    return _from(equal, bound), skip


def _from(equal: list[tuple[Column, int]], bound: tuple[Column, int] | None) -> Column | None:
    """Rows at or behind the place, along all keys."""
    condition = None if bound is None else bound[0] >= bound[1]
    for number, value in reversed(equal):
        behind = number > value
        condition = number >= value if condition is None else behind | ((number == value) & condition)
    return condition


def deep_page(df: DataFrame, keys: list[SortKey], page: int = 1, per_page: int = PER_PAGE, *, rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """A page of ``df`` in the order of ``keys``, as an offset gives it; rows equal in all keys come in any order."""
    skip = (max(page, 1) - 1) * per_page
    condition, left = page_start(df, keys, skip, rows, ranges) if skip > rows else (None, skip)
    behind = df if condition is None else df.where(condition)
    return behind.orderBy(*(k.order() for k in keys)).offset(left).limit(per_page)
