"""Small helpers the other expression modules share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class body: all white space.  The part before && rules out most characters with
# two cheap tests.
SPACE = (
    r"\x00-\x20\x85\xA0\u1680-\u3000"
    r"&&[ \t\n\x0B\f\r\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is bound to a value, so it can be used many times, also
    inside further lambdas, without computing ``value`` again.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(col: Column) -> Column:
    """Turn every run of white space into one space."""
    return F.regexp_replace(col, rf"[{SPACE}]+", " ")


def blank_to_null(col: Column) -> Column:
    """NULL for the empty string; unlike ``nullif`` it computes ``col`` once."""
    return let(col, lambda v: F.when(v != "", v))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; NULL when there is none."""
    return blank_to_null(F.regexp_extract(col, pattern, group))


def first_of(values: Iterable[Column]) -> Column:
    return F.coalesce(*values)


def ascii_digits(col: Column) -> Column:
    return F.translate(col, "０１２３４５６７８９", "0123456789")


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.expr("cast(array() as array<string>)")
    return F.array(*[F.lit(v) for v in values])


def has_at_least(col: Column, n: int, char_class: str) -> Column:
    """Are there ``n`` characters of a class?  Stops at the n-th, builds nothing."""
    return F.rlike(col, F.lit(rf"\A(?:[^{char_class}]*+[{char_class}]){{{n}}}"))


def leading(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all."""
    return text if chars is None else F.left(text, F.lit(chars))


def contains_any(text: Column, values: Iterable[str]) -> Column:
    """True when ``text`` contains one of ``values``; false for an empty list."""
    values = list(values)
    if not values:
        return F.lit(False)
    return let(text, lambda t: F.exists(string_array(values), lambda v: F.contains(t, v)))


def bounded_values(df: DataFrame, column: str, limit: int) -> list | None:
    """Distinct values of a settings column, or None when there are more than ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return sorted(r[0] for r in rows)
