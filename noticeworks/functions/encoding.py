"""Wrongly decoded and undecoded pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noticeworks.functions import charset as detector

# Runs of UTF-8 bytes read as Latin-1, and code pages tried in order.
MOJIBAKE_RUN = r"(?:[Â-ï][\u0080-¿]{2}){3,}"
HAN = r"[一-鿿]"
CODE_PAGES = ("utf-8", "gbk", "gb18030", "gb2312", "big5")
LATIN_NAMES = ("iso88591", "latin1", "latin-1")
OTHER_CHARSET = r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*(?!utf-?8\b)[a-zA-Z0-9_-]"""
META_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([a-zA-Z0-9_-]+)""", re.I)


def is_mojibake(html: Column) -> Column:
    return F.coalesce(
        (F.regexp_count(html, F.lit(HAN)) < 30) & (F.regexp_count(html, F.lit(MOJIBAKE_RUN)) >= 3),
        F.lit(False),
    )


def repaired(html: Column) -> Column:
    """Text read again as UTF-8; NULL when that is impossible or gives no Han text."""
    one_byte = ~F.rlike(html, F.lit(r"[^\x00-\xFF]"))
    again = F.when(one_byte, F.try_validate_utf8(F.encode(html, "ISO-8859-1").cast("string")))
    return F.when(F.rlike(again, F.lit(HAN)), again)


def fix_mojibake(pages: DataFrame) -> DataFrame:
    """Pages with repaired html and an ``action``: clean, fixed or unfixable."""
    checked = pages.withColumn("_bad", is_mojibake(F.col("html"))).withColumn(
        "_new", F.when(F.col("_bad"), repaired(F.col("html")))
    )
    return checked.select(
        *[F.coalesce("_new", "html").alias("html") if c == "html" else c for c in pages.columns],
        F.when(~F.col("_bad"), F.lit("clean"))
        .when(F.col("_new").isNotNull(), F.lit("fixed"))
        .otherwise(F.lit("unfixable"))
        .alias("action"),
    )


def decode_page(raw: bytes | None, charset: str | None) -> str | None:
    """Decode one page: header charset, meta charset, the likeliest code page, common code pages, lossy UTF-8."""
    if raw is None:
        return None
    head = META_CHARSET.search(raw)
    named = [n for n in (charset, head.group(1).decode() if head else None) if n]
    named = [n for n in named if n.lower().replace("-", "") not in LATIN_NAMES]
    for name in named:
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    if likely := detector.detect(raw):
        return detector.decode_as(raw, likely)
    for name in CODE_PAGES:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def _decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, charset in batches:
        yield pd.Series([decode_page(r, c) for r, c in zip(raw, charset)], dtype="object")


def decode_pages(pages: DataFrame) -> DataFrame:
    """Add ``html`` to pages stored as bytes (``body``, ``charset``).

    Valid UTF-8 without another declared charset stays in the JVM, as the detector
    would call it UTF-8 too.  Spark's own ``decode`` does not know the East Asian code
    pages, so the rest goes to an Arrow-batched pandas function.
    """
    charset = F.lower(F.coalesce(F.col("charset").cast("string"), F.lit("utf-8")))
    plain = F.is_valid_utf8(F.col("body").cast("string")) & (charset.isin("utf-8", "utf8", "latin-1") | F.replace(charset, F.lit("-"), F.lit("")).isin(*LATIN_NAMES))
    # a charset named in the page itself may still differ
    plain &= ~F.rlike(F.col("body").cast("string"), F.lit(OTHER_CHARSET))
    return pages.withColumn(
        "html", F.when(plain, F.col("body").cast("string")).otherwise(_decode(F.when(~plain, F.col("body")), F.col("charset").cast("string")))
    )
