"""Page text: tag removal, content validity, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.basics import SPACE, blank_to_null, has_at_least, leading, let, squeeze
from noticeworks.profile import WORD, Profile

# Script code that shows a page holds no readable text.
SCRIPT_CODE = (
    rf"var\s+[{WORD}]+\s*=|function\s*[{WORD}]*\s*\(|document\.[{WORD}]|window\.[{WORD}]|"
    rf"\.getElementById|\.createElement|\.innerHTML|new\s+XMLHttpRequest|"
    rf"\.addEventListener|\.appendChild|console\.log|typeof\s+[{WORD}]|"
    rf"try\s*\{{|catch\s*\(|\.style\.[{WORD}]|\.className|return\s+(?:true|false|null)"
)

# Sizes of the summary rule.
SUMMARY_STOP = 300
SUMMARY_MAX = 500
SENTENCE_MIN = 10
FRAGMENT_MAX = 30
CHUNK = 200


def html_to_text(html: Column) -> Column:
    """Comments, scripts and tags out, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(
        out, rf"(?is)<[{SPACE}]*(script|style|noscript)[^>]*>.*?</[{SPACE}]*\1[{SPACE}]*>", " "
    )
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(squeeze(out))


def strip_tags(col: Column, by: str = " ") -> Column:
    return F.regexp_replace(col, r"<[^>]+>", by)


def strip_nul(col: Column) -> Column:
    return F.replace(col, F.char(F.lit(0)), F.lit(""))


def is_valid_content(text: Column, profile: Profile) -> Column:
    """Enough characters of the profile's script, and not just script code.

    Where the profile limits neither, a whole text with enough such characters is no mere code.
    """
    enough = has_at_least(leading(text, profile.script_chars), profile.min_script, profile.script)
    if profile.code_chars is not None or profile.script_chars is not None:
        head = leading(text, profile.code_chars)
        enough &= has_at_least(head, profile.min_script, profile.script) | ~F.rlike(head, F.lit(SCRIPT_CODE))
    return F.coalesce((F.length(F.trim(text)) >= 20) & enough, F.lit(False))


def take_until_length(parts: Column, limit: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Leading parts (``wanted`` ones only) up to and including the one whose running length passes ``limit``; the rest is not looked at."""
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("kept"),
        F.lit(0).alias("size"),
        F.lit(False).alias("full"),
    )

    def step(acc: Column, part: Column) -> Column:
        size = acc["size"] + F.length(part)
        added = F.struct(
            F.array_append(acc["kept"], part).alias("kept"),
            size.alias("size"),
            (size > limit).alias("full"),
        )
        passed = acc["full"] if wanted is None else acc["full"] | ~F.coalesce(wanted(part), F.lit(False))
        return F.when(passed, acc).otherwise(added)

    return F.aggregate(parts, start, step, lambda acc: acc["kept"])


def summary(text: Column, profile: Profile) -> Column:
    """First meaningful sentences, cut when their running length passes 300."""

    def chunks(t: Column) -> Column:
        starts = F.sequence(
            F.lit(0),
            F.greatest(F.length(t) - 1, F.lit(0)),
            F.lit(CHUNK),
        )
        return F.transform(starts, lambda i: F.substring(t, i + 1, F.lit(CHUNK)))

    def meaningful(s: Column) -> Column:
        # cheap tests first; three hits of navigation words need no count
        word = f"(?:{profile.nav_words})"
        fragment = F.rlike(s, F.lit(rf"^[{WORD} \-\.·|/、，,]+$"))
        return (
            (F.length(s) >= SENTENCE_MIN)
            & has_at_least(s, profile.min_sentence_script, profile.script)
            & ((F.length(s) >= FRAGMENT_MAX) | ~fragment)
            & ~F.rlike(s, F.lit(f"(?s){word}.*?{word}.*?{word}"))
            & ~F.rlike(s, F.lit(profile.junk))
        )

    sentences = let(
        text,
        lambda t: let(
            F.split(t, profile.sentence_break, -1),
            lambda parts: F.when(F.size(parts) <= 1, chunks(t)).otherwise(parts),
        ),
    )
    kept = take_until_length(F.transform(sentences, lambda s: F.trim(s)), SUMMARY_STOP, meaningful)
    return blank_to_null(F.left(F.array_join(kept, " "), F.lit(SUMMARY_MAX)))
