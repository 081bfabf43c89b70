"""Notice fields, each one expression over the page text or html."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.basics import (
    SPACE, ascii_digits, blank_to_null, contains_any, extract, first_of, leading, let, squeeze, strip,
)
from noticeworks.functions.dates import date_near, match_date
from noticeworks.functions.literals import may_match
from noticeworks.functions.text import strip_tags
from noticeworks.profile import WORD, Profile

# E-mail pattern, title metas, extra generic titles at fetch time,
# and phrases of blocked or error pages.
EMAIL = rf"(?<![{WORD}.+\-])[{WORD}.+\-]++@[{WORD}\-]+\.[{WORD}.]+"
ARTICLE_TITLE = r"""(?iU)<meta\s+name\s*=\s*["']ArticleTitle["']\s+content\s*=\s*["']([^"']+)["']"""
OG_TITLE = r"""(?iU)<meta\s+property\s*=\s*["']og:title["']\s+content\s*=\s*["']([^"']+)["']"""
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
H1_TAG = r"(?is)<h1[^>]*>(.*?)</h1>"
FETCH_GENERIC_TITLES = (
    "中国政府采购网", "政府采购信息网", "招标采购导航",
    "百度搜索", "bing", "google", "搜狗搜索", "360搜索",
    "首页", "网站首页", "index", "untitled",
)
BLOCKED_PAGE = (
    "请完成安全验证", "请完成验证", "访问太频繁", "访问过于频繁",
    "请输入验证码", "verification required", "are you a human",
    "您的访问出错了", "您访问的页面不存在", "页面找不到",
    "稍后重试", "robot check", "请稍后再试",
)
CAPTCHA_WORDS = (
    "captcha", "验证码", "verify", "slider", "滑块",
    "human verification", "access denied", "请完成验证",
)
LOGIN_WORDS = (
    "请登录", "login required", "sign in", "登录后查看",
    "请先登录", "会员登录", "用户登录",
)

TITLE_MAX = 500
TITLE_MIN = 4


def publish_date(text: Column, profile: Profile) -> Column:
    patterns = [(p, False) for p in profile.date_patterns]
    head = let(
        leading(text, profile.date_chars), lambda t: first_of(match_date(t, p) for p, _ in patterns)
    )
    return F.coalesce(date_near(text, profile.publish_hints, 80, patterns), head)


def _bid_time(text: Column, hints: tuple[str, ...], profile: Profile) -> Column:
    timed = len(profile.datetime_patterns) // 2
    patterns = [(p, i < timed) for i, p in enumerate(profile.datetime_patterns)]
    return date_near(text, hints, 120, patterns)


def bid_start_time(text: Column, profile: Profile) -> Column:
    return _bid_time(text, profile.bid_start_hints, profile)


def bid_end_time(text: Column, profile: Profile) -> Column:
    return _bid_time(text, profile.bid_end_hints, profile)


def bidder(text: Column, profile: Profile) -> Column:
    return let(
        F.regexp_replace(extract(text, profile.bidder), r"\s+", ""),
        lambda v: F.when(F.length(v).between(2, 50), v),
    )


def location(text: Column, profile: Profile) -> Column:
    labelled = F.regexp_replace(extract(text, profile.location), r"\s+", "")
    names = F.regexp_extract_all(leading(text, profile.place_chars), F.lit(profile.location_names), F.lit(1))
    places = F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n) >= 3)), 1, 3)
    return F.coalesce(labelled, blank_to_null(F.array_join(places, profile.location_joiner)))


def amount(text: Column, profile: Profile) -> Column:
    """Struct of the amount as shown and its value in the base unit."""

    def read(pattern: str) -> Column:
        def build(hit: Column) -> Column:
            number = F.regexp_replace(F.regexp_extract(hit, pattern, 1), "[,，]", "")
            unit = F.regexp_extract(hit, pattern, 2)
            scale = F.lit(1.0)
            for name, factor in profile.units:
                scale = F.when(unit == name, F.lit(factor)).otherwise(scale)
            value = ascii_digits(number).try_cast("double") * scale
            return F.when(
                value.isNotNull(), F.struct(F.concat(number, unit).alias("display"), value.alias("value"))
            )

        return let(F.regexp_extract(text, pattern, 0), build)

    units = [name for name, _ in profile.units]
    shared = units[0][-1]
    if all(name.endswith(shared) for name in units):
        return F.when(F.contains(text, F.lit(shared)), first_of(read(p) for p in profile.amounts))
    return first_of(read(p) for p in profile.amounts)


def contact(text: Column, profile: Profile) -> Column:
    person, phone, mobile, email = (F.lit(p) for p in profile.contact_prefixes)
    labelled = strip(extract(text, profile.phone))
    parts = F.concat_ws(
        "; ",
        F.concat(person, extract(text, profile.person)),
        F.coalesce(
            F.concat(phone, labelled),
            F.concat(mobile, extract(text, profile.mobile, 0)),
        ),
        F.when(F.contains(text, F.lit("@")), F.concat(email, extract(text, EMAIL, 0))),
    )
    return blank_to_null(parts)


def clean_title(title: Column, profile: Profile) -> Column:
    out = F.translate(strip_tags(title), " 　", "  ")
    out = F.regexp_replace(F.trim(squeeze(out)), profile.site_suffix, "")
    return F.left(F.trim(out), F.lit(TITLE_MAX))


def is_generic_title(title: Column, generic: tuple[str, ...]) -> Column:
    """Too short, or ending in a title that says nothing (in any case)."""
    ending = "|".join(re.escape(g) for g in generic)
    return F.coalesce(
        (F.length(title) < TITLE_MIN) | F.rlike(title, F.lit(rf"(?i)(?:{ending})[{SPACE}]*$")), F.lit(True)
    )


def _long_enough(title: Column) -> Column:
    return let(title, lambda t: F.when(F.length(t) >= TITLE_MIN, t))


def _title_in_html(html: Column, profile: Profile, generic: tuple[str, ...]) -> Column:
    def tag(pattern: str) -> Column:
        return _long_enough(clean_title(extract(html, pattern), profile))

    return F.coalesce(
        tag(ARTICLE_TITLE),
        tag(OG_TITLE),
        let(tag(TITLE_TAG), lambda t: F.when(~is_generic_title(t, generic), t)),
        tag(H1_TAG),
    )


def title(stored: Column, html: Column, text: Column, profile: Profile) -> Column:
    """Stored title if it says something, else the best title of the page."""

    def pick(own: Column) -> Column:
        telling = ~is_generic_title(own, profile.generic_titles)
        return F.coalesce(
            F.when(
                telling,
                F.coalesce(blank_to_null(clean_title(own, profile)), F.left(own, F.lit(TITLE_MAX))),
            ),
            _title_in_html(html, profile, profile.generic_titles),
            blank_to_null(F.left(own, F.lit(TITLE_MAX))),
            blank_to_null(
                F.left(strip(F.substring_index(strip(text), "\n", 1)), F.lit(TITLE_MAX))
            ),
        )

    return let(strip(stored), pick)


def fetched_title(html: Column, serp_title: Column, url: Column, profile: Profile) -> Column:
    """Title given to a page when it is fetched: page, then result page, then address."""
    page = _title_in_html(html, profile, FETCH_GENERIC_TITLES)
    offered = blank_to_null(strip(serp_title))
    telling = let(page, lambda t: F.when(~is_generic_title(t, FETCH_GENERIC_TITLES), t))
    return F.left(F.coalesce(telling, offered, page, url), F.lit(TITLE_MAX))


def notice_type(
    title_col: Column, text: Column, profile: Profile,
    model_type: Column | None = None, model_confidence: Column | None = None,
) -> Column:
    """First class whose pattern fits; a model's answer above 0.6 wins."""
    checked = F.concat(F.coalesce(title_col, F.lit("")), F.lit(" "), leading(text, profile.type_chars))
    # most classes are ruled out by words that a text does not have; where all patterns tell case apart, so do the words
    fold = F.lower if any("(?i" in pattern for _, pattern in profile.notice_types) else (lambda v: v)

    def by_rule(value: Column, held: Column) -> Column:
        def fits(pattern: str) -> Column:
            words = may_match(held, pattern, cased=fold is not F.lower)
            found = F.rlike(value, F.lit(pattern))
            return found if words is None else words & found

        return first_of(F.when(fits(pattern), F.lit(name)) for name, pattern in profile.notice_types)

    rule = let(checked, lambda value: by_rule(value, value) if fold is not F.lower else let(fold(value), lambda held: by_rule(value, held)))
    if model_type is None or model_confidence is None:
        return rule
    return F.coalesce(F.when(model_confidence > 0.6, model_type), rule)


def relevance(
    matched: Column, n_keywords: Column, *, score: Column | None = None,
    label: Column | None = None, confidence: Column | None = None,
    threshold: float = 0.5, digits: int = 2,
) -> Column:
    """Struct (is_relevant, relevance_score, model_type).

    Order: scoring model, then a classifier that is more than 70 % sure, then the
    share of keywords found, then unknown.
    """
    score = F.lit(None).cast("double") if score is None else score
    label = F.lit(None).cast("string") if label is None else label
    confidence = F.lit(None).cast("double") if confidence is None else confidence
    sure = F.coalesce(confidence > 0.7, F.lit(False)) & label.isNotNull()
    share = F.size(matched) / n_keywords
    relevant = label == "relevant"
    out = (
        F.when(
            score.isNotNull(),
            F.struct(
                (score >= threshold).alias("is_relevant"),
                F.round(score, 4).alias("relevance_score"),
                F.lit("score").alias("model_type"),
            ),
        )
        .when(
            sure,
            F.struct(
                relevant.alias("is_relevant"),
                F.round(F.when(relevant, confidence).otherwise(1 - confidence), digits).alias("relevance_score"),
                F.lit("classifier").alias("model_type"),
            ),
        )
        .when(
            n_keywords > 0,
            F.struct(
                (F.size(matched) > 0).alias("is_relevant"),
                F.round(share, digits).alias("relevance_score"),
                F.when(label.isNotNull(), F.lit("classifier")).otherwise(F.lit("keyword")).alias("model_type"),
            ),
        )
        .otherwise(
            F.struct(
                F.lit(None).cast("boolean").alias("is_relevant"),
                F.lit(None).cast("double").alias("relevance_score"),
                F.when(label.isNotNull(), F.lit("classifier")).otherwise(F.lit("keyword")).alias("model_type"),
            )
        )
    )
    return out


def antibot_reason(html: Column, min_chars: int | None = None) -> Column:
    """Why a page counts as blocked: missing, short (under ``min_chars``, where given) or phrase; NULL if it does not."""
    missing = F.when(html.isNull() | (html == ""), F.lit("missing"))
    sized = missing if min_chars is None else missing.when(F.length(html) < min_chars, F.lit("short"))
    return sized.when(contains_any(html, BLOCKED_PAGE), F.lit("phrase"))


def is_antibot_page(html: Column, min_chars: int | None = None) -> Column:
    """Empty or blocked page, or one under ``min_chars`` where that is given."""
    return antibot_reason(html, min_chars).isNotNull()


def is_captcha_page(status: Column, body: Column) -> Column:
    return F.coalesce(status.isin(200, 302) & contains_any(F.lower(body), CAPTCHA_WORDS), F.lit(False))


def is_login_page(status: Column, body: Column, target: Column) -> Column:
    redirected = status.isin(401, 302, 303) & F.contains(F.lower(target), F.lit("login"))
    asks = (status == 200) & contains_any(F.lower(body), LOGIN_WORDS)
    return F.coalesce(redirected, F.lit(False)) | F.coalesce(asks, F.lit(False))
