"""URL keys, parts and predicates.

URL parts are cut with regular expressions: a strict URI parser rejects many of
the addresses that occur in crawled pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.basics import blank_to_null, let, string_array

# Result-page hosts and the path prefixes that mark a result page.
SERP_HOSTS = {
    "www.baidu.com": ("/s",),
    "m.baidu.com": ("/s",),
    "www.google.com": ("/search",),
    "google.com": ("/search",),
    "www.bing.com": ("/search",),
    "cn.bing.com": ("/search",),
    "bing.com": ("/search",),
    "www.sogou.com": ("/web", "/sogou"),
    "www.so.com": ("/s",),
    "m.so.com": ("/s",),
    "www.haosou.com": ("/s",),
    "duckduckgo.com": ("/", "/?"),
    "search.yahoo.com": ("/search",),
    "yz.m.sm.cn": ("/s",),
    "m.sm.cn": ("/s",),
    "so.toutiao.com": ("/search",),
}

# Domains that never are a search result.
SKIP_DOMAINS = (
    "baidu.com", "www.baidu.com", "baidustatic.com", "bdstatic.com", "bdimg.com",
    "bing.com", "www.bing.com", "cn.bing.com", "microsoft.com",
    "sogou.com", "www.sogou.com",
    "so.com", "www.so.com", "360.cn",
    "google.com", "googleapis.com",
)


def url_hash(url: Column) -> Column:
    return F.md5(url)


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """Host with port; empty when there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    raw = F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_param(url: Column, name: str) -> Column:
    """First non-empty value of one query parameter, decoded."""
    value = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)
    return blank_to_null(F.try_url_decode(value))


def domain(url: Column) -> Column:
    return netloc(url)


def _serp_pattern() -> str:
    """Hosts in any case, each followed by one of its paths; '/' also stands for no path."""
    hosts = []
    for host, prefixes in SERP_HOSTS.items():
        paths = "|".join("[/?#]|$" if p == "/" else re.escape(p) for p in prefixes)
        hosts.append(f"(?i:{re.escape(host)})(?:{paths})")
    return rf"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:{'|'.join(hosts)})"


def is_serp_url(url: Column) -> Column:
    """Is this address a search engine's own result page?"""
    return F.coalesce(F.rlike(url, F.lit(_serp_pattern())), F.lit(False))


def domain_matches(col: Column, suffix: str) -> Column:
    """``suffix`` itself or one of its subdomains."""
    suffix = suffix.strip().lower().lstrip(".")
    host = F.lower(col)
    return F.coalesce((host == suffix) | F.endswith(host, F.lit("." + suffix)), F.lit(False))


def is_result_url(url: Column, engine: Column | str) -> Column:
    """http(s) address outside the search engines' own domains."""
    engine = F.lit(engine) if isinstance(engine, str) else engine

    def allowed(host: Column) -> Column:
        skipped = F.exists(
            string_array(SKIP_DOMAINS),
            lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)),
        )
        own = (engine != "") & ((host == engine) | F.endswith(host, F.concat(F.lit("."), engine)))
        return (host != "") & ~skipped & ~F.coalesce(own, F.lit(False))

    return F.coalesce(
        scheme(url).isin("http", "https") & let(F.lower(netloc(url)), allowed), F.lit(False)
    )


def join_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``; the fragment is dropped, the query kept."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    absolute = F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    relative = F.regexp_replace(F.concat(F.lit("/"), folder, path(href)), r"/{2,}", "/")
    joined = (
        F.when(path(href) == "", path(base))
        .when(F.startswith(href, F.lit("/")), remove_dots(path(href)))
        .otherwise(remove_dots(relative))
    )
    rooted = F.when((joined == "") | F.startswith(joined, F.lit("/")), joined).otherwise(
        F.concat(F.lit("/"), joined)
    )
    tail = F.when(query(href) != "", F.concat(F.lit("?"), query(href))).when(
        (path(href) == "") & (query(base) != ""), F.concat(F.lit("?"), query(base))
    )
    own_tail = F.when(query(href) != "", F.concat(F.lit("?"), query(href)))
    full = F.concat(scheme(href), F.lit("://"), netloc(href), path(href))
    own_host = F.concat(scheme(base), F.lit("://"), netloc(href), path(href))
    return (
        F.when(absolute, F.concat(full, F.coalesce(own_tail, F.lit(""))))
        .when(F.startswith(href, F.lit("//")), F.concat(own_host, F.coalesce(own_tail, F.lit(""))))
        .otherwise(F.concat(root, rooted, F.coalesce(tail, F.lit(""))))
    )


def remove_dots(url_path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, seg: Column) -> Column:
        parent = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(seg == "..", parent).when(seg == ".", acc).otherwise(F.array_append(acc, seg))

    resolved = F.aggregate(F.split(url_path, "/", -1), empty, step)
    folder = F.rlike(url_path, F.lit(r"(?:^|/)\.{1,2}$"))
    cleaned = F.array_join(
        F.when(folder, F.array_append(resolved, F.lit(""))).otherwise(resolved), "/"
    )
    return F.when(
        F.rlike(url_path, F.lit(r"(?:^|/)\.{1,2}(?:/|$)")),
        F.coalesce(blank_to_null(cleaned), F.lit("/")),
    ).otherwise(url_path)


def fill_template(template: Column | str, **values: Column) -> Column:
    """Put column values into the ``{name}`` places of a URL template."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def host_in(host: Column, allowed: Iterable[str] | Column) -> Column:
    if isinstance(allowed, Column):
        return F.array_contains(allowed, host)
    return host.isin(*allowed)
