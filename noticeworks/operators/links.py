"""Links of stored pages: same-site links, result-page links, crawl frontier.

Links are cut, resolved and filtered as row-local arrays, so nothing is shuffled
before the links leave their page.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import let, strip, string_array
from noticeworks.functions.fields import fetched_title, is_antibot_page
from noticeworks.functions.text import strip_tags
from noticeworks.functions.urls import (
    is_result_url, join_url, netloc, path, scheme, url_hash,
)
from noticeworks.operators.merge import append_new_results, dedup_pages
from noticeworks.profile import ZH_TENDER, Profile
from noticeworks.session import GrowingCut, cut_bucketed

# File types that are no page, and the anchor patterns per engine.
SKIP_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".bmp", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".mp3", ".mp4", ".avi", ".wmv", ".flv",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
)
HREF = r"""(?i)href=["']([^"']+)["']"""
BAIDU_ATTRIBUTES = (r'(?i)mu="(https?://[^"]+)"', r'(?i)data-url="(https?://[^"]+)"')
BAIDU_ANCHOR = r'(?isU)<h3[^>]*>\s*<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'
BING_ANCHOR = (
    r'(?is)<li[^>]*class="[^"]*b_algo[^"]*"[^>]*>.*?<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'
)
H3_ANCHOR = r'(?is)<h3[^>]*>.*?<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>'
ANY_ANCHOR = r'(?i)<a[^>]+href="(https?://[^"]+)"'

LINKS_TYPE = "array<struct<url: string, title: string>>"


def same_site_links(html: Column, base_url: Column, allowed: Column, max_links: int | None = None) -> Column:
    """Distinct absolute links to allowed hosts, in page order; with ``max_links``, the first so many."""

    def wanted(href: Column) -> Column:
        other = F.exists(
            string_array(("#", "javascript:", "mailto:", "tel:")), lambda p: F.startswith(href, p)
        )
        return (href != "") & ~other

    def valid(url: Column) -> Column:
        extension = F.regexp_extract(F.lower(path(url)), r".(\.[^.]*)$", 1)
        return (
            scheme(url).isin("http", "https")
            & F.array_contains(allowed, netloc(url))
            & ~extension.isin(*SKIP_EXTENSIONS)
        )

    hrefs = F.filter(F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), strip), wanted)
    urls = F.filter(F.transform(hrefs, lambda h: join_url(base_url, h)), valid)
    links = F.array_distinct(urls)
    return links if max_links is None else F.slice(links, 1, max_links)


def page_links(
    pages: DataFrame, extra_domains: Iterable[str] = (), max_links: int | None = None, base_url: str | None = None
) -> DataFrame:
    """One row per link of a page: the host of the site plus ``extra_domains`` are allowed.

    The site is ``base_url``; without one, each page is taken for its own site.
    """
    extra = [d.strip() for d in extra_domains if d and d.strip()]
    site = netloc(F.col("url") if base_url is None else F.lit(base_url))
    allowed = F.concat(F.array(site), string_array(extra))
    links = same_site_links(F.col("html"), F.col("url"), allowed, max_links)
    return pages.select("url", F.posexplode(links).alias("position", "link")).withColumn(
        "link_hash", url_hash(F.col("link"))
    )


def serp_links(html: Column, engine: Column) -> Column:
    """Result links of one result page: array of (url, title), first per URL."""

    def anchors(pattern: str) -> Column:
        return F.zip_with(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
            F.regexp_extract_all(html, F.lit(pattern), F.lit(2)),
            lambda url, title: F.struct(url.alias("url"), strip(strip_tags(title, "")).alias("title")),
        )

    def bare(pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
            lambda url: F.struct(url.alias("url"), F.lit("").alias("title")),
        )

    def usable(links: Column, own: Column | str) -> Column:
        return F.filter(links, lambda link: is_result_url(link["url"], own))

    def first_per_url(links: Column) -> Column:
        def keep(ls: Column) -> Column:
            urls = F.transform(ls, lambda link: link["url"])
            return let(
                urls,
                lambda us: F.filter(ls, lambda link, i: F.array_position(us, link["url"]) == i + 1),
            )

        return let(links, keep)

    def or_any(links: Column, own: Column | str) -> Column:
        return let(links, lambda ls: F.when(F.size(ls) > 0, ls).otherwise(usable(bare(ANY_ANCHOR), own)))

    baidu_links = F.filter(
        anchors(BAIDU_ANCHOR), lambda link: ~F.contains(link["url"], F.lit("baidu.com/link"))
    )
    baidu = usable(F.concat(*[bare(p) for p in BAIDU_ATTRIBUTES], baidu_links), "baidu.com")
    found = (
        F.when(F.contains(engine, F.lit("baidu.com")), baidu)
        .when(F.contains(engine, F.lit("bing.com")), or_any(usable(anchors(BING_ANCHOR), "bing.com"), "bing.com"))
        .when(F.contains(engine, F.lit("sogou.com")), or_any(usable(anchors(H3_ANCHOR), "sogou.com"), "sogou.com"))
        .when(F.contains(engine, F.lit("so.com")), or_any(usable(anchors(H3_ANCHOR), "so.com"), "so.com"))
        .otherwise(usable(bare(ANY_ANCHOR), engine))
    )
    return first_per_url(found.cast(LINKS_TYPE))


def serp_results(serp_pages: DataFrame) -> DataFrame:
    """Result links of stored result pages (``url``, ``html``)."""
    links = serp_links(F.col("html"), netloc(F.col("url")))
    keep = [c for c in ("search_query", "source_name", "region_id", "crawled_at") if c in serp_pages.columns]
    return serp_pages.select(
        F.col("url").alias("serp_url"), *keep, F.posexplode(links).alias("position", "hit")
    ).select(
        "serp_url", *keep, "position", F.col("hit.url").alias("url"), F.col("hit.title").alias("title"),
        url_hash(F.col("hit.url")).alias("url_hash"), netloc(F.col("hit.url")).alias("domain"),
    )


def discover_results(serp_pages: DataFrame, results: DataFrame) -> DataFrame:
    """Links on stored result pages that are no known result yet, first sighting each."""
    return append_new_results(results, serp_results(serp_pages), ["serp_url", "position"])


def fetched_results(
    candidates: DataFrame, pages: DataFrame, results: DataFrame, profile: Profile = ZH_TENDER
) -> DataFrame:
    """New search results from discovered links and their fetched pages.

    Blocked and error pages give no result; the title comes from the page, then
    from the result page, then from the address.
    """
    new = append_new_results(results, candidates, ["serp_url", "position"])
    fetched = dedup_pages(pages.select("id", "url", "html", "crawled_at")).select(
        url_hash(F.col("url")).alias("url_hash"),
        is_antibot_page(F.col("html"), profile.min_page_chars).alias("blocked"),
        fetched_title(F.col("html"), F.lit(None).cast("string"), F.lit(None).cast("string"), profile).alias("page_title"),
    )
    joined = new.join(fetched, "url_hash", "left").where(~F.coalesce("blocked", F.lit(False)))
    title = F.coalesce("page_title", F.nullif(strip(F.col("title")), F.lit("")), "url")
    return joined.select(
        F.left(title, F.lit(500)).alias("title"), "url", "url_hash", "domain", "source_name", "search_query"
    )


def crawl_frontier(
    pages: DataFrame, seeds: DataFrame, max_depth: int | None = None, extra_domains: Iterable[str] = (),
    base_url: str | None = None,
) -> DataFrame:
    """Breadth-first depth of every URL reachable from ``seeds`` over stored pages.

    One equi join per level, until a level is empty or ``max_depth`` is reached.  Links and visited
    URLs are bucketed alike: a level is added to the visited table, so the links are joined with it
    and the found URLs are checked against all visited ones where they lie.  Only the found
    URLs of the level are shuffled, and a lost executor does not replay the levels before it.  Keys are the
    URLs themselves; a hash beside them would double what is shuffled and written.
    """
    edges = cut_bucketed(page_links(dedup_pages(pages), extra_domains, base_url=base_url).select("url", "link"), "url")
    visited = GrowingCut(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "url")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        visited.add(next_level(edges, visited.rows(), depth, "url"))
        if visited.rows().where(F.col("depth") == depth).isEmpty():
            break
    return visited.rows().select("url", url_hash(F.col("url")).alias("url_hash"), "depth")


def next_level(edges: DataFrame, visited: DataFrame, depth: int, key: str = "url_hash") -> DataFrame:
    """URLs one link behind those of the level before that are not visited yet.

    Links are (from_hash, link, link_hash) and visited URLs keyed by ``url_hash``, or, with the key ``url``, (url, link) and keyed by it.
    """
    source = "url" if key == "url" else "from_hash"
    level = visited.where(F.col("depth") == depth - 1).select(F.col(key).alias(source))
    linked = edges.join(level.hint("shuffle_hash"), source, "left_semi")
    if key == "url":
        found = linked.select(F.col("link").alias("url")).distinct()
    else:
        found = linked.groupBy(F.col("link_hash").alias("url_hash")).agg(F.min("link").alias("url"))
    return found.join(visited.select(key), key, "left_anti").withColumn("depth", F.lit(depth))
