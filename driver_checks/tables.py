"""Merges, ledgers, reconciliation and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driver_checks.model import Model
from driver_checks.registry import query
from noticeworks import schemas
from noticeworks.operators import cleanup, crawl, merge, reconcile
from noticeworks.plans import jobs
from noticeworks.profile import LATIN_TEST
from noticeworks.session import shared_folder
from noticeworks.sources import tables
from noticeworks.sources.runs import RunTable

NEWEST = """
    SELECT id, url, crawled_at, search_query FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, id DESC) AS rn FROM m_page_log)
    WHERE rn = 1
"""


@query("pages_latest", NEWEST)
def pages_latest(m: Model):
    return merge.pages_latest(m.page_log).select("id", "url", "crawled_at", "search_query")


@query("dedup_pages_newest", NEWEST.replace("search_query FROM", "html FROM"))
def dedup_pages_newest(m: Model):
    return merge.dedup_pages(m.page_log).select("id", "url", "crawled_at", "html")


@query("dedup_pages_oldest", """
    SELECT id, url, crawled_at, html FROM (
        SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at ASC NULLS FIRST, id ASC) AS rn FROM m_page_log)
    WHERE rn = 1
""")
def dedup_pages_oldest(m: Model):
    return merge.dedup_pages(m.page_log, keep="oldest").select("id", "url", "crawled_at", "html")


MERGED_PAGES = """
    WITH base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at, id) AS rn
                  FROM m_page_log WHERE search_query = 'view') WHERE rn = 1),
    upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, id DESC) AS rn
            FROM m_page_log WHERE search_query <> 'view') WHERE rn = 1)
    SELECT coalesce(b.id, u.id) AS id, coalesce(b.url, u.url) AS url,
        CASE WHEN b.id IS NULL OR u.crawled_at >= b.crawled_at THEN u.html ELSE b.html END AS html,
        CASE WHEN b.id IS NULL OR u.crawled_at >= b.crawled_at THEN sha256(u.html) ELSE NULL END AS content_hash,
        CASE WHEN b.id IS NULL OR u.crawled_at >= b.crawled_at THEN u.search_query ELSE b.search_query END AS search_query
    FROM base b FULL OUTER JOIN upd u ON b.url = u.url
"""


@query("merge_pages", MERGED_PAGES)
def merge_pages(m: Model):
    base = merge.dedup_pages(m.page_log.where("search_query = 'view'"), "oldest").withColumn(
        "content_hash", F.lit(None).cast("string")
    )
    merged = merge.merge_raw_pages(base, m.page_log.where("search_query <> 'view'"))
    return merged.select("id", "url", "html", "content_hash", "search_query")


@query("merge_page_buckets", MERGED_PAGES)
def merge_page_buckets(m: Model):
    """The same delivery, brought into a stored table bucket by bucket, in two parts."""
    base = merge.dedup_pages(m.page_log.where("search_query = 'view'"), "oldest").withColumn(
        "content_hash", F.lit(None).cast("string")
    )
    path = f"{shared_folder(m.spark)}/pages-{uuid.uuid4().hex}"
    table = RunTable(m.spark, path, base.schema.toDDL(), "url", buckets=16)
    table.create(base)
    news = m.page_log.where("search_query <> 'view'")
    for part in range(2):
        table.merge(news.where(F.pmod(F.crc32("url"), F.lit(2)) == part), merge.merge_raw_pages)
    return table.read().select("id", "url", "html", "content_hash", "search_query")


@query("page_documents", """
    SELECT url, id, sha256(CASE WHEN n % 2 = 0 THEN concat(html, '<!-- again -->') ELSE html END) AS html_hash, n % 5 AS tries,
        CASE WHEN n % 2 = 0 THEN concat('proxy-', n % 3) ELSE source_name END AS via, CASE WHEN n % 2 = 0 THEN n END AS visit
    FROM (SELECT *, id::BIGINT AS n, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, id DESC) AS k FROM m_pages) WHERE k = 1
""")
def page_documents(m: Model):
    """Documents with fields of the crawler, stored as JSON, deduplicated, and merged with a second delivery."""
    def read(df):
        path = f"{shared_folder(m.spark)}/documents-{uuid.uuid4().hex}"
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
        return tables.read_page_documents(m.spark, path)

    n = F.col("id").cast("bigint")
    first = m.pages.select(
        "id", "url", "html", F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("crawled_at"), (n % 5).alias("tries"), F.struct(F.col("source_name").alias("via")).alias("fetch")
    )
    stored = merge.dedup_pages(read(first)).withColumn("content_hash", F.lit(None).cast("string"))
    again = merge.dedup_pages(m.pages).where(n % 2 == 0).select(
        F.lit("again").alias("id"), "url", F.concat("html", F.lit("<!-- again -->")).alias("html"),
        F.date_format(F.col("crawled_at") + F.expr("interval 1 year"), "yyyy-MM-dd HH:mm:ss").alias("crawled_at"),
        n.alias("visit"), F.struct(F.concat(F.lit("proxy-"), n % 3).alias("via")).alias("fetch"),
    )
    merged = merge.merge_raw_pages(stored, read(again))
    return merged.select(
        "url", "id", F.sha2("html", 256).alias("html_hash"), F.variant_get("rest", "$.tries", "bigint").alias("tries"),
        F.variant_get("rest", "$.fetch.via", "string").alias("via"), F.try_variant_get("rest", "$.visit", "bigint").alias("visit"),
    )


@query("append_new_results", """
    SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM m_visits WHERE event_type <> 'purchase')
    WHERE rn = 1 AND url_hash NOT IN (SELECT url_hash FROM m_visits WHERE event_type = 'purchase')
    UNION ALL SELECT id, url FROM m_samples WHERE url_hash NOT IN (SELECT url_hash FROM m_results)
""")
def append_new_results(m: Model):
    visits = merge.append_new_results(
        m.visits.where("event_type = 'purchase'"), m.visits.where("event_type <> 'purchase'")
    ).select("id", "url")
    samples = merge.append_new_results(m.results, m.samples).select("id", "url")
    return visits.unionByName(samples)


@query("upsert_results", """
    SELECT coalesce(r.url_hash, s.url_hash) AS url_hash, coalesce(r.id, s.id) AS id,
        CASE WHEN s.id IS NULL THEN r.title ELSE concat('new ', s.title) END AS title,
        CASE WHEN s.id IS NULL THEN r.search_query ELSE 'again' END AS search_query,
        CASE WHEN s.id IS NULL THEN r.publish_date ELSE s.created_at END AS publish_date,
        coalesce(r.domain, 'new.example') AS domain
    FROM m_results r FULL OUTER JOIN (SELECT * FROM m_samples WHERE labeled_by IS NOT NULL) s ON r.url_hash = s.url_hash
""")
def upsert_results(m: Model):
    updates = m.samples.where("labeled_by IS NOT NULL").selectExpr(
        "id", "concat('new ', title) AS title", "url", "url_hash", "'new.example' AS domain", "'again' AS search_query",
        "created_at AS publish_date", "created_at", "created_at AS updated_at",
    )
    return merge.upsert_results(m.results, updates).select(
        "url_hash", "id", "title", "search_query", "publish_date", "domain"
    )


@query("merge_visited", """
    WITH base AS (SELECT url_hash, min(visited_at) AS visited_at FROM m_visits WHERE event_type = 'view' GROUP BY 1),
    upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY visited_at DESC, id DESC) AS rn
            FROM m_visits WHERE event_type <> 'view') WHERE rn = 1)
    SELECT coalesce(b.url_hash, u.url_hash) AS url_hash, coalesce(u.status, 200) AS status,
        coalesce(u.search_query, 'view') AS search_query, coalesce(b.visited_at, u.visited_at) AS visited_at
    FROM base b FULL OUTER JOIN upd u ON b.url_hash = u.url_hash
""")
def merge_visited(m: Model):
    base = merge.first_wins(m.visits.where("event_type = 'view'"), ["url_hash"], ["visited_at", "id"])
    merged = merge.merge_visited(base, m.visits.where("event_type <> 'view'"))
    return merged.select("url_hash", "status", "search_query", "visited_at")


MERGED_PARSED = """
    SELECT coalesce(p.url_hash, n.url_hash) AS url_hash, coalesce(p.id, n.id) AS id,
        CASE WHEN n.id IS NULL THEN p.title ELSE n.title END AS title,
        CASE WHEN n.id IS NULL THEN p.summary WHEN p.id IS NULL THEN 'short' WHEN n.source_type = 'fr' THEN p.summary ELSE 'short' END AS summary,
        CASE WHEN n.id IS NULL THEN p.notice_type WHEN p.id IS NULL THEN 'kind' WHEN n.source_type = 'fr' THEN p.notice_type ELSE 'kind' END AS notice_type,
        CASE WHEN n.id IS NULL THEN p.parse_errors WHEN n.source_type = 'fr' THEN 'content_invalid: x' END AS parse_errors,
        coalesce(p.created_at, n.created_at) AS created_at
    FROM m_parsed p FULL OUTER JOIN m_results n ON p.url_hash = n.url_hash
"""


def parsed_updates(m: Model):
    return m.results.selectExpr(
        "id", "url", "url_hash", "title", "'short' AS summary", "'kind' AS notice_type",
        "if(source_type = 'fr', 'content_invalid: x', '') AS parse_errors", "created_at", "updated_at",
        "if(source_type = 'fr', 'invalid', 'ok') AS outcome",
    )


@query("merge_parsed", MERGED_PARSED)
def merge_parsed(m: Model):
    return merge.merge_parsed(m.parsed, parsed_updates(m)).select(
        "url_hash", "id", "title", "summary", "notice_type", "parse_errors", "created_at"
    )


@query("merge_parsed_buckets", MERGED_PARSED)
def merge_parsed_buckets(m: Model):
    """The same rows, brought into a stored table bucket by bucket."""
    path = f"{shared_folder(m.spark)}/parsed-{uuid.uuid4().hex}"
    table = RunTable(m.spark, path, schemas.PARSED_RESULTS, buckets=16)
    table.create(m.parsed)
    table.merge(parsed_updates(m), merge.merge_parsed)
    return table.read().select("url_hash", "id", "title", "summary", "notice_type", "parse_errors", "created_at")


@query("split_parsed", """
    SELECT d.id, CASE WHEN p.id IS NULL THEN 'unparsed' WHEN p.parse_errors IS NOT NULL THEN 'error' ELSE 'ok' END AS parse_state
    FROM m_doc_pages d LEFT JOIN m_parsed p ON d.url_hash = p.url_hash
""")
def split_parsed(m: Model):
    return merge.split_parsed(merge.with_page_keys(m.doc_pages), m.parsed).select("id", "parse_state")


@query("parse_modes", """
    SELECT mode, d.id FROM m_doc_pages d LEFT JOIN m_parsed p ON d.url_hash = p.url_hash,
        (VALUES ('unparsed_only'), ('errors_only'), ('all'), ('unparsed_and_errors'), ('whatever')) AS t(mode)
    WHERE d.source_type <> 'search_engine'
      AND CASE mode WHEN 'unparsed_only' THEN p.id IS NULL WHEN 'errors_only' THEN p.parse_errors IS NOT NULL
          WHEN 'all' THEN true ELSE p.id IS NULL OR p.parse_errors IS NOT NULL END
""")
def parse_modes(m: Model):
    keyed = merge.with_page_keys(m.doc_pages)
    out = None
    for mode in (*merge.PARSE_MODES, "whatever"):
        rows = merge.select_pages_to_parse(keyed, m.parsed, mode).select(F.lit(mode).alias("mode"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("unvisited", """
    SELECT url_hash, min(id) AS id FROM m_visits WHERE event_type <> 'purchase'
      AND url_hash NOT IN (SELECT url_hash FROM m_visits WHERE event_type = 'purchase' AND status = 200) GROUP BY 1
    UNION ALL SELECT url_hash, id FROM m_samples WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed)
""")
def unvisited(m: Model):
    seen = m.visits.where("event_type = 'purchase'")
    first = merge.unvisited(m.visits.where("event_type <> 'purchase'"), seen, ["id"]).select("url_hash", "id")
    return first.unionByName(merge.unvisited(m.samples, m.parsed, ["id"]).select("url_hash", "id"))


@query("union_forced", """
    SELECT url_hash, true AS forced FROM m_samples WHERE labeled_by = 'ai'
    UNION ALL SELECT url_hash, false FROM m_samples WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed)
""")
def union_forced(m: Model):
    forced = m.samples.where("labeled_by = 'ai'")
    return merge.union_forced(m.samples, forced, m.parsed, ["id"]).select("url_hash", "forced")


@query("first_wins", "SELECT url, min(id) AS id FROM m_visits GROUP BY url")
def first_wins(m: Model):
    return merge.first_wins(m.visits, ["url"], ["id"]).select("url", "id")


@query("drop_serp_pages", "SELECT id FROM m_pages WHERE source_type <> 'search_engine'")
def drop_serp_pages(m: Model):
    return merge.drop_serp_pages(m.pages).select("id")


@query("serp_report", """
    SELECT count(*) AS total, count(*) FILTER (source_type = 'search_engine') AS serp,
           count(*) FILTER (source_type <> 'search_engine') AS kept FROM m_pages
""")
def serp_report(m: Model):
    return merge.serp_report(m.pages)


@query("pending_results", "SELECT id FROM m_results WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed)")
def pending_results(m: Model):
    return reconcile.pending_results(m.results, m.parsed).select("id")


@query("orphan_parsed", "SELECT id FROM m_parsed WHERE url_hash NOT IN (SELECT url_hash FROM m_results)")
def orphan_parsed(m: Model):
    return reconcile.orphan_parsed(m.parsed, m.results).select("id")


@query("drop_orphans_safe", """
    SELECT id FROM m_parsed WHERE url_hash IN (SELECT url_hash FROM m_results)
        OR NOT (coalesce(notice_type IN ('search_serp', 'list_page'), false) OR coalesce(parse_errors, '') LIKE 'search_serp:%'
                OR coalesce(parse_errors, '') LIKE 'content_invalid:%' OR coalesce(parse_errors, '') LIKE 'listing_page:%')
""")
def drop_orphans_safe(m: Model):
    return reconcile.drop_orphans(m.parsed, m.results).select("id")


@query("clean_orphans_report", """
    SELECT count(*) AS before, count(*) FILTER (known) AS kept, count(*) FILTER (NOT known) AS dropped
    FROM (SELECT url_hash IN (SELECT url_hash FROM m_results) AS known FROM m_parsed)
""")
def clean_orphans_report(m: Model):
    return jobs.clean_orphans(m.parsed, m.results, "all")[1]


STATUS = """
    SELECT {key} AS url_hash, p.id AS parsed_id, r.id AS result_id, coalesce(d.url, p.url, r.url) AS url,
        coalesce(nullif(p.title, ''), CASE WHEN NOT prefix(r.title, 'http') THEN nullif(r.title, '') END,
                 nullif(d.meta_title, ''), '(未抓到标题)') AS title,
        coalesce(p.publish_date, r.publish_date) AS publish_date, coalesce(d.source_type, r.source_type, '') AS source_type,
        coalesce(d.search_query, p.search_query, r.search_query) AS search_query,
        coalesce(p.created_at, d.crawled_at, r.created_at) AS created_at,
        CASE WHEN p.id IS NOT NULL THEN CASE WHEN p.parse_errors IS NOT NULL THEN 'error' ELSE 'parsed' END
             WHEN d.id IS NOT NULL THEN 'unparsed' ELSE 'unfetched' END AS parse_status
"""
PAGE_SIDE = "(SELECT * FROM m_doc_pages WHERE url_hash NOT IN (SELECT url_hash FROM m_samples WHERE label = 0))"
STATUS_COLUMNS = (
    "url_hash", "parsed_id", "result_id", "url", "title", "publish_date", "source_type", "search_query", "created_at",
    "parse_status",
)


def stored_pages(m: Model):
    """Pages of all documents but those labelled as bad: some results stay without a page."""
    bad = m.samples.where("label = 0").select("url")
    return m.doc_pages.join(bad, "url", "left_anti")


@query("status_view", STATUS.format(key="r.url_hash") + f"""
    FROM m_results r LEFT JOIN {PAGE_SIDE} d ON r.url_hash = d.url_hash LEFT JOIN m_parsed p ON r.url_hash = p.url_hash
""")
def status_view(m: Model):
    return reconcile.status_view(m.results, stored_pages(m), m.parsed).select(*STATUS_COLUMNS)


@query("status_view_parsed", STATUS.format(key="p.url_hash") + f"""
    FROM m_parsed p LEFT JOIN {PAGE_SIDE} d ON p.url_hash = d.url_hash LEFT JOIN m_results r ON r.url_hash = p.url_hash
""")
def status_view_parsed(m: Model):
    return reconcile.status_view(m.results, stored_pages(m), m.parsed, driver="parsed").select(*STATUS_COLUMNS)


@query("registry_counts", """
    SELECT 'sources' AS registry, count(*) AS total, count(*) FILTER (enabled) AS enabled FROM m_sources
    UNION ALL SELECT 'regions', count(*), count(*) FILTER (enabled) FROM m_regions
    UNION ALL SELECT 'suffixes', count(*), count(*) FILTER (enabled) FROM m_suffixes
    UNION ALL SELECT 'keywords', count(*), count(*) FROM m_keywords
    UNION ALL SELECT 'results', count(*), NULL FROM m_results
""")
def registry_counts(m: Model):
    return reconcile.registry_counts(
        sources=m.sources, regions=m.regions, suffixes=m.suffixes, keywords=m.keywords, results=m.results
    )


@query("parse_health", """
    SELECT (SELECT count(*) FROM m_results) AS results, (SELECT count(*) FROM m_parsed WHERE parse_errors IS NULL) AS parsed_ok,
        (SELECT count(*) FROM m_parsed WHERE parse_errors IS NOT NULL) AS parsed_error,
        (SELECT count(*) FROM m_results WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed)) AS pending,
        (SELECT count(*) FROM m_parsed WHERE url_hash NOT IN (SELECT url_hash FROM m_results)) AS orphans,
        (SELECT count(*) FROM m_doc_pages) AS raw_pages
""")
def parse_health(m: Model):
    return reconcile.parse_health(m.results, m.parsed, m.doc_pages)


@query("orphan_by_type", """
    SELECT coalesce(notice_type, '<null>') AS notice_type, count(*) AS cnt FROM m_parsed
    WHERE url_hash NOT IN (SELECT url_hash FROM m_results) GROUP BY 1
""")
def orphan_by_type(m: Model):
    return reconcile.orphan_by_type(m.parsed, m.results)


@query("error_prefix_top", """
    SELECT substr(parse_errors, 1, 60) AS err_prefix, count(*) AS cnt FROM m_parsed WHERE parse_errors IS NOT NULL
    GROUP BY 1 ORDER BY cnt DESC, err_prefix LIMIT 20
""")
def error_prefix_top(m: Model):
    return reconcile.error_prefix_top(m.parsed)


@query("notice_type_top", """
    SELECT coalesce(notice_type, '<null>') AS notice_type, count(*) AS cnt FROM m_parsed GROUP BY 1
    ORDER BY cnt DESC, notice_type LIMIT 20
""")
def notice_type_top(m: Model):
    return reconcile.notice_type_top(m.parsed)


@query("domain_top", """
    SELECT domain, count(*) AS cnt FROM m_results WHERE domain <> '' GROUP BY 1 ORDER BY cnt DESC, domain LIMIT 200
""")
def domain_top(m: Model):
    return reconcile.domain_top(m.results)


@query("dup_report", """
    SELECT count(*) AS dup_urls, coalesce(sum(n - 1), 0)::bigint AS extra_docs
    FROM (SELECT url, count(*) AS n FROM m_page_log GROUP BY url HAVING count(*) > 1)
""")
def dup_report(m: Model):
    return reconcile.dup_report(m.page_log)


@query("dup_ratio", """
    SELECT count(*) AS documents, count(DISTINCT url) AS urls, round(count(*) / count(DISTINCT url), 4) AS ratio,
           count(*) / count(DISTINCT url) > 1.2 AS needs_dedup FROM m_page_log
""")
def dup_ratio(m: Model):
    return reconcile.dup_ratio(m.page_log)


@query("newest_orphans", """
    SELECT id, url, created_at, source_name, parse_errors IS NOT NULL AS has_err FROM m_parsed
    WHERE url_hash NOT IN (SELECT url_hash FROM m_results) ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 10
""")
def newest_orphans(m: Model):
    return reconcile.newest_orphans(m.parsed, m.results)


@query("action_report", """
    SELECT CASE WHEN p.id IS NULL THEN 'unparsed' WHEN p.parse_errors IS NOT NULL THEN 'error' ELSE 'ok' END AS action, count(*) AS cnt
    FROM m_doc_pages d LEFT JOIN m_parsed p ON d.url_hash = p.url_hash GROUP BY 1
""")
def action_report(m: Model):
    split = merge.split_parsed(merge.with_page_keys(m.doc_pages), m.parsed)
    return reconcile.action_report(split.withColumnRenamed("parse_state", "action"))


CRAWLED = """
    SELECT event_type AS source, concat('u', user_id) AS category, day(ts) AS page,
           md5(concat('http://v/', cast(floor(value) AS int))) AS url_hash, event_type <> 'error' AS ok FROM events
"""


@query("crawl_yield", f"""
    WITH c AS ({CRAWLED}), led AS (SELECT DISTINCT url_hash FROM c WHERE source = 'signup')
    SELECT source, category, page, count(*) AS returned, count(*) FILTER (NOT known AND ok) AS new,
           count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known AND NOT ok) AS failed
    FROM (SELECT c.*, led.url_hash IS NOT NULL AS known FROM c LEFT JOIN led ON c.url_hash = led.url_hash) GROUP BY ALL
""")
def crawl_yield(m: Model):
    rows = m.table("events").selectExpr(
        "event_type AS source", "concat('u', user_id) AS category", "day(ts) AS page",
        "md5(concat('http://v/', cast(floor(value) AS int))) AS url_hash", "event_type <> 'error' AS ok",
    )
    return crawl.crawl_yield(rows, rows.where("source = 'signup'"))


@query("incremental_stop", """
    WITH y AS (SELECT event_type AS source, 'all' AS category, concat('u', user_id) AS month, day(ts) AS page,
                      count(*) FILTER (value > 60) AS new FROM events GROUP BY ALL),
    cut AS (SELECT source, category, month, min(page) AS last_page FROM (
                SELECT *, lag(new) OVER (PARTITION BY source, category, month ORDER BY page) AS earlier FROM y)
            WHERE new = 0 AND earlier = 0 GROUP BY ALL)
    SELECT y.* FROM y LEFT JOIN cut USING (source, category, month) WHERE last_page IS NULL OR page <= last_page
""")
def incremental_stop(m: Model):
    """Days without events are gaps."""
    pages = m.table("events").groupBy(
        F.col("event_type").alias("source"), F.lit("all").alias("category"),
        F.concat(F.lit("u"), "user_id").alias("month"), F.dayofmonth("ts").alias("page"),
    ).agg(F.count_if(F.col("value") > 60).alias("new"))
    return crawl.incremental_stop(pages)


def delete_commands(m: Model):
    return m.samples.where("label = 0").selectExpr("concat('pr:', id) AS id").unionByName(
        m.samples.where("labeled_by = 'ai'").selectExpr("concat('sr:', id) AS id")
    )


DOOMED = "SELECT id FROM m_samples WHERE label = 0"


@query("cascade_delete", f"""
    SELECT 'parsed' AS kept_in, id FROM m_parsed WHERE id NOT IN ({DOOMED})
    UNION ALL SELECT 'results', id FROM m_results WHERE id NOT IN (SELECT id FROM m_samples WHERE labeled_by = 'ai')
    UNION ALL SELECT 'samples', id FROM m_samples WHERE id NOT IN ({DOOMED})
    UNION ALL SELECT 'outbox', id FROM m_parsed WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed WHERE id IN ({DOOMED}))
""")
def cascade_delete(m: Model):
    outbox = m.parsed.select("id", "url_hash")  # one message about each notice
    left = cleanup.cascade_delete(delete_commands(m), m.parsed, m.results, outbox, m.samples)
    out = None
    for name in ("parsed", "results", "samples", "outbox"):
        rows = left[name].select(F.lit(name).alias("kept_in"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("delete_channels", """
    SELECT 'channel' AS kept_in, id FROM m_channels WHERE enabled
    UNION ALL SELECT 'message', id FROM m_outbox WHERE channel_id IN (SELECT id FROM m_channels WHERE enabled)
""")
def delete_channels(m: Model):
    left = cleanup.delete_channels(m.channels.where("NOT enabled").select("id"), m.channels, m.outbox)
    return left["channels"].select(F.lit("channel").alias("kept_in"), "id").unionByName(
        left["outbox"].select(F.lit("message").alias("kept_in"), "id")
    )


@query("delete_regions", """
    SELECT r.id FROM m_regions r LEFT JOIN m_regions p ON r.parent_id = p.id
    WHERE r.name <> 'ASIA' AND coalesce(p.name, '') <> 'ASIA'
      AND coalesce(p.parent_id, -1) <> (SELECT id FROM m_regions WHERE name = 'ASIA')
""")
def delete_regions(m: Model):
    return cleanup.delete_regions(m.regions.where("name = 'ASIA'").select("id"), m.regions).select("id")


@query("parse_job", """
    SELECT coalesce(p.url_hash, d.url_hash) AS url_hash,
        coalesce(p.id, (SELECT max(id) FROM m_parsed) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY d.url_hash)) AS id,
        CASE WHEN d.id IS NULL THEN p.parse_errors WHEN d.valid THEN NULL
             WHEN d.short THEN 'too_short: 页面内容不足 50 个字符' ELSE 'content_invalid: 页面内容无效（JS/CSS/反爬页面），无有效中文内容' END AS parse_errors,
        CASE WHEN d.id IS NULL THEN p.is_relevant WHEN d.valid THEN contains(lower(d.text), 'the') ELSE false END AS is_relevant,
        CASE WHEN d.id IS NULL THEN p.summary IS NOT NULL WHEN d.valid THEN NULL ELSE p.summary IS NOT NULL END AS kept_summary
    FROM m_parsed p FULL OUTER JOIN (
        SELECT t.id, t.url_hash, t.text, length(t.html) < 50 AS short, length(t.html) >= 50 AND length(t.text) >= 20 AND len(regexp_extract_all(t.text, '\\p{L}')) >= 30 AS valid
        FROM m_doc_text t LEFT JOIN m_parsed q ON t.url_hash = q.url_hash
        WHERE t.source_type <> 'search_engine' AND (q.id IS NULL OR q.parse_errors IS NOT NULL)) d
    ON p.url_hash = d.url_hash
""")
def parse_job(m: Model):
    from driver_checks.model import AS_OF

    done = jobs.parse_job(m.doc_pages, m.parsed, ["the"], AS_OF, profile=LATIN_TEST)
    redone = F.col("updated_at") == F.lit(AS_OF)
    return done.select(
        "url_hash", "id", "parse_errors", "is_relevant",
        F.when(~redone | F.col("parse_errors").isNotNull(), F.col("summary").isNotNull()).alias("kept_summary"),
    )


ORPHANS = "FROM m_parsed WHERE url_hash NOT IN (SELECT url_hash FROM m_results)"


@query("diagnose", f"""
    SELECT * FROM (SELECT 'errors' AS report, substr(parse_errors, 1, 60) AS item, count(*) AS n FROM m_parsed
                   WHERE parse_errors IS NOT NULL GROUP BY 2 ORDER BY n DESC, item LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'notice_types', coalesce(notice_type, '<null>') AS item, count(*) AS n FROM m_parsed
                             GROUP BY 2 ORDER BY n DESC, item LIMIT 20)
    UNION ALL SELECT 'orphan_types', coalesce(notice_type, '<null>'), count(*) {ORPHANS} GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'newest_orphans', cast(id AS varchar), cast(parse_errors IS NOT NULL AS bigint) {ORPHANS}
                             ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 10)
    UNION ALL SELECT 'health', 'results', count(*) FROM m_results
    UNION ALL SELECT 'health', 'parsed_ok', count(*) FROM m_parsed WHERE parse_errors IS NULL
    UNION ALL SELECT 'health', 'parsed_error', count(*) FROM m_parsed WHERE parse_errors IS NOT NULL
    UNION ALL SELECT 'health', 'pending', count(*) FROM m_results WHERE url_hash NOT IN (SELECT url_hash FROM m_parsed)
    UNION ALL SELECT 'health', 'orphans', count(*) {ORPHANS}
    UNION ALL SELECT 'health', 'raw_pages', count(*) FROM m_doc_pages
    UNION ALL SELECT 'duplication', 'documents', count(*) FROM m_doc_pages
    UNION ALL SELECT 'duplication', 'urls', count(DISTINCT url) FROM m_doc_pages
""")
def diagnose(m: Model):
    reports = jobs.diagnose(m.results, m.parsed, m.doc_pages)
    shown = {
        "errors": ("err_prefix", "cnt"), "notice_types": ("notice_type", "cnt"), "orphan_types": ("notice_type", "cnt"),
        "newest_orphans": ("cast(id AS string)", "cast(has_err AS bigint)"),
    }
    out = None
    for name, df in reports.items():
        if name in shown:
            item, n = shown[name]
            rows = df.selectExpr(f"'{name}' AS report", f"{item} AS item", f"{n} AS n")
        else:
            counts = [c for c, kind in df.dtypes if kind == "bigint"]
            rows = df.selectExpr(f"'{name}' AS report", f"stack({len(counts)}, " + ", ".join(f"'{c}', {c}" for c in counts) + ") AS (item, n)")
        out = rows if out is None else out.unionByName(rows)
    return out
