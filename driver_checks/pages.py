"""Page scans, extraction columns, links and encodings."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from driver_checks.model import Model
from driver_checks.registry import query
from noticeworks.functions import dates, encoding, fields, labelling, text, urls
from noticeworks.functions.matching import with_name_hits
from noticeworks.operators import crawl, extract, links, merge
from noticeworks.plans import jobs
from noticeworks.profile import LATIN_TEST, ZH_TENDER
from noticeworks.session import dealt, shared_folder
from noticeworks.sources import feeds, registry as source_registry, tables


@query("page_scan", "SELECT id, url, crawled_at, search_query, source_name FROM m_pages")
def page_scan(m: Model):
    """Pages stored and read again with the columns asked for."""
    path = f"{shared_folder(m.spark)}/pages-{uuid.uuid4().hex}"
    m.pages.write.parquet(path)
    return tables.read_raw_pages(m.spark, path, ("id", "url", "crawled_at", "search_query", "source_name"))


@query("nul_text", "SELECT doc_id, concat(lang, text) AS clean FROM documents")
def nul_text(m: Model):
    nul = F.char(F.lit(0))
    return m.docs.select("doc_id", text.strip_nul(F.concat("lang", nul, "text", nul, nul)).alias("clean"))


@query("user_field", """
    SELECT url_hash, CASE WHEN length(html) >= 50 AND length(text) >= 20 AND len(regexp_extract_all(text, '\\p{L}')) >= 30
                          THEN length(text) END AS n_text FROM m_doc_text
""")
def user_field(m: Model):
    """A field of the caller next to the built-in ones."""
    extract.register_field("n_text", lambda text_col, html, ctx, profile: F.length(text_col))
    try:
        return extract.extract_notices(m.doc_pages, ["the"], LATIN_TEST).select("url_hash", F.col("n_text").cast("bigint").alias("n_text"))
    finally:
        extract.drop_field("n_text")


@query("page_keys", "SELECT id, md5(url) AS url_hash, sha256(html) AS content_hash FROM m_pages")
def page_keys(m: Model):
    return merge.with_page_keys(m.pages).select("id", "url_hash", "content_hash")


@query("page_text", "SELECT id, text FROM m_page_text")
def page_text(m: Model):
    return m.pages.select("id", text.html_to_text(F.col("html")).alias("text"))


@query("page_titles", """
    SELECT id, CASE WHEN length(t) >= 4 AND NOT suffix(lower(t), 'bing') AND NOT suffix(lower(t), 'google') THEN t
                    WHEN length(h) >= 4 THEN h ELSE substr(trim(text), 1, 500) END AS title
    FROM (SELECT id, text,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS h
        FROM m_page_text)
""")
def page_titles(m: Model):
    staged = m.pages.select("id", "html", "meta", text.html_to_text(F.col("html")).alias("text"))
    title = fields.title(F.col("meta.title"), F.col("html"), F.col("text"), LATIN_TEST)
    return staged.select("id", title.alias("title"))


@query("fetched_titles", """
    SELECT id, CASE WHEN length(t) >= 4 THEN t WHEN length(h) >= 4 THEN h ELSE url END AS title
    FROM (SELECT id, url,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
        trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS h
        FROM m_page_text)
""")
def fetched_titles(m: Model):
    title = fields.fetched_title(F.col("html"), F.lit(""), F.col("url"), LATIN_TEST)
    return m.pages.select("id", title.alias("title"))


@query("valid_content", """
    SELECT id, length(text) >= 20 AND len(regexp_extract_all(text, '\\p{L}')) >= 30 AS valid FROM m_doc_text
""")
def valid_content(m: Model):
    staged = m.doc_pages.select("id", text.html_to_text(F.col("html")).alias("text"))
    return staged.select("id", text.is_valid_content(F.col("text"), LATIN_TEST).alias("valid"))


PHRASES = "contains({0}, 'robot check') OR contains({0}, 'are you a human') OR contains({0}, 'verification required')"


@query("antibot_pages", f"""
    SELECT id, html = '' OR {PHRASES.format("html")} AS blocked, CASE WHEN html = '' THEN 'missing' WHEN {PHRASES.format("html")} THEN 'phrase' END AS reason,
        CASE WHEN html = '' THEN 'missing' WHEN length(html) < 1024 THEN 'short' WHEN {PHRASES.format("html")} THEN 'phrase' END AS reason_by_size
    FROM m_doc_pages
""")
def antibot_pages(m: Model):
    """By what a page says, and by its size too, as a profile may ask for."""
    html = F.col("html")
    return m.doc_pages.select(
        "id", fields.is_antibot_page(html).alias("blocked"), fields.antibot_reason(html).alias("reason"),
        fields.antibot_reason(html, 1024).alias("reason_by_size"),
    )


@query("response_flags", f"""
    SELECT doc_id AS id, status IN (403, 429, 503, 407) AS blocked,
        status IN (200, 302) AND (contains(lower(text), 'captcha') OR contains(lower(text), 'verify')
            OR contains(lower(text), 'slider') OR contains(lower(text), 'human verification')
            OR contains(lower(text), 'access denied')) AS captcha,
        (status IN (401, 302, 303) AND contains(lower(target), 'login'))
            OR (status = 200 AND (contains(lower(text), 'sign in') OR contains(lower(text), 'login required'))) AS login,
        text = '' OR {PHRASES.format("text")} AS antibot
    FROM (SELECT doc_id, text, CASE lang WHEN 'de' THEN 403 WHEN 'fr' THEN 302 ELSE 200 END AS status,
                 CASE WHEN lang = 'fr' THEN concat('/', source, '/LOGIN') END AS target FROM m_docs)
""")
def response_flags(m: Model):
    responses = m.docs.selectExpr(
        "doc_id AS id", "CASE lang WHEN 'de' THEN 403 WHEN 'fr' THEN 302 ELSE 200 END AS status",
        "text AS body", "if(lang = 'fr', concat('/', source, '/LOGIN'), null) AS location",
    )
    return crawl.response_flags(responses).select("id", "blocked", "captcha", "login", "antibot")


@query("serp_urls", """
    SELECT event_id, url, event_type IN ('view', 'click') AS serp FROM (
        SELECT event_id, event_type, CASE event_type WHEN 'view' THEN concat('https://WWW.baidu.com/s?wd=', user_id)
            WHEN 'click' THEN concat('http://cn.bing.com/search?q=', user_id)
            WHEN 'error' THEN concat('http://www.baidu.com/', user_id)
            WHEN 'signup' THEN concat('http://www.baidu.com:80/s?', user_id)
            ELSE concat('http://u', user_id, '.example/s') END AS url FROM events)
""")
def serp_urls(m: Model):
    made = m.table("events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN concat('https://WWW.baidu.com/s?wd=', user_id) "
        "WHEN 'click' THEN concat('http://cn.bing.com/search?q=', user_id) "
        "WHEN 'error' THEN concat('http://www.baidu.com/', user_id) "
        "WHEN 'signup' THEN concat('http://www.baidu.com:80/s?', user_id) "
        "ELSE concat('http://u', user_id, '.example/s') END AS url",
    )
    return made.select("event_id", "url", urls.is_serp_url(F.col("url")).alias("serp"))


@query("result_urls", """
    SELECT id, url, NOT suffix(host, '.example.com') AND host <> 'example.com' AS valid
    FROM (SELECT id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM m_pages)
""")
def result_urls(m: Model):
    return m.pages.select("id", "url", urls.is_result_url(F.col("url"), "example.com").alias("valid"))


@query("url_parts", """
    SELECT id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain,
        regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
        nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS page_param
    FROM m_pages
""")
def url_parts(m: Model):
    url = F.col("url")
    return m.pages.select(
        "id", urls.domain(url).alias("domain"), urls.path(url).alias("path"),
        urls.query_param(url, "page").alias("page_param"),
    )


@query("domain_filter", """
    SELECT id, url FROM m_pages WHERE source_name = 'example.org' OR suffix(lower(source_name), '.example.org')
""")
def domain_filter(m: Model):
    return m.pages.where(urls.domain_matches(F.col("source_name"), "example.org")).select("id", "url")


@query("page_links", """
    SELECT url, link, md5(link) AS link_hash FROM (
        SELECT DISTINCT url, concat(root, regexp_extract(href, '^([^?#]*)', 1)) AS link FROM (
            SELECT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
                   unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM m_pages))
    WHERE NOT regexp_matches(lower(link), '\\.(jpg|jpeg|png|gif|svg|ico|bmp|webp|pdf|docx?|xlsx?|pptx?|zip|rar|tar|gz|7z|mp3|mp4|avi|wmv|flv|css|js|woff2?|ttf|eot)$')
""")
def page_links(m: Model):
    return links.page_links(m.pages).select("url", "link", "link_hash")


@query("serp_results", """
    SELECT concat('https://www.sogou.com/web?query=', id) AS serp_url, url, trim(t) AS title, md5(url) AS url_hash,
           source_name AS domain
    FROM (SELECT id, url, source_name, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g') AS t FROM m_pages)
    WHERE url NOT LIKE '%"%'
""")
def serp_results(m: Model):
    shown = F.regexp_extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>", 1)
    serp = m.pages.select(
        F.concat(F.lit("https://www.sogou.com/web?query="), "id").alias("url"),
        F.concat(
            F.lit('<h3 class="r"><a href="'), "url", F.lit('">'), shown, F.lit('</a></h3><h3><a href="'), "url",
            F.lit('">again</a></h3><h3><a href="http://www.sogou.com/x">own</a></h3>'),
        ).alias("html"),
    )
    return links.serp_results(serp).select("serp_url", "url", "title", "url_hash", "domain")


@query("discover_results", """
    SELECT url, md5(url) AS url_hash, domain, min(serp_url) AS serp_url FROM (
        SELECT concat('https://other.example/?', doc_id) AS serp_url, url, concat(source, '.example') AS domain FROM m_docs)
    WHERE md5(url) NOT IN (SELECT url_hash FROM m_results) GROUP BY ALL
""")
def discover_results(m: Model):
    serp = m.docs.select(
        F.concat(F.lit("https://other.example/?"), "doc_id").alias("url"),
        F.concat(F.lit('<a class=x href="'), "url", F.lit('">x</a>')).alias("html"),
        F.lit("q").alias("search_query"), F.lit("s").alias("source_name"),
    )
    return links.discover_results(serp, m.results).select("url", "url_hash", "domain", "serp_url")


@query("fetched_results", f"""
    SELECT url, md5(url) AS url_hash, url AS title
    FROM m_doc_pages WHERE md5(url) NOT IN (SELECT url_hash FROM m_results) AND html <> '' AND NOT ({PHRASES.format("html")})
""")
def fetched_results(m: Model):
    serp = m.docs.select(
        F.concat(F.lit("https://other.example/?"), "doc_id").alias("url"),
        F.concat(F.lit('<a class=x href="'), "url", F.lit('">x</a>')).alias("html"),
        F.lit("q").alias("search_query"), F.lit("s").alias("source_name"),
    )
    found = links.fetched_results(links.serp_results(serp), m.doc_pages, m.results, LATIN_TEST)
    return found.select("url", "url_hash", "title")


@query("crawl_frontier", """
    SELECT url, md5(url) AS url_hash, length(cast(9 * k + 1 AS varchar)) - 1 AS depth FROM (
        SELECT k, concat('http://orders.example/', k) AS url FROM (
            SELECT 0 AS k UNION SELECT 10 * id + c FROM m_notices, generate_series(1, 10) AS g(c)))
""")
def crawl_frontier(m: Model):
    """Order n links to the orders 10 n + 1 to 10 n + 10."""
    ten = F.transform(
        F.sequence(F.lit(1), F.lit(10)),
        lambda c: F.concat(F.lit('<a href="/'), (F.col("id") * 10 + c).cast("string"), F.lit('">x</a>')),
    )
    walk = m.notices.select(
        F.col("id").cast("string").alias("id"), "url", F.array_join(ten, "").alias("html"),
        F.col("publish_date").alias("crawled_at"),
    )
    seeds = m.notices.where("id = 0").select("url")
    return links.crawl_frontier(walk, seeds)


@query("contacts", """
    SELECT id, nullif(concat_ws('; ',
        CASE WHEN m <> '' THEN concat('mobile: ', m) END, CASE WHEN e <> '' THEN concat('email: ', e) END), '') AS contact
    FROM (SELECT id, regexp_extract(text, '\\d{3}-\\d{3}-\\d{4}') AS m,
                 regexp_extract(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.]+') AS e FROM m_doc_text)
""")
def contacts(m: Model):
    staged = m.doc_pages.select("id", text.html_to_text(F.col("html")).alias("text"))
    return staged.select("id", fields.contact(F.col("text"), LATIN_TEST).alias("contact"))


@query("locations", """
    SELECT id, nullif(array_to_string(list_distinct_in_order[1:3], ', '), '') AS location FROM (
        SELECT id, list_filter(names, lambda n, i: list_position(names, n) = i) AS list_distinct_in_order FROM (
            SELECT id, regexp_extract_all(text, '([A-Z][a-z]{2,}(?:tion|edon|erin))', 1) AS names FROM m_doc_text))
""")
def locations(m: Model):
    staged = m.doc_pages.select("id", text.html_to_text(F.col("html")).alias("text"))
    return staged.select("id", fields.location(F.col("text"), LATIN_TEST).alias("location"))


@query("notice_types", """
    SELECT id, CASE WHEN regexp_matches(t, '(?i)\\b(award|winner)\\b') THEN 'award'
        WHEN regexp_matches(t, '(?i)\\b(correction|amend\\w*)\\b') THEN 'change'
        WHEN regexp_matches(t, '(?i)\\b(the|der|les|los)\\b') THEN 'tender' END AS notice_type
    FROM (SELECT id, concat(meta_title, ' ', text) AS t FROM m_doc_text)
""")
def notice_types(m: Model):
    staged = m.doc_pages.select("id", "meta", text.html_to_text(F.col("html")).alias("text"))
    kind = fields.notice_type(F.col("meta.title"), F.col("text"), LATIN_TEST)
    return staged.select("id", kind.alias("notice_type"))


KEYWORDS_SQL = """
    SELECT doc_id, coalesce(string_agg(keyword, ',' ORDER BY id) FILTER (hit), '') AS matched,
           count(*) FILTER (hit) > 0 AS is_relevant, round(count(*) FILTER (hit) / count(*), 2) AS score
    FROM (SELECT doc_id, keyword, id, contains(lower(text), keyword) AS hit FROM documents, m_keywords) GROUP BY doc_id
"""


@query("keyword_relevance", KEYWORDS_SQL)
def keyword_relevance(m: Model):
    hits = extract.with_keyword_hits(m.docs.select("doc_id", "text"), m.keywords, key="doc_id")
    judged = hits.withColumn("r", fields.relevance(F.col("matched"), F.col("n_keywords")))
    return judged.select(
        "doc_id", F.array_join("matched", ",").alias("matched"), F.col("r.is_relevant").alias("is_relevant"),
        F.col("r.relevance_score").alias("score"),
    )


@query("keyword_join", """
    SELECT doc_id, string_agg(keyword, ',' ORDER BY keyword) AS matched
    FROM m_docs, m_keywords WHERE contains(lower(text), keyword) GROUP BY doc_id
""")
def keyword_join(m: Model):
    names = m.keywords.select(F.col("keyword").alias("name"))
    hits = with_name_hits(m.docs.select("doc_id", "text"), "doc_id", F.col("text"), names, "hits", ignore_case=True, limit=0)
    return hits.where(F.size("hits") > 0).select("doc_id", F.array_join("hits", ",").alias("matched"))


# no look-behind here: sentence ends are marked first, then the text is split at the marks
SUMMARY_SQL = """
    WITH marked AS (SELECT id, text, string_split(regexp_replace(regexp_replace(regexp_replace(text, '([!?])\\s*', '\\1' || chr(1), 'g'),
            '(\\.\\s)', '\\1' || chr(1), 'g'), '(;\\s)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM m_doc_text),
    segments AS (SELECT id, CASE WHEN len(parts) <= 1
            THEN list_transform(generate_series(0, greatest(length(text) - 1, 0), 200), lambda i: trim(substr(text, i + 1, 200)))
            ELSE list_transform(parts, lambda s: trim(s)) END AS segs FROM marked),
    good AS (SELECT id, list_filter(segs, lambda s: length(s) >= 10 AND len(regexp_extract_all(s, '\\p{L}')) >= 5
            AND NOT (length(s) < 30 AND regexp_full_match(s, '[\\p{L}\\p{N}_ \\-.·|/、，,]+'))
            AND len(regexp_extract_all(s, 'login|register|more|home')) < 3
            AND NOT regexp_matches(s, '(?i)Copyright|All Rights Reserved|ICP备|var\\s+[\\p{L}\\p{N}_]+\\s*=|function\\s*[\\p{L}\\p{N}_]*\\s*\\(|document\\.[\\p{L}\\p{N}_]|window\\.[\\p{L}\\p{N}_]|\\.getElementById|\\.createElement|\\.innerHTML|new\\s+XMLHttpRequest|\\.addEventListener|console\\.log|return\\s+(?:true|false)|typeof\\s+[\\p{L}\\p{N}_]|\\$\\(|jQuery|\\.css\\(|\\.ajax\\(|\\.ready\\(')) AS segs FROM segments)
    SELECT id, nullif(substr(array_to_string(list_filter(segs, lambda s, i:
        coalesce(list_sum(list_transform(segs[1:i - 1], lambda z: length(z))), 0) <= 300), ' '), 1, 500), '') AS summary FROM good
"""


@query("summaries", SUMMARY_SQL)
def summaries(m: Model):
    staged = m.doc_pages.select("id", text.html_to_text(F.col("html")).alias("text"))
    return staged.select("id", text.summary(F.col("text"), LATIN_TEST).alias("summary"))


@query("listing_pages", """
    SELECT doc_id AS id, n AS text_links, n AS dated_links, 1.0::double AS ratio,
           CASE WHEN n >= 15 THEN 'abs>=15' ELSE 'ratio>=0.30' END AS rule
    FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}')) AS n FROM documents) WHERE n >= 8
""")
def listing_pages(m: Model):
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    anchors = F.transform(words, lambda w: F.concat(F.lit('<li><a href="/x">公告'), w, F.lit("</a> 2024-03-15</li>")))
    made = dealt(m.docs.select("doc_id", "url", "text")).select(F.col("doc_id").alias("id"), "url", F.array_join(anchors, "").alias("html"))
    return extract.listing_pages(made, ZH_TENDER).drop("url")


EXTRACT_SQL = """
    SELECT url, md5(url) AS url_hash, concat(c_mktsegment, '项目', kind) AS title, o_orderdate AS publish_date,
        c_name AS bidder, n_name AS location, o_orderdate + INTERVAL 20 DAY + INTERVAL 570 MINUTE AS bid_end_time,
        concat(o_orderkey, '.5万元') AS amount, (o_orderkey + 0.5::double) * 10000 AS amount_value,
        concat('联系人: 张三丰; 电话: 028-', lpad(cast(o_custkey AS varchar), 7, '0'), '; 邮箱: c', o_custkey, '@mail.example') AS contact,
        CASE o_orderpriority WHEN '1-URGENT' THEN '中标' WHEN '2-HIGH' THEN '变更公告' WHEN '3-MEDIUM' THEN '采购意向'
            WHEN '4-NOT SPECIFIED' THEN '合同' ELSE '招标' END AS notice_type,
        concat_ws(' ', concat(c_mktsegment, '项目', kind, ' - 中国政府采购网 ', c_mktsegment, ' 发布时间：', year(o_orderdate), '年',
            month(o_orderdate), '月', day(o_orderdate), '日。'),
            concat('招标人：', c_name, '，现对本项目进行公开说明，欢迎各单位参加。'),
            '资金来源为财政资金，出资比例为百分之百。',
            concat('预算金额：', o_orderkey, '.5万元。'),
            concat('投标截止时间：', strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d'), ' 09:30。'),
            concat('联系人：张三丰 联系电话：028-', lpad(cast(o_custkey AS varchar), 7, '0'), ' 邮箱 c', o_custkey, '@mail.example。')) AS summary,
        true AS is_relevant, 0.5::double AS relevance_score, '财政资金' AS matched_keywords, cast(NULL AS varchar) AS parse_errors
    FROM m_orders
"""


@query("extract_notices", EXTRACT_SQL)
def extract_notices(m: Model):
    nothing = m.parsed.where("false")
    out = jobs.parse_updates(m.order_pages, nothing, ["财政资金", "绿化"], "all", ZH_TENDER)
    return out.select(
        "url", "url_hash", "title", "publish_date", "bidder", "location", "bid_end_time", "amount", "amount_value",
        "contact", "notice_type", "summary", "is_relevant", "relevance_score", "matched_keywords", "parse_errors",
    )


@query("extract_outcomes", """
    SELECT CASE WHEN length(html) < 50 THEN 'too_short' WHEN length(text) >= 20 AND len(regexp_extract_all(text, '\\p{L}')) >= 30
                THEN 'ok' ELSE 'invalid' END AS action, count(*) AS cnt
    FROM m_doc_text WHERE source_type <> 'search_engine' GROUP BY 1
""")
def extract_outcomes(m: Model):
    empty = m.parsed.where("false")
    return jobs.parse_totals(jobs.parse_updates(m.doc_pages, empty, ["the"], "all", LATIN_TEST))


@query("mojibake_repair", "SELECT o_orderkey AS id, md5(url) AS url_hash, 'fixed' AS action, kind FROM m_orders")
def mojibake_repair(m: Model):
    broken = m.order_pages.withColumn("html", F.decode(F.encode(F.col("html"), "UTF-8"), "ISO-8859-1"))
    fixed = encoding.fix_mojibake(broken)
    return fixed.select(
        F.col("id").cast("bigint").alias("id"), F.md5("url").alias("url_hash"), "action",
        F.regexp_extract("html", "项目(.{4}) - ", 1).alias("kind"),
    )


# Pages in six code pages without a header or meta tag: letters become common characters of a language written in it.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = (
    ("utf-8", LETTERS),
    ("gb18030", "的一是在不了有和人这中大为上个国我以要他时来用们生到"),
    ("big5", "的一是在不了有和人這中大為上個國我以要他時來用們生到"),
    ("shift_jis", "のにはをたがでてとしれさいなるかられすもこよりあまん"),
    ("euc_jp", "のにはをたがでてとしれさいなるかられすもこよりあまん"),
    ("euc_kr", "이다는을에의가고하지한로서도사기리어자은나대부시정인"),
)


@F.pandas_udf(BinaryType())
def in_code_page(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([t.encode(n) for t, n in zip(text, name, strict=True)], dtype="object")


@query("decoded_pages", f"""
    SELECT id, md5(CASE id::BIGINT % 6 WHEN 0 THEN html {" ".join(
        f"WHEN {i} THEN translate(regexp_replace(html, '[^\\x00-\\x7F]', '', 'g'), '{LETTERS}', '{to}')" for i, (_, to) in enumerate(SCRIPTS) if i)} END) AS html_md5
    FROM m_pages
""")
def decoded_pages(m: Model):
    ascii_only = F.regexp_replace("html", r"[^\x00-\x7F]", "")
    i = F.col("id").cast("bigint") % len(SCRIPTS)
    written, name = F.col("html"), F.lit(SCRIPTS[0][0])
    for k, (page, to) in enumerate(SCRIPTS[1:], 1):
        written, name = F.when(i == k, F.translate(ascii_only, LETTERS, to)).otherwise(written), F.when(i == k, F.lit(page)).otherwise(name)
    stored = m.pages.select(
        "id", in_code_page(written, name).alias("body"), F.when(F.col("search_query") == "fr", F.lit("ISO-8859-1")).otherwise(F.lit(None)).alias("charset")
    )
    return encoding.decode_pages(stored).select("id", F.md5("html").alias("html_md5"))


@query("listing_dates", """
    SELECT o_orderkey, o_orderdate AS list_date, o_orderdate AS feed_date FROM orders
""")
def listing_dates(m: Model):
    shown = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "[yyyy-M-d]"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    )
    shown = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("["), F.date_format("o_orderdate", "yyyy-M-d"), F.lit("]"))).otherwise(shown)
    feed = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return m.table("orders").select(
        "o_orderkey", dates.list_date(shown, F.current_timestamp()).alias("list_date"),
        dates.feed_date(feed).alias("feed_date"),
    )


@query("month_windows", """
    SELECT o_custkey, strftime(w, '%Y-%m-%d') AS start_day, strftime(last_day(w), '%Y-%m-%d') AS end_day FROM (
        SELECT o_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS w
        FROM orders GROUP BY o_custkey)
""")
def month_windows(m: Model):
    spans = m.table("orders").groupBy("o_custkey").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("b")
    )
    return spans.select("o_custkey", F.inline(dates.month_windows(F.col("a"), F.col("b"))))


@query("display_times", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m-%d %H:%M:%S') AS shown FROM events")
def display_times(m: Model):
    return m.table("events").select("event_id", dates.to_display_tz(F.col("ts")).alias("shown"))


@query("model_inputs", """
    SELECT id, CASE WHEN title <> '' THEN concat(title, ' [SEP] ', content) ELSE content END AS scored
    FROM m_samples
""")
def model_inputs(m: Model):
    return m.samples.select("id", labelling.model_input(F.col("title"), F.col("content")).alias("scored"))


@query("label_prompts", """
    SELECT id, concat('Keywords: a、b. Query: ', search_query, '. Title: ', coalesce(nullif(title, ''), '无标题'),
        '. Text: ', coalesce(nullif(content, ''), '无内容'), ' {"x": {other}}') AS prompt FROM m_samples
""")
def label_prompts(m: Model):
    template = 'Keywords: {business_keywords}. Query: {search_query}. Title: {title}. Text: {content} {{"x": {other}}}'
    text_col = labelling.labelling_prompt(template, F.col("title"), F.col("content"), F.col("search_query"), ["a", "b"])
    return m.samples.select("id", text_col.alias("prompt"))


@query("label_replies", """
    SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS label, CASE WHEN toxic = 0 THEN concat('r', doc_id) END AS reason FROM labels
""")
def label_replies(m: Model):
    json = F.concat(
        F.lit('{"label": '), F.when(F.col("toxic") == 1, F.lit(7)).otherwise(F.col("quality")).cast("string"),
        F.lit(', "reason": "r'), F.col("doc_id").cast("string"), F.lit('"}'),
    )
    fenced = F.when(F.col("quality") == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return m.table("labels").select("doc_id", labelling.read_reply(fenced).alias("r")).select("doc_id", "r.label", "r.reason")


@query("listing_records", """
    SELECT c_mktsegment AS category, concat('http://base.example/o/', o_orderkey) AS url,
           md5(concat('http://base.example/o/', o_orderkey)) AS url_hash, o_orderpriority AS title, o_orderdate AS publish_date
    FROM m_orders WHERE o_orderpriority <> '2-HIGH'
""")
def listing_records(m: Model):
    record = F.struct(
        F.when(F.col("notice_type") == "1-URGENT", F.lit("")).otherwise(F.col("notice_type")).alias("title"),
        F.col("notice_type").alias("titlenew"),
        F.when(F.col("notice_type") == "2-HIGH", F.lit(" ")).otherwise(F.concat(F.lit("/o/"), F.col("id").cast("string"))).alias("linkurl"),
        F.when(F.col("notice_type") == "5-LOW", F.date_format("publish_date", "yyyy-MM-dd HH:mm:ss")).alias("webdate"),
        F.date_format("publish_date", "yyyy/MM/dd").alias("infodate"),
    )
    body = F.to_json(F.struct(F.struct(F.lit(1).alias("totalcount"), F.array(record).alias("records")).alias("result")))
    feed = m.notices.select(F.col("search_query").alias("category"), body.alias("body"))
    return feeds.listing_records(feed, "http://base.example/").select("category", "url", "url_hash", "title", "publish_date")


@query("portal_records", """
    SELECT concat('http://p.example/a?type=notice&id=', o_orderkey) AS url, o_orderpriority AS title,
           o_orderdate AS publish_date, n_name AS region_name FROM m_orders
""")
def portal_records(m: Model):
    record = F.struct(
        F.col("id").cast("string").alias("id"), F.concat(F.lit(" "), "notice_type").alias("title"),
        F.date_format("publish_date", "yyyy-MM-dd").alias("publishTime"), F.col("location").alias("regionName"),
    )
    body = F.to_json(F.struct(F.lit("200").alias("code"), F.struct(F.array(record).alias("rows")).alias("data")))
    return feeds.portal_records(m.notices.select(body.alias("body")), "http://p.example/a?type=notice&id={id}").select(
        "url", "title", "publish_date", "region_name"
    )


@query("detail_html", """
    SELECT o_orderkey AS id, concat('<html><head><meta charset=''utf-8''><title>', o_orderpriority, '</title></head><body><h1>', o_orderpriority,
        '</h1><p><b>发布时间：</b>', strftime(o_orderdate, '%Y-%m-%d'), '</p><p><b>地区：</b>', n_name, '</p><p><b>采购人：</b>', c_name,
        '</p><div class=''content''><div class=''summary''>', c_mktsegment, '</div></div></body></html>') AS html FROM m_orders
""")
def detail_html(m: Model):
    data = F.struct(
        F.col("notice_type").alias("title"), F.lit("").alias("content"), F.col("search_query").alias("description"),
        F.date_format("publish_date", "yyyy-MM-dd").alias("noticeTime"), F.col("location").alias("regionName"),
        F.col("bidder").alias("purchaser"), F.lit("").alias("budget"),
    )
    body = F.to_json(F.struct(F.lit(200).alias("code"), data.alias("data")))
    details = feeds.detail_records(m.notices.select("id", body.alias("body")))
    return feeds.render_detail_html(details).select("id", "html")


@query("source_config", """
    SELECT id, CASE WHEN s_acctbal > 5000 THEN NULL ELSE 'gov' END AS type,
           CASE WHEN s_acctbal > 5000 THEN 20 ELSE s_nationkey + 1 END AS page_size, 100 AS max_pages_per_category,
           true AS stop_on_all_visited FROM m_sources
""")
def source_config(m: Model):
    return source_registry.source_config(m.sources).select(
        "id", "settings.type", "settings.page_size", "settings.max_pages_per_category", "settings.stop_on_all_visited"
    )


@query("source_windows", """
    SELECT id, concat('c', s_nationkey) AS category_num, strftime(w, '%Y-%m-%d') AS start_day, strftime(last_day(w), '%Y-%m-%d') AS end_day
    FROM (SELECT id, s_nationkey, unnest(generate_series(make_date(2024, (s_nationkey % 6) + 1, 1), DATE '2024-06-01', INTERVAL 1 MONTH)) AS w
          FROM m_sources WHERE s_acctbal <= 5000)
""")
def source_windows(m: Model):
    return source_registry.source_windows(m.sources, F.current_timestamp()).select(
        "id", "category_num", "start_day", "end_day"
    )


@query("sync_sources", """
    SELECT coalesce(s.name, d.name) AS name, coalesce(d.base_url, s.base_url) AS base_url,
        coalesce(s.max_pages, d.max_pages) AS max_pages,
        CASE WHEN s.name IS NULL THEN 'created' WHEN d.name IS NULL THEN 'kept' WHEN s.base_url <> d.base_url THEN 'updated' ELSE 'unchanged' END AS action
    FROM m_sources s FULL OUTER JOIN (
        SELECT name, base_url || '/new' AS base_url, 99 AS max_pages FROM m_sources WHERE s_acctbal > 5000
        UNION ALL SELECT name, base_url, 99 FROM m_sources WHERE s_acctbal < 2000
        UNION ALL SELECT n_name, concat('http://', n_name), 99 FROM nation) d ON s.name = d.name
""")
def sync_sources(m: Model):
    changed = m.sources.where("config = 'no json'").selectExpr("name", "concat(base_url, '/new') AS base_url", "99 AS max_pages")
    same = m.sources.where("source_category = 'search_engine'").selectExpr("name", "base_url", "99 AS max_pages")
    new = m.table("nation").selectExpr("n_name AS name", "concat('http://', n_name) AS base_url", "99 AS max_pages")
    defaults = changed.unionByName(same).unionByName(new)
    return source_registry.sync_sources(m.sources, defaults).select("name", "base_url", "max_pages", "action")

