"""Model tables derived from the driver tables: once as DataFrames, once as SQL.

Every derivation maps whole tables row by row; what a row becomes follows from
its own values (language, label, order status, ...).
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.sources.tables import spread

AS_OF = datetime(2001, 6, 1, 12, 0, 0)


class Model:
    """Model tables as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "cast(page_id AS string) AS id", "url", "html",
            "timestamp'2024-01-01' + make_dt_interval(0, cast(page_id AS int)) AS crawled_at",
            "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS search_query",
            "regexp_extract(url, '^https?://([^/?#]*)', 1) AS source_name",
            "named_struct('title', '', 'source_type', "
            "  if(contains(url, 'utm_source'), 'search_engine', 'website')) AS meta",
        )

    @cached_property
    def page_log(self) -> DataFrame:
        """Crawl log with many crawls per URL; failed crawls have no time."""
        return self.table("events").selectExpr(
            "cast(event_id AS string) AS id", "concat('http://u', user_id, '.example/') AS url",
            "props AS html", "if(event_type = 'error', cast(null AS timestamp), ts) AS crawled_at",
            "event_type AS search_query", "concat('u', user_id) AS source_name",
            "named_struct('title', event_type, 'source_type', 'website') AS meta",
        )

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents")).selectExpr(
            "doc_id", "text", "lang", "source", "n_chars",
            "concat('http://', source, '.example/', lang, '/', doc_id) AS url",
            "split(text, '\n')[0] AS first_line",
            "if(lang = 'es', cast(null AS timestamp), timestamp'2024-01-01' + make_dt_interval(0, 0, cast(n_chars AS int))) AS published",
            "timestamp'2024-01-01' + make_dt_interval(0, cast(doc_id AS int)) AS seen_at",
        )

    @cached_property
    def results(self) -> DataFrame:
        return self.docs.where("lang <> 'de'").selectExpr(
            "doc_id AS id", "first_line AS title", "url", "md5(url) AS url_hash",
            "concat(source, '.example') AS domain", "lang AS source_type", "source AS source_name",
            "concat(lang, ' ', source) AS search_query",
            "cast(substr(source, 4) AS bigint) + 100 AS region_id", "published AS publish_date",
            "cast(doc_id AS string) AS mongo_doc_id", "false AS parsed", "seen_at AS created_at",
            "seen_at AS updated_at",
        )

    @cached_property
    def parsed(self) -> DataFrame:
        return self.docs.join(self.table("labels"), "doc_id").selectExpr(
            "doc_id AS id", "url", "md5(url) AS url_hash", "cast(doc_id AS string) AS mongo_doc_id",
            "first_line AS title", "text AS summary", "published AS publish_date", "source AS bidder",
            "if(lang = 'en', concat('NATION_', substr(source, 4)), if(lang = 'fr', 'elsewhere', '')) AS location",
            "cast(null AS timestamp) AS bid_start_time", "published + interval 30 days AS bid_end_time",
            "concat(n_chars, '元') AS amount", "cast(n_chars AS double) AS amount_value",
            "cast(null AS string) AS contact", "concat(lang, ' ', source) AS search_query",
            "source AS source_name", "if(toxic = 1, null, quality = 1) AS is_relevant",
            "cast(quality AS double) AS relevance_score",
            "CASE WHEN toxic = 1 THEN 'search_serp' WHEN quality = 1 THEN source END AS notice_type",
            "'' AS matched_keywords", "'rule_v1' AS parser_version",
            "CASE WHEN toxic = 1 THEN 'search_serp: page' "
            "WHEN quality = 0 AND lang <> 'en' THEN concat('content_invalid: ', source) END AS parse_errors",
            "seen_at + interval 1 day AS created_at", "seen_at + interval 1 day AS updated_at",
            "'system' AS created_by", "cast(null AS string) AS updated_by",
        )

    @cached_property
    def doc_pages(self) -> DataFrame:
        return self.docs.selectExpr(
            "cast(doc_id AS string) AS id", "url",
            "concat('<html><body><p>', text, '</p></body></html>') AS html", "seen_at AS crawled_at",
            "concat(lang, ' ', source) AS search_query", "source AS source_name",
            "named_struct('title', if(lang = 'fr', '', first_line), 'source_type', if(lang = 'es', 'search_engine', 'website')) AS meta",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.docs.join(self.table("labels"), "doc_id", "left").selectExpr(
            "doc_id AS id", "doc_id AS parsed_id", "url", "md5(url) AS url_hash", "first_line AS title",
            "text AS content", "concat(lang, ' ', source) AS search_query", "source AS source_name",
            "quality AS label",
            "CASE WHEN toxic = 1 THEN 'ai' WHEN quality IS NOT NULL THEN 'admin' END AS labeled_by",
            "if(quality IS NULL, null, seen_at) AS labeled_at", "seen_at AS created_at",
        )

    @cached_property
    def keywords(self) -> DataFrame:
        words = self.table("benchmark").selectExpr(
            "item_id", "lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS keyword"
        )
        return words.where("keyword <> ''").groupBy("keyword").agg(F.min("item_id").alias("id")).selectExpr(
            "id", "keyword", "true AS enabled"
        )

    @cached_property
    def suffixes(self) -> DataFrame:
        return self.table("part").groupBy("p_type").agg(F.min("p_partkey").alias("id")).selectExpr(
            "id", "p_type AS suffix", "p_type <> 'SMALL' AS enabled"
        )

    @cached_property
    def regions(self) -> DataFrame:
        province = self.table("region").selectExpr(
            "cast(1 + r_regionkey AS bigint) AS id", "r_name AS name", "cast(r_regionkey AS string) AS code",
            "'province' AS level", "cast(null AS bigint) AS parent_id", "r_name <> 'ASIA' AS enabled",
        )
        district = self.table("nation").selectExpr(
            "cast(100 + n_nationkey AS bigint) AS id", "n_name AS name", "cast(n_nationkey AS string) AS code",
            "'district' AS level", "cast(1 + n_regionkey AS bigint) AS parent_id", "n_name NOT LIKE '%_1' AS enabled",
        )
        street = self.table("supplier").selectExpr(
            "1000 + s_suppkey AS id", "s_name AS name", "cast(s_suppkey AS string) AS code", "'street' AS level",
            "cast(100 + s_nationkey AS bigint) AS parent_id", "s_acctbal > 0 AS enabled",
        )
        village = self.table("customer").selectExpr(
            "1000000000 + c_custkey AS id", "c_name AS name", "cast(c_custkey AS string) AS code",
            "'village' AS level", "cast(100 + c_nationkey AS bigint) AS parent_id", "c_acctbal > 0 AS enabled",
        )
        return province.unionByName(district).unionByName(street).unionByName(village)

    @cached_property
    def sources(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS id", "s_name AS name",
            "if(s_acctbal < 2000, 'search_engine', 'website') AS source_category",
            "concat('http://s', s_suppkey, '.example') AS base_url",
            "if(s_acctbal < 2000, 'http://s.example/?q={keyword}&p={page}', null) AS search_url_template",
            "1.0D AS rate_limit", "s_nationkey AS max_pages", "3 AS max_depth", "s_acctbal > -500 AS enabled",
            "cast(null AS string) AS notes",
            "if(s_acctbal > 5000, 'no json', concat('{\"type\":\"gov\",\"page_size\":', s_nationkey + 1, "
            "',\"time_partition\":\"month\",\"start_date\":\"2024-0', s_nationkey % 6 + 1, '\",\"end_date\":\"2024-06\",', "
            "'\"categories\":[{\"num\":\"c', s_nationkey, '\",\"name\":\"n\"}]}')) AS config",
        )

    @cached_property
    def channels(self) -> DataFrame:
        return self.table("region").selectExpr(
            "cast(r_regionkey AS bigint) AS id", "r_name AS name", "'sms' AS channel_type",
            "if(r_name = 'AFRICA', '{broken', concat('{\"to\":\"', r_name, '\"}')) AS config", "r_name <> 'EUROPE' AS enabled",
        )

    @cached_property
    def notices(self) -> DataFrame:
        """One notice per order, placed in the nation of the customer."""
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr(
                "o_orderkey AS id", "concat('http://orders.example/', o_orderkey) AS url",
                "md5(concat('http://orders.example/', o_orderkey)) AS url_hash",
                "cast(o_orderkey AS string) AS mongo_doc_id", "concat(c_mktsegment, ' ', o_orderpriority) AS title",
                "concat('order of ', c_name) AS summary", "o_orderdate AS publish_date", "c_name AS bidder",
                "n_name AS location", "cast(null AS timestamp) AS bid_start_time",
                "o_orderdate + interval 20 days AS bid_end_time", "concat(o_orderkey, '元') AS amount",
                "o_totalprice AS amount_value", "cast(null AS string) AS contact", "c_mktsegment AS search_query",
                "'orders' AS source_name",
                "CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS is_relevant",
                "cast(null AS double) AS relevance_score", "o_orderpriority AS notice_type",
                "'' AS matched_keywords", "'rule_v1' AS parser_version", "cast(null AS string) AS parse_errors",
                "o_orderdate AS created_at", "o_orderdate AS updated_at", "'system' AS created_by",
                "cast(null AS string) AS updated_by", "cast(n_regionkey AS bigint) AS home_channel",
            )
        )

    @cached_property
    def outbox(self) -> DataFrame:
        """One message per order, in the channel of its region."""
        return self.notices.selectExpr(
            "id", "home_channel AS channel_id", "id AS parsed_id", "url_hash",
            "CASE notice_type WHEN '1-URGENT' THEN 'sent' WHEN '2-HIGH' THEN 'failed' "
            "WHEN '5-LOW' THEN 'pending' ELSE 'skipped' END AS status",
            "title", "url", "notice_type", "publish_date", "concat(title, '\n\n', summary) AS content",
            "if(notice_type = '2-HIGH', 'refused', null) AS error_msg",
            "CASE notice_type WHEN '3-MEDIUM' THEN 'manual' WHEN '4-NOT SPECIFIED' THEN 'date' END AS skip_reason",
            "cast(null AS string) AS matched_region",
            "if(notice_type = '1-URGENT', publish_date, null) AS sent_at", "publish_date AS created_at",
        )

    @cached_property
    def order_pages(self) -> DataFrame:
        """A Chinese notice page per order."""
        return (
            spread(self.table("orders"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr(
                "cast(o_orderkey AS string) AS id", "concat('http://orders.example/', o_orderkey) AS url",
                "concat('<html><head><title>', c_mktsegment, '项目', " + KIND + ", ' - 中国政府采购网</title>',"
                "'<script>var a = 1;</script></head><body><h1>', c_mktsegment, '</h1><!-- x -->',"
                "'<p>发布时间：', date_format(o_orderdate, 'yyyy年M月d日'), '。</p>',"
                "'<p>招标人：', c_name, '，现对本项目进行公开说明，欢迎各单位参加。</p>',"
                "'<p>项目地点：', n_name, '；资金来源为财政资金，出资比例为百分之百。</p>',"
                "'<p>预算金额：', cast(o_orderkey AS string), '.5万元。投标截止时间：',"
                "date_format(o_orderdate + interval 20 days, 'yyyy-MM-dd'), ' 09:30。</p>',"
                "'<p>联系人：张三丰 联系电话：028-', lpad(cast(o_custkey AS string), 7, '0'), ' 邮箱 c', o_custkey, '@mail.example。</p>',"
                "'</body></html>') AS html",
                "o_orderdate AS crawled_at", "c_mktsegment AS search_query", "'orders' AS source_name",
                "named_struct('title', '', 'source_type', 'website') AS meta",
            )
        )

    @cached_property
    def visits(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id", "concat('http://u', user_id, '.example/') AS url",
            "md5(concat('http://u', user_id, '.example/')) AS url_hash", "event_type AS search_query",
            "if(event_type = 'error', 599, 200) AS status", "ts AS visited_at", "event_type",
        )


KIND = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN '中标公告' WHEN '2-HIGH' THEN '变更公告' "
    "WHEN '3-MEDIUM' THEN '采购意向' WHEN '4-NOT SPECIFIED' THEN '合同公告' ELSE '招标公告' END"
)

NULL_TS = "cast(null AS timestamp)"

# The same tables for the checking engine.
SQL_TABLES = {
    "m_pages": """
        SELECT cast(page_id AS varchar) AS id, url, html,
               TIMESTAMP '2024-01-01' + to_hours(page_id) AS crawled_at,
               regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS search_query,
               regexp_extract(url, '^https?://([^/?#]*)', 1) AS source_name,
               CASE WHEN contains(url, 'utm_source') THEN 'search_engine' ELSE 'website' END AS source_type
        FROM pages""",
    "m_page_log": """
        SELECT cast(event_id AS varchar) AS id, concat('http://u', user_id, '.example/') AS url, props AS html,
               CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS crawled_at,
               event_type AS search_query, concat('u', user_id) AS source_name
        FROM events""",
    "m_docs": """
        SELECT doc_id, text, lang, source, n_chars,
               concat('http://', source, '.example/', lang, '/', doc_id) AS url,
               string_split(text, chr(10))[1] AS first_line,
               CASE WHEN lang <> 'es' THEN TIMESTAMP '2024-01-01' + to_minutes(n_chars) END AS published,
               TIMESTAMP '2024-01-01' + to_hours(doc_id) AS seen_at
        FROM documents""",
    "m_results": """
        SELECT doc_id AS id, first_line AS title, url, md5(url) AS url_hash, concat(source, '.example') AS domain,
               lang AS source_type, source AS source_name, concat(lang, ' ', source) AS search_query,
               cast(substr(source, 4) AS bigint) + 100 AS region_id, published AS publish_date,
               cast(doc_id AS varchar) AS mongo_doc_id, seen_at AS created_at, seen_at AS updated_at
        FROM m_docs WHERE lang <> 'de'""",
    "m_parsed": """
        SELECT doc_id AS id, url, md5(url) AS url_hash, cast(doc_id AS varchar) AS mongo_doc_id,
               first_line AS title, text AS summary, published AS publish_date, source AS bidder,
               CASE lang WHEN 'en' THEN concat('NATION_', substr(source, 4)) WHEN 'fr' THEN 'elsewhere' ELSE '' END AS location,
               published + INTERVAL 30 DAY AS bid_end_time, concat(n_chars, '元') AS amount,
               cast(n_chars AS double) AS amount_value, concat(lang, ' ', source) AS search_query,
               source AS source_name, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS is_relevant,
               cast(quality AS double) AS relevance_score,
               CASE WHEN toxic = 1 THEN 'search_serp' WHEN quality = 1 THEN source END AS notice_type,
               CASE WHEN toxic = 1 THEN 'search_serp: page'
                    WHEN quality = 0 AND lang <> 'en' THEN concat('content_invalid: ', source) END AS parse_errors,
               seen_at + INTERVAL 1 DAY AS created_at
        FROM m_docs JOIN labels USING (doc_id)""",
    "m_doc_pages": """
        SELECT cast(doc_id AS varchar) AS id, url, md5(url) AS url_hash,
               concat('<html><body><p>', text, '</p></body></html>') AS html, seen_at AS crawled_at,
               concat(lang, ' ', source) AS search_query, source AS source_name,
               CASE WHEN lang = 'fr' THEN '' ELSE first_line END AS meta_title,
               CASE WHEN lang = 'es' THEN 'search_engine' ELSE 'website' END AS source_type
        FROM m_docs""",
    "m_samples": """
        SELECT doc_id AS id, url, md5(url) AS url_hash, first_line AS title, text AS content,
               concat(lang, ' ', source) AS search_query, source AS source_name, quality AS label,
               CASE WHEN toxic = 1 THEN 'ai' WHEN quality IS NOT NULL THEN 'admin' END AS labeled_by,
               seen_at AS created_at
        FROM m_docs LEFT JOIN labels USING (doc_id)""",
    "m_keywords": """
        SELECT min(item_id) AS id, keyword FROM (
            SELECT item_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS keyword FROM benchmark)
        WHERE keyword <> '' GROUP BY keyword""",
    "m_suffixes": """
        SELECT min(p_partkey) AS id, p_type AS suffix, p_type <> 'SMALL' AS enabled FROM part GROUP BY p_type""",
    "m_regions": """
        SELECT cast(1 + r_regionkey AS bigint) AS id, r_name AS name, cast(r_regionkey AS varchar) AS code,
               'province' AS level, cast(NULL AS bigint) AS parent_id, r_name <> 'ASIA' AS enabled FROM region
        UNION ALL SELECT 100 + n_nationkey, n_name, cast(n_nationkey AS varchar), 'district', 1 + n_regionkey,
               n_name NOT LIKE '%_1' FROM nation
        UNION ALL SELECT 1000 + s_suppkey, s_name, cast(s_suppkey AS varchar), 'street', 100 + s_nationkey,
               s_acctbal > 0 FROM supplier
        UNION ALL SELECT 1000000000 + c_custkey, c_name, cast(c_custkey AS varchar), 'village', 100 + c_nationkey,
               c_acctbal > 0 FROM customer""",
    "m_sources": """
        SELECT s_suppkey AS id, s_name AS name,
               CASE WHEN s_acctbal < 2000 THEN 'search_engine' ELSE 'website' END AS source_category,
               concat('http://s', s_suppkey, '.example') AS base_url, s_nationkey AS max_pages,
               s_acctbal > -500 AS enabled, s_acctbal, s_nationkey
        FROM supplier""",
    "m_channels": """
        SELECT cast(r_regionkey AS bigint) AS id, r_name AS name, r_name <> 'EUROPE' AS enabled,
               r_name <> 'AFRICA' AS config_ok FROM region""",
    "m_notices": """
        SELECT o_orderkey AS id, concat('http://orders.example/', o_orderkey) AS url,
               md5(concat('http://orders.example/', o_orderkey)) AS url_hash,
               concat(c_mktsegment, ' ', o_orderpriority) AS title, concat('order of ', c_name) AS summary,
               o_orderdate AS publish_date, c_name AS bidder, n_name AS location,
               o_orderdate + INTERVAL 20 DAY AS bid_end_time, concat(o_orderkey, '元') AS amount,
               o_totalprice AS amount_value, c_mktsegment AS search_query,
               CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS is_relevant,
               o_orderpriority AS notice_type, o_orderdate AS created_at, cast(n_regionkey AS bigint) AS home_channel
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "m_outbox": """
        SELECT id, home_channel AS channel_id, id AS parsed_id, url_hash,
               CASE notice_type WHEN '1-URGENT' THEN 'sent' WHEN '2-HIGH' THEN 'failed'
                    WHEN '5-LOW' THEN 'pending' ELSE 'skipped' END AS status,
               title, url, notice_type, publish_date, summary,
               CASE notice_type WHEN '3-MEDIUM' THEN 'manual' WHEN '4-NOT SPECIFIED' THEN 'date' END AS skip_reason,
               cast(NULL AS varchar) AS matched_region, publish_date AS created_at
        FROM m_notices""",
    "m_orders": """
        SELECT o_orderkey, o_custkey, c_mktsegment, c_name, n_name, o_orderdate, o_orderpriority,
               concat('http://orders.example/', o_orderkey) AS url,
               CASE o_orderpriority WHEN '1-URGENT' THEN '中标公告' WHEN '2-HIGH' THEN '变更公告'
                    WHEN '3-MEDIUM' THEN '采购意向' WHEN '4-NOT SPECIFIED' THEN '合同公告' ELSE '招标公告' END AS kind
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "m_visits": """
        SELECT event_id AS id, concat('http://u', user_id, '.example/') AS url,
               md5(concat('http://u', user_id, '.example/')) AS url_hash, event_type AS search_query,
               CASE WHEN event_type = 'error' THEN 599 ELSE 200 END AS status, ts AS visited_at, event_type
        FROM events""",
    # text of a page: the three script-like elements one by one, as there are no backreferences here
    "m_page_text": """
        SELECT id, url, html, trim(regexp_replace(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
                '(?is)<\\s*script[^>]*>.*?</\\s*script\\s*>', ' ', 'g'),
                '(?is)<\\s*style[^>]*>.*?</\\s*style\\s*>', ' ', 'g'),
                '(?is)<\\s*noscript[^>]*>.*?</\\s*noscript\\s*>', ' ', 'g'),
            '<[^>]+>', ' ', 'g'), '[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) AS text
        FROM m_pages""",
    "m_doc_text": """
        SELECT id, url, url_hash, html, meta_title, source_type, search_query, source_name, trim(regexp_replace(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
                '(?is)<\\s*script[^>]*>.*?</\\s*script\\s*>', ' ', 'g'),
                '(?is)<\\s*style[^>]*>.*?</\\s*style\\s*>', ' ', 'g'),
                '(?is)<\\s*noscript[^>]*>.*?</\\s*noscript\\s*>', ' ', 'g'),
            '<[^>]+>', ' ', 'g'), '[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) AS text
        FROM m_doc_pages""",
}


def with_tables(sql: str) -> str:
    """Put the model tables a query names in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL_TABLES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL_TABLES[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql.strip()
    tables = ", ".join(f"{n} AS ({SQL_TABLES[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {tables}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {tables}, {body[5:]}"
    return f"WITH {tables} {body}"
