"""Schemas of the model tables."""

from __future__ import annotations

RAW_PAGES = """
    id string, url string, html string, content_hash string, crawled_at timestamp,
    search_query string, source_name string,
    meta struct<title: string, source_type: string, extra: map<string, string>>
"""

#: Pages with the fields that this schema does not know, as one object.
PAGE_DOCUMENTS = f"{RAW_PAGES.strip()}, rest variant"

SEARCH_RESULTS = """
    id bigint, title string, url string, url_hash string, domain string, source_type string,
    source_name string, search_query string, region_id bigint, publish_date timestamp,
    mongo_doc_id string, parsed boolean, created_at timestamp, updated_at timestamp
"""

PARSED_RESULTS = """
    id bigint, url string, url_hash string, mongo_doc_id string, title string, summary string,
    publish_date timestamp, bidder string, location string, bid_start_time timestamp,
    bid_end_time timestamp, amount string, amount_value double, contact string,
    search_query string, source_name string, is_relevant boolean, relevance_score double,
    notice_type string, matched_keywords string, parser_version string, parse_errors string,
    created_at timestamp, updated_at timestamp, created_by string, updated_by string
"""

VISITED_URLS = """
    id bigint, url string, url_hash string, search_query string, status int, visited_at timestamp
"""

SEARCH_REGIONS = "id bigint, name string, code string, level string, parent_id bigint, enabled boolean"

SEARCH_KEYWORDS = "id bigint, keyword string, enabled boolean"

SEARCH_SUFFIXES = "id bigint, suffix string, enabled boolean"

CRAWL_SOURCES = """
    id bigint, name string, source_category string, base_url string, search_url_template string,
    rate_limit double, max_pages int, max_depth int, enabled boolean, notes string, config string
"""

LABELED_SAMPLES = """
    id bigint, parsed_id bigint, url string, url_hash string, title string, content string,
    search_query string, source_name string, label int, labeled_by string, labeled_at timestamp,
    created_at timestamp
"""

NOTIFY_CHANNELS = "id bigint, name string, channel_type string, config string, enabled boolean"

NOTIFY_MESSAGES = """
    id bigint, channel_id bigint, parsed_id bigint, url_hash string, status string, title string,
    url string, notice_type string, publish_date timestamp, content string, error_msg string,
    skip_reason string, matched_region string, sent_at timestamp, created_at timestamp
"""

LISTING_FEED = """
    result struct<totalcount: bigint, records: array<struct<
        title: string, titlenew: string, linkurl: string, webdate: string,
        infodate: string, zhuanzai: string>>>
"""

PORTAL_FEED = """
    code string, data struct<total: bigint, `rows`: array<struct<
        id: string, title: string, noticeTime: string, publishTime: string,
        regionName: string, noticeTypeName: string>>>
"""

DETAIL_RECORD = """
    title string, content string, description string, noticeTime string, author string,
    regionName string, noticeTypeName string, openTenderCode string, budget string,
    successfulMoney string, purchaser string, agency string, contactPerson string,
    contactNumber string, bidCompany string
"""

REGION_TREE = """
    name string, code string, children array<struct<
        name: string, code: string, children: array<struct<name: string, code: string>>>>
"""
