"""Searches, filters, ordering, regions."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from driver_checks.model import AS_OF, Model
from driver_checks.registry import query
from noticeworks import schemas
from noticeworks.functions import lists, urls
from noticeworks.functions.matching import with_name_hits
from noticeworks.operators import paging as P
from noticeworks.operators import regions as R
from noticeworks.operators import search as S
from noticeworks.session import shared_folder
from noticeworks.sources.gramindex import GramIndex
from noticeworks.sources.runs import RunTable

# names below the province, with and without suffix (none of the names has one)
NAMES = "(SELECT name FROM m_regions WHERE level <> 'province' AND length(name) >= 2)"
PLACED = f"(coalesce(location, '') = '' OR EXISTS (SELECT 1 FROM {NAMES} n WHERE contains(location, n.name)))"
SEARCH_PARAMS = S.SearchParams(keyword="the")
FOUND = f"""
    SELECT * FROM m_parsed WHERE is_relevant <> false
      AND (contains(title, 'the') OR contains(summary, 'the') OR contains(search_query, 'the')) AND {PLACED}
"""
DOC_TIME = datetime(2024, 1, 8, 6, 0, 0)


@query("search_notices", f"SELECT id, title FROM ({FOUND})")
def search_notices(m: Model):
    return S.search_notices(m.parsed, m.regions, SEARCH_PARAMS, DOC_TIME).select("id", "title")


@query("search_page", f"SELECT id, publish_date FROM ({FOUND}) ORDER BY publish_date DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 20")
def search_page(m: Model):
    found = S.search_notices(m.parsed, m.regions, SEARCH_PARAMS, DOC_TIME)
    return S.page_of(found, S.newest_first(), page=2).select("id", "publish_date")


@query("search_page_after", f"""
    SELECT id, publish_date FROM ({FOUND}) WHERE publish_date < TIMESTAMP '2024-03-01' OR (publish_date = TIMESTAMP '2024-03-01' AND id < 500)
    ORDER BY publish_date DESC NULLS FIRST, id DESC LIMIT 20
""")
def search_page_after(m: Model):
    found = S.search_notices(m.parsed, m.regions, SEARCH_PARAMS, DOC_TIME)
    return S.page_after(found, "publish_date", (datetime(2024, 3, 1), 500)).select("id", "publish_date")


@query("search_page_deep", """
    SELECT id, publish_date FROM m_notices ORDER BY publish_date DESC NULLS FIRST, id DESC LIMIT 20 OFFSET (SELECT (count(*) // 20 - 2) * 20 FROM m_notices)
""")
def search_page_deep(m: Model):
    """The third page from the end, found by counting ranges of dates."""
    pages = S.page_count(m.notices).first().total // 20
    return P.deep_page(m.notices.select("id", "publish_date"), P.newest_keys(), page=pages - 1, rows=500, ranges=64)


@query("search_indexed", f"""
    SELECT 'the' AS keyword, id FROM ({FOUND}) UNION ALL
    SELECT k.keyword, p.id FROM m_parsed p, (SELECT DISTINCT substr(summary, 200, 9) AS keyword FROM m_parsed WHERE id % 97 = 5 AND length(summary) > 300) k
    WHERE is_relevant <> false AND {PLACED} AND (contains(title, k.keyword) OR contains(summary, k.keyword) OR contains(search_query, k.keyword))
""")
def search_indexed(m: Model):
    """A frequent word and rare passages, from a stored table whose index followed a merge."""
    table = RunTable(m.spark, f"{shared_folder(m.spark)}/notices-{uuid.uuid4().hex}", schemas.PARSED_RESULTS, buckets=32)
    index = GramIndex(table)
    table.create(m.parsed.withColumn("summary", F.when(F.col("id") % 5 > 0, F.col("summary")).otherwise(F.lit("to come"))))
    index.update()
    late = m.parsed.where("id % 5 = 0")
    table.merge(late, lambda stored, news: stored.join(news.select("url_hash"), "url_hash", "left_anti").unionByName(news.select(*stored.columns)))
    index.update()
    rare = m.parsed.where("id % 97 = 5 AND length(summary) > 300").select(F.substring("summary", 200, 9).alias("keyword")).distinct()
    words = rare.unionByName(m.spark.createDataFrame([("the",)], "keyword string"))
    return S.search_indexed(index, m.regions, S.SearchParams(), DOC_TIME, words).select("keyword", "id")


@query("search_page_count", f"SELECT count(*) AS total, greatest(ceil(count(*) / 20), 1)::bigint AS total_pages FROM ({FOUND})")
def search_page_count(m: Model):
    return S.page_count(S.search_notices(m.parsed, m.regions, SEARCH_PARAMS, DOC_TIME))


@query("search_dates", """
    SELECT 'today' AS date_range, id FROM m_notices WHERE is_relevant <> false AND publish_date >= TIMESTAMP '2001-05-31 16:00:00'
    UNION ALL SELECT '3d', id FROM m_notices WHERE is_relevant <> false AND publish_date >= TIMESTAMP '2001-05-29 12:00:00'
    UNION ALL SELECT '7d', id FROM m_notices WHERE is_relevant <> false AND publish_date >= TIMESTAMP '2001-05-25 12:00:00'
    UNION ALL SELECT '30d', id FROM m_notices WHERE is_relevant <> false AND publish_date >= TIMESTAMP '2001-05-02 12:00:00'
    UNION ALL SELECT 'custom', id FROM m_notices WHERE is_relevant <> false AND publish_date <= TIMESTAMP '1997-03-04 23:59:59'
""")
def search_dates(m: Model):
    out = None
    for name in ("today", "3d", "7d", "30d", "custom"):
        params = S.SearchParams(date_range=name, date_from="no date", date_to="1997-03-04")
        rows = S.search_notices(m.notices, m.regions, params, AS_OF).select(F.lit(name).alias("date_range"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("search_region_type", """
    SELECT id FROM m_notices WHERE is_relevant <> false AND notice_type = '1-URGENT'
      AND (contains(location, 'NATION_2') OR contains(search_query, 'NATION_2'))
""")
def search_region_type(m: Model):
    params = S.SearchParams(region="NATION_2", notice_type="1-URGENT")
    return S.search_notices(m.notices, m.regions, params, AS_OF).select("id")


@query("region_filter", f"SELECT id FROM m_parsed WHERE {PLACED}")
def region_filter(m: Model):
    return S.filter_by_region(m.parsed, R.region_name_set(m.regions)).select("id")


@query("region_filter_join", f"SELECT id FROM m_parsed WHERE {PLACED}")
def region_filter_join(m: Model):
    return S.filter_by_region(m.parsed, R.region_name_set(m.regions), limit=0).select("id")


@query("results_api", """
    SELECT r.id, r.title, r.url, r.source_type, g.name AS region, r.publish_date, r.created_at
    FROM m_results r LEFT JOIN m_regions g ON r.region_id = g.id
    WHERE contains(r.title, 'the') AND r.source_type = 'en' ORDER BY r.created_at DESC NULLS FIRST, r.id DESC LIMIT 20
""")
def results_api(m: Model):
    return S.search_results_api(m.results, m.regions, keyword="the", source_type="en")


@query("browse_results", """
    SELECT id FROM m_results WHERE contains(domain, 'src1') AND contains(title, 'e') AND contains(search_query, 'en') AND contains(url, '/en/')
""")
def browse_results(m: Model):
    return S.browse_results(m.results, domain="src1", title="e", query="en", url="/en/").select("id")


@query("browse_parsed", """
    SELECT id FROM m_parsed WHERE contains(location, 'NATION') AND contains(bidder, 'src') AND is_relevant AND parse_errors IS NULL
""")
def browse_parsed(m: Model):
    return S.browse_parsed(m.parsed, bidder="src", location="NATION", relevant="yes", status="parsed").select("id")


@query("browse_parsed_sorted", """
    SELECT id, amount_value FROM m_parsed ORDER BY amount_value ASC NULLS LAST, id LIMIT 20 OFFSET 40
""")
def browse_parsed_sorted(m: Model):
    order = S.sorted_by("amount_value", "asc", S.PARSED_SORTS)
    return S.page_of(S.browse_parsed(m.parsed), order, page=3).select("id", "amount_value")


@query("browse_messages", """
    SELECT o.id, c.name AS channel FROM m_outbox o LEFT JOIN m_channels c ON o.channel_id = c.id
    WHERE status = 'pending' AND created_at >= TIMESTAMP '2001-06-01 12:00:00' - INTERVAL 400 DAY AND contains(title, 'MACHINERY')
""")
def browse_messages(m: Model):
    found = S.browse_messages(m.outbox, m.channels, AS_OF, status="pending", days=400, title="MACHINERY")
    return found.select("id", "channel")


@query("browse_samples", """
    SELECT id FROM m_samples WHERE label IS NULL AND contains(search_query, 'en')
    ORDER BY label DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC LIMIT 50
""")
def browse_samples(m: Model):
    found = S.browse_samples(m.samples, label="unlabeled", query="en")
    return S.page_of(found, S.sample_order(), per_page=50).select("id")


@query("sample_two_key_order", """
    SELECT id, label FROM m_samples ORDER BY label DESC NULLS FIRST, created_at DESC NULLS FIRST, id DESC LIMIT 500 OFFSET 500
""")
def sample_two_key_order(m: Model):
    return S.page_of(S.browse_samples(m.samples), S.sample_order(), page=2, per_page=500).select("id", "label")


@query("latest_rows", "SELECT id FROM m_outbox ORDER BY id DESC LIMIT 50")
def latest_rows(m: Model):
    return S.latest(m.outbox, "id", 50).select("id")


@query("region_names", f"SELECT DISTINCT name FROM {NAMES}")
def region_names(m: Model):
    return R.region_name_set(m.regions)


PATHS = """
    WITH RECURSIVE tree AS (
        SELECT id, name, level, name AS path, enabled AS reachable, cast(NULL AS bigint) AS district_id FROM m_regions WHERE parent_id IS NULL
        UNION ALL
        SELECT r.id, r.name, r.level, concat(t.path, ' > ', r.name), r.enabled AND t.reachable,
               coalesce(t.district_id, CASE WHEN r.level = 'district' THEN r.id END)
        FROM m_regions r JOIN tree t ON r.parent_id = t.id)
"""


@query("region_paths", PATHS + """
    SELECT tree.id, path, CASE WHEN tree.level IN ('street', 'village') THEN concat(p.name, ' ', tree.name) ELSE tree.name END AS search_name
    FROM tree LEFT JOIN m_regions r ON tree.id = r.id LEFT JOIN m_regions p ON r.parent_id = p.id
""")
def region_paths(m: Model):
    return R.region_paths(m.regions).select("id", "path", "search_name")


@query("district_subtrees", PATHS + """
    SELECT district_id, id, CASE level WHEN 'district' THEN '区/县' WHEN 'street' THEN '街道' ELSE '村' END AS level_label
    FROM tree WHERE reachable AND district_id IS NOT NULL
""")
def district_subtrees(m: Model):
    return R.district_subtrees(m.regions).select("district_id", "id", "level_label")


@query("region_children", """
    SELECT r.id, count(c.id) AS child_count FROM m_regions r LEFT JOIN m_regions c ON c.parent_id = r.id GROUP BY r.id
""")
def region_children(m: Model):
    return R.region_children(m.regions).select("id", "child_count")


@query("region_search", PATHS + "SELECT id, path FROM tree WHERE contains(name, 'TION_1')")
def region_search(m: Model):
    return R.region_search(m.regions, "TION_1").select("id", "path")


@query("resolve_region", """
    SELECT n.id, g.id AS region_id FROM m_notices n LEFT JOIN (SELECT name, min(id) AS id FROM m_regions GROUP BY name) g ON n.location = g.name
""")
def resolve_region(m: Model):
    items = m.notices.select("id", F.col("location").alias("region_name"))
    return R.resolve_region(items, m.regions).select("id", "region_id")


@query("region_tree", """
    SELECT s_name AS name, 'province' AS level, cast(NULL AS bigint) AS parent_id, ('0x' || substr(md5(s_name), 1, 15))::bigint AS id FROM supplier
    UNION ALL SELECT n_name, 'city', ('0x' || substr(md5(s_name), 1, 15))::bigint, ('0x' || substr(md5(concat(s_name, '/', n_name)), 1, 15))::bigint
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT LIKE '%_1'
    UNION ALL SELECT concat('d', s_suppkey), 'district', ('0x' || substr(md5(parent), 1, 15))::bigint,
        ('0x' || substr(md5(concat(parent, '/d', s_suppkey)), 1, 15))::bigint
        FROM (SELECT s_suppkey, CASE WHEN n_name LIKE '%_1' THEN s_name ELSE concat(s_name, '/', n_name) END AS parent
              FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
def region_tree(m: Model):
    city = F.when(F.col("n_name").like("%_1"), F.lit(R.PSEUDO_CITY)).otherwise(F.col("n_name"))
    district = F.struct(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("d").alias("code"))
    children = F.array(F.struct(city.alias("name"), F.lit("c").alias("code"), F.array(district).alias("children")))
    tree = m.table("supplier").join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("name"), F.lit("p").alias("code"), children.alias("children")
    )
    return R.flatten_region_tree(tree).select("id", "name", "level", "parent_id")


@query("enabled_rows", "SELECT id, name FROM m_regions WHERE enabled")
def enabled_rows(m: Model):
    return S.enabled_rows(m.regions).select("id", "name")


@query("merge_regions", """
    SELECT name, coalesce(parent_id, -1) AS parent FROM m_regions WHERE level <> 'village'
    UNION ALL SELECT name, coalesce(parent_id, -1) FROM m_regions WHERE level = 'village'
    UNION ALL SELECT concat(name, 'x'), coalesce(parent_id, -1) FROM m_regions WHERE level = 'province'
""")
def merge_regions(m: Model):
    known = m.regions.where("level <> 'village'")
    more = m.regions.where("level = 'province'").withColumn("name", F.concat("name", F.lit("x")))
    incoming = m.regions.unionByName(more)
    return R.merge_regions(known, incoming).select("name", F.coalesce("parent_id", F.lit(-1)).alias("parent"))


@query("enable_regions", "SELECT id, enabled OR (level = 'district' AND name LIKE '%_1') OR name = 'ASIA' AS enabled FROM m_regions")
def enable_regions(m: Model):
    chosen = m.regions.where("(level = 'district' AND name LIKE '%_1') OR name = 'ASIA'")
    return R.enable_regions(m.regions, chosen).select("id", "enabled")


HITS = """
    SELECT t.id, string_agg(n.name, ',' ORDER BY strpos(t.txt, n.name), n.name) AS hits
    FROM (SELECT id, concat(title, ' ', location, ' ', summary) AS txt FROM m_notices) t
    JOIN (SELECT DISTINCT name FROM m_regions WHERE level = 'district' AND enabled) n ON contains(t.txt, n.name) GROUP BY t.id
"""


def region_hits(m: Model, limit: int):
    txt = F.concat_ws(" ", "title", "location", "summary")
    hits = with_name_hits(m.notices, "id", txt, R.district_names(m.regions, True), "hits", limit=limit)
    return hits.where(F.size("hits") > 0).select("id", F.array_join("hits", ",").alias("hits"))


@query("region_match", HITS)
def region_match(m: Model):
    return region_hits(m, 2000)


@query("region_match_join", HITS)
def region_match_join(m: Model):
    return region_hits(m, 0)


@query("region_suffixes", """
    SELECT r.id, CASE right(s, 1) WHEN '市' THEN r.name WHEN '区' THEN r.name ELSE concat(r.name, s) END AS bare
    FROM (SELECT id, name, CASE level WHEN 'district' THEN '市' WHEN 'street' THEN '区' ELSE '省' END AS s FROM m_regions) r
""")
def region_suffixes(m: Model):
    suffix = F.when(F.col("level") == "district", F.lit("市")).when(F.col("level") == "street", F.lit("区")).otherwise(F.lit("省"))
    return m.regions.select("id", lists.strip_region_suffix(F.concat("name", suffix)).alias("bare"))


@query("csv_sets", """
    SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(title, chr(10), ','), ','), lambda x: trim(x, ' ')), lambda x: x <> ''))), '|') AS parts
    FROM m_samples
""")
def csv_sets(m: Model):
    return m.samples.select("id", F.array_join(F.array_sort(lists.csv_set(F.col("title"))), "|").alias("parts"))


@query("filled_templates", "SELECT id, concat('http://x/?q=', name, '&p=', max_pages, '&z={zone}') AS url FROM m_sources")
def filled_templates(m: Model):
    filled = urls.fill_template("http://x/?q={keyword}&p={page}&z={zone}", keyword=F.col("name"), page=F.col("max_pages"))
    return m.sources.select("id", filled.alias("url"))
