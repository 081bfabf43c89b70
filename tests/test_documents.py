"""Pages with fields that the schema does not know."""

import json
import random
from datetime import datetime as dt

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import merge as M
from noticeworks.sources import tables as T
from noticeworks.sources.runs import RunTable
from noticeworks.streaming import jobs as J


def shown(df):
    return {r.url: (r.id, r.html, None if r.rest is None else json.loads(r.rest)) for r in df.select("url", "id", "html", F.to_json("rest").alias("rest")).collect()}


def documents(spark, tmp_path, name, rows):
    path = tmp_path / name
    path.mkdir()
    (path / "pages.json").write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else f"{r}\n" for r in rows))
    return T.read_page_documents(spark, str(path))


def test_read_json_and_parquet(spark, tmp_path):
    rows = [
        {"id": "1", "url": "u", "html": "h", "crawled_at": "2024-01-02 00:00:00", "meta": {"title": "t", "source_type": "website"}, "retries": 3, "proxy": {"host": "p", "tags": [1, 2]}, "none": None},
        {"id": "2", "url": "v", "html": "i"}, "no json", "[1, 2]", "",
    ]
    got = documents(spark, tmp_path, "a", rows)
    assert got.columns == [*spark.createDataFrame([], schemas.RAW_PAGES).columns, "rest"]
    assert shown(got) == {"u": ("1", "h", {"retries": 3, "proxy": {"host": "p", "tags": [1, 2]}}), "v": ("2", "i", None)}
    assert got.where("url = 'u'").first().crawled_at == dt(2024, 1, 2) and got.where("url = 'u'").first().meta.title == "t"
    spark.createDataFrame([("u", "h", 5, ["x"], None)], "url string, html string, depth int, tags array<string>, none string").write.parquet(str(tmp_path / "p"))
    stored = T.read_page_documents(spark, str(tmp_path / "p"), "parquet")
    assert shown(stored) == {"u": (None, "h", {"depth": 5, "tags": ["x"]})}
    plan = stored.select("url", "rest")._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1]


def test_merges_keep_unknown_fields(spark, tmp_path):
    base = documents(spark, tmp_path, "a", [
        {"id": "1", "url": "u", "html": "old", "crawled_at": "2024-01-02 00:00:00", "a": 1, "b": 2}, {"id": "2", "url": "v", "html": "same", "crawled_at": "2024-01-09 00:00:00", "a": 1},
        {"id": "3", "url": "w", "html": "x", "crawled_at": "2024-01-01 00:00:00", "only": "stored"},
    ])
    news = documents(spark, tmp_path, "b", [
        {"id": "9", "url": "u", "html": "mid", "crawled_at": "2024-01-03 00:00:00", "b": 7, "c": 8}, {"id": "8", "url": "u", "html": "new", "crawled_at": "2024-01-04 00:00:00", "c": 9},
        {"id": "7", "url": "v", "html": "late", "crawled_at": "2024-01-01 00:00:00", "z": 1}, {"id": "6", "url": "n", "html": "first", "crawled_at": "2024-01-01 00:00:00", "z": {"k": 1}},
        {"id": "5", "url": "w", "html": "y", "crawled_at": "2024-01-05 00:00:00"},
    ])
    merged = M.merge_raw_pages(base, news)
    want = {"u": ("1", "new", {"a": 1, "b": 7, "c": 9}), "v": ("2", "same", {"a": 1}), "n": ("6", "first", {"z": {"k": 1}}), "w": ("3", "y", {"only": "stored"})}
    assert shown(merged) == want and merged.columns == base.columns
    table = RunTable(spark, str(tmp_path / "t"), schemas.PAGE_DOCUMENTS, "url", 4)
    table.create(base)
    table.merge(news, M.merge_raw_pages)
    assert shown(table.read()) == want
    assert shown(M.dedup_pages(news))["u"] == ("8", "new", {"c": 9})
    assert M.merge_raw_pages(base.drop("rest"), news).columns == base.drop("rest").columns


def test_stream_logs_keep_unknown_fields(spark, tmp_path):
    rng, log, everything = random.Random(3), J.page_log(spark, str(tmp_path / "log"), 2), []
    log.fan = 2
    for batch in range(9):
        rows = []
        for i in range(4):
            extra = {k: f"{batch}-{i}" for k in rng.sample("abcd", rng.randrange(3))}
            rows.append({"id": f"{batch}{i}", "url": f"u{i}", "html": f"h{batch}{i}", "crawled_at": f"2024-01-{rng.randrange(1, 29):02} 00:00:00", **extra})
        log.append(documents(spark, tmp_path, f"b{batch}", rows).coalesce(1), batch)
        log.compact(T.surviving_pages)
        everything += [(r["crawled_at"], batch, r["id"], r) for r in rows]
    want = {}
    for _, _, _, r in sorted(everything, key=lambda x: x[:3]):
        first = min((b, c, i) for c, b, i, o in everything if o["url"] == r["url"])[2]
        old = (want.get(r["url"]) or (None, None, {}))[2]
        want[r["url"]] = first, r["html"], old | {k: v for k, v in r.items() if len(k) == 1}
    assert shown(T.current_pages(log.read())) == want
    assert any(r.level for r in log.runs())
