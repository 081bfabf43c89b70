"""Searches by the gram index against scans."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import merge as M
from noticeworks.operators import search as S
from noticeworks.sources.gramindex import GramIndex
from noticeworks.sources.runs import RunTable

AS_OF = dt(2024, 6, 1)


def notices(spark, texts):
    rows = spark.createDataFrame([(i, f"u{i}", t, s, q) for i, (t, s, q) in enumerate(texts)], "id bigint, url string, title string, summary string, search_query string")
    rows = rows.withColumns({"url_hash": F.md5("url"), "is_relevant": F.lit(True)})
    return spark.createDataFrame([], schemas.PARSED_RESULTS).unionByName(rows, allowMissingColumns=True)


def test_same_rows_as_the_scan(spark, tmp_path):
    regions = spark.createDataFrame([], schemas.SEARCH_REGIONS)
    texts = [(f"道路工程{i}", f"summary {i * 7919 % 1000} text", "q") for i in range(300)] + [(None, None, "桥梁采购"), ("桥", None, None), ("梁采", "x\0y", "购桥"), ("", "", "")]
    base = notices(spark, texts)
    table = RunTable(spark, str(tmp_path), schemas.PARSED_RESULTS, buckets=16)
    index = GramIndex(table)
    table.create(base)
    assert len(index.update()) == 1 and index.update() == []
    stored = table.read()
    for word in ("道路", "工程29", "y 919 t", "桥梁", "桥", "采购", "none of them", "梁采购", "mary 7", "q"):
        got, want = (sorted(r.id for r in df.collect()) for df in (S.search_indexed(index, regions, S.SearchParams(keyword=f" {word}"), AS_OF), S.search_notices(stored, regions, S.SearchParams(keyword=word), AS_OF)))
        assert got == want, word
    assert S.search_indexed(index, regions, S.SearchParams(), AS_OF).count() == len(texts)


def test_rare_words_read_few_files_and_merges_keep_the_index(spark, tmp_path):
    base = notices(spark, [(f"common text number {i}", None, None) for i in range(400)] + [("zebra crossing", None, None)])
    table = RunTable(spark, str(tmp_path), schemas.PARSED_RESULTS, buckets=16)
    index = GramIndex(table)
    table.create(base)
    index.update()
    assert len(index.rows_with("zebra").inputFiles()) == 1 and len(index.rows_with("common").inputFiles()) == 16
    one = base.where("title = 'zebra crossing'").withColumn("title", F.lit("walrus"))
    touched = table.merge(one, lambda a, b: M.upsert(a, b, "url_hash", ["id"], ["title"]))
    new = index.update()
    assert len(touched) == len(new) == 1
    assert index.rows_with("zebra").count() == 0 and [r.title for r in index.rows_with("walrus").where("contains(title, 'walrus')").collect()] == ["walrus"]
    assert len(index.rows_with("walrus").inputFiles()) == 1
    for i in range(12):  # runs that no manifest names any more lose their postings
        table.merge(one.withColumn("title", F.lit(f"walrus {i}")), lambda a, b: M.upsert(a, b, "url_hash", ["id"], ["title"]))
    index.update()
    assert index._names() == {r.folder for r in table.runs()} and index.rows_with("walrus 11").where("title = 'walrus 11'").count() == 1


def test_no_table_yet(spark, tmp_path):
    index = GramIndex(RunTable(spark, str(tmp_path / "x"), schemas.PARSED_RESULTS, buckets=4))
    assert index.update() == [] and index.rows_with("abc").collect() == []
