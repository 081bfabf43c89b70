from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import cleanup
from noticeworks.operators import regions as R
from noticeworks.operators import search as S

AS_OF = dt(2024, 6, 15, 10, 0, 0)


@pytest.fixture
def regions(spark):
    rows = [
        (1, "四川省", None, "province", None, True), (2, "内江市", None, "city", 1, True), (3, "东兴区", None, "district", 2, True),
        (4, "田家镇", None, "town", 3, True), (5, "正子村", None, "village", 4, False), (6, "市中区", None, "district", 2, False),
        (7, "白马镇", None, "town", 6, True), (8, "乐山市", None, "city", 1, False), (9, "市中区", None, "district", 8, True),
        (10, "东区", None, "district", 2, True), (11, "孤儿镇", None, "town", 99, True),
    ]
    return spark.createDataFrame(rows, schemas.SEARCH_REGIONS)


def test_paths_and_search_names(regions):
    out = {r.id: (r.path, r.search_name) for r in R.region_paths(regions).collect()}
    assert out[5] == ("四川省 > 内江市 > 东兴区 > 田家镇 > 正子村", "东兴区 田家镇 正子村")
    assert out[3] == ("四川省 > 内江市 > 东兴区", "东兴区")
    assert out[9][0] == "四川省 > 乐山市 > 市中区" and out[11] == ("孤儿镇", "孤儿镇")


def test_disabled_parent_hides_subtree(regions):
    out = {(r.district_id, r.id) for r in R.district_subtrees(regions).collect()}
    assert out == {(3, 3), (3, 4), (10, 10)}


def test_name_sets(regions):
    names = {r.name for r in R.region_name_set(regions).collect()}
    assert {"东兴区", "东兴", "东区", "内江", "田家"} <= names and "四川省" not in names and "东" not in names
    assert {r.name for r in R.district_names(regions, True).collect()} == {"东兴区", "市中区", "东区"}


def test_children_and_search(regions):
    assert {r.id: r.child_count for r in R.region_children(regions).collect()}[2] == 3
    assert [r.id for r in R.region_search(regions, "市中").collect()] == [6, 9]
    assert R.region_search(regions, "市").count() == 0


def test_merge_enable_delete(spark, regions):
    more = spark.createDataFrame([(50, "市中区", None, "district", 2, True), (51, "市中区", None, "district", 3, True), (52, "四川省", None, "province", None, True), (53, "新省", None, "province", None, True)], schemas.SEARCH_REGIONS)
    merged = R.merge_regions(regions, more)
    assert {r.id for r in merged.collect()} == set(range(1, 12)) | {51, 53}
    assert R.merge_regions(merged, more).count() == merged.count()
    on = spark.createDataFrame([("市中区", 2)], "name string, parent_id bigint")
    assert {r.id for r in R.enable_regions(regions, on).where("enabled").collect()} == {1, 2, 3, 4, 6, 7, 9, 10, 11}
    root = spark.createDataFrame([(2,)], "id bigint")
    assert {r.id for r in cleanup.delete_regions(root, regions).collect()} == {1, 8, 9, 11}


def test_flatten_tree(spark, tmp_path):
    import json

    from noticeworks.sources.tables import read_region_tree

    tree = [
        {"name": "北京市", "code": "11", "children": [{"name": "市辖区", "code": "1101", "children": [{"name": "东城区", "code": "110101"}]}]},
        {"name": "四川省", "code": "51", "children": [{"name": "内江市", "code": "5110", "children": [{"name": "东兴区", "code": "511011"}]}]},
        {"name": "空省", "code": "99", "children": []},
    ]
    (tmp_path / "pca.json").write_text(json.dumps(tree, ensure_ascii=False))
    rows = R.flatten_region_tree(read_region_tree(spark, str(tmp_path / "pca.json"))).collect()
    by_id = {r.id: r for r in rows}
    shown = {(r.name, r.level, by_id[r.parent_id].name if r.parent_id else None) for r in rows}
    assert shown == {
        ("北京市", "province", None), ("东城区", "district", "北京市"), ("四川省", "province", None),
        ("内江市", "city", "四川省"), ("东兴区", "district", "内江市"), ("空省", "province", None),
    }


@pytest.fixture
def notices(spark):
    rows = [
        (1, "道路工程", "s", "东兴区某地", True, dt(2024, 6, 15), "招标", "q"), (2, "t", "含道路", None, True, dt(2024, 6, 12), "中标", "q"),
        (3, "t", "s", "", True, None, "招标", "道路"), (4, "道路", "s", "外省某市", True, dt(2024, 6, 1), None, "q"),
        (5, "道路", "s", "东兴区", None, dt(2024, 6, 15), "招标", "q"), (6, "道路", "s", "东兴区", False, dt(2024, 6, 15), "招标", "q"),
        (7, "桥", "s", "东兴", True, dt(2024, 6, 14, 17), "招标", "内江市"),
    ]
    return spark.createDataFrame(rows, "id bigint, title string, summary string, location string, is_relevant boolean, publish_date timestamp, notice_type string, search_query string")


def found(notices, regions, **params):
    return [r.id for r in S.page_of(S.search_notices(notices, regions, S.SearchParams(**params), AS_OF), S.newest_first()).collect()]


def test_search(notices, regions):
    assert found(notices, regions) == [3, 1, 7, 2]
    assert found(notices, regions, keyword=" 道路 ") == [3, 1, 2]
    assert found(notices, regions, region="内江市") == [7]
    assert found(notices, regions, region="外省") == [4]
    assert found(notices, regions, notice_type="中标") == [2]
    assert found(notices, regions, date_range="today") == [1, 7]
    assert found(notices, regions, date_range="3d") == [1, 7]
    assert found(notices, regions, date_range="custom", date_from="bad", date_to="2024-06-12") == [2]
    assert found(notices, regions, date_range="custom", date_from="2024-06-13", date_to="") == [1, 7]


def test_region_filter_paths_agree(notices, regions):
    names = R.region_name_set(regions)
    a, b = S.filter_by_region(notices, names), S.filter_by_region(notices, names, limit=0)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) == [1, 2, 3, 5, 6, 7]


def test_pages(notices):
    order = S.newest_first()
    pages = [[r.id for r in S.page_of(notices, order, p, 3).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[3, 6, 5], [1, 7, 2], [4], []]
    assert S.page_count(notices, 3).first().asDict() == {"total": 7, "total_pages": 3}
    assert S.page_count(notices.where("false"), 3).first().asDict() == {"total": 0, "total_pages": 1}
    assert [r.id for r in notices.orderBy(*S.sorted_by("title", "asc", ("title",))).collect()][0] == 2
    plan = S.page_of(notices, order, 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_resolve_region_takes_the_oldest(spark, regions):
    items = spark.createDataFrame([("市中区",), ("无",)], "region_name string")
    assert {r.region_name: r.region_id for r in R.resolve_region(items, regions).collect()} == {"市中区": 6, "无": None}


def test_filters_reach_the_scan(spark, tmp_path, regions):
    spark.createDataFrame([], schemas.PARSED_RESULTS).write.parquet(str(tmp_path / "p"))
    parsed = spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = S.search_notices(parsed, regions, S.SearchParams(date_range="7d", notice_type="招标"), AS_OF).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(publish_date" in plan and "EqualTo(notice_type" in plan and "summary" not in plan.split("ReadSchema")[1]


def test_hits_of_prefix_names(spark):
    from noticeworks.functions.matching import with_name_hits

    df = spark.createDataFrame([(1, "在甲县乙镇丙"), (2, ""), (3, None), (4, "乙镇甲县𠀀甲")], "id int, t string")
    names = spark.createDataFrame([("甲县",), ("甲县乙镇",), ("乙镇",), ("𠀀甲",), ("无",)], "name string")
    want = {1: ["甲县", "甲县乙镇", "乙镇"], 2: [], 3: [], 4: ["乙镇", "甲县", "𠀀甲"]}
    many = names.union(spark.range(3000).selectExpr("concat('名', id % 2500, repeat('x', id % 300))"))
    for listed in (names, many):
        for how in ({"limit": 4000}, {"limit": 0}, {"limit": 0, "block_chars": 5}, {"limit": 0, "chars": 0}):
            if listed is many and "block_chars" in how:
                how = {"limit": 0, "block_chars": 100_000}
            got = {r.id: r.hits for r in with_name_hits(df, "id", F.col("t"), listed, "hits", **how).collect()}
            assert got == want, how


def test_hits_without_case_in_rank_order(spark):
    from noticeworks.functions.matching import with_name_hits

    df = spark.createDataFrame([(1, "Straße ISTANBUL İzmir ab AB"), (2, "AbAbAb"), (3, None)], "id int, t string")
    names = spark.createDataFrame([(5, "AB"), (1, "istanbul"), (3, "ab"), (4, "İZMIR"), (2, "STRASSE"), (9, "izm"), (0, ""), (7, "ab")], "rank int, name string")
    got = [{r.id: r.hits for r in with_name_hits(df, "id", F.col("t"), names, "hits", ignore_case=True, **how).collect()} for how in ({}, {"limit": 0}, {"limit": 0, "block_chars": 3}, {"limit": 0, "chars": 0})]
    assert got[1] == got[2] == got[3] and got[1][2] == ["ab", "AB"] and got[1][1][0] == "istanbul" and got[1][3] == []
    assert {k: [h for h in v if h != "İZMIR"] for k, v in got[0].items()} == {k: [h for h in v if h != "İZMIR"] for k, v in got[1].items()}


def test_a_hundred_thousand_names_in_one_narrow_pass(spark):
    from noticeworks.functions.matching import with_name_hits

    df = spark.range(400).selectExpr("id", "concat('a', id * 250, 'b', id * 31, 'c') AS t")
    names = spark.range(100_000).selectExpr("concat('a', id, 'b') AS name")
    out = with_name_hits(df, "id", F.col("t"), names, "hits")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan
    assert {r.id: r.hits for r in out.collect()} == {i: [f"a{i * 250}b"] for i in range(400)}
    nested = spark.range(300).selectExpr("repeat('x', int(id) + 1) AS name")
    assert [len(r.hits) for r in with_name_hits(spark.createDataFrame([(1, "x" * 200)], "id int, t string"), "id", F.col("t"), nested, "hits").collect()] == [200]


def test_long_chains_and_circles(spark):
    from noticeworks import schemas
    from noticeworks.operators import cleanup

    rows = [(i, f"n{i}", None, "province" if i == 1 else "village", i - 1 if i > 1 else None, True) for i in range(1, 13)]
    chain = spark.createDataFrame(rows, schemas.SEARCH_REGIONS)
    paths = {r.id: r.path for r in R.region_paths(chain).collect()}
    assert paths[12] == " > ".join(f"n{i}" for i in range(1, 13))
    assert cleanup.delete_regions(chain.where("id = 2").select("id"), chain).count() == 1
    circle = spark.createDataFrame([(i, "n", None, "city", i % 40 + 1, True) for i in range(1, 41)], schemas.SEARCH_REGIONS)
    with pytest.raises(ValueError, match="circle"):
        R.with_ancestors(circle)


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    from noticeworks import schemas

    rows = [(i, f"n{i}", None, "district" if i in (3, 10) else "village", i - 1 if i > 1 else None, i != 500) for i in range(1, 1001)]
    rows += [(2000, "lost", None, "street", 9999, True), (2001, "below", None, "village", 2000, True)]
    rounds = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    out = {r.id: r for r in R.with_ancestors(spark.createDataFrame(rows, schemas.SEARCH_REGIONS)).collect()}
    assert len(rounds) <= 12  # the start and eleven rounds
    assert out[1000].path == " > ".join(f"n{i}" for i in range(1, 1001)) and out[1000].search_name == " ".join(f"n{i}" for i in range(10, 1001))
    assert out[7].search_name == "n3 n4 n5 n6 n7" and out[2].search_name == "n1 n2" and out[10].search_name == "n10"
    assert out[499].reachable and not out[500].reachable and not out[900].reachable and {out[i].district_id for i in (5, 10, 700)} == {3}
    assert (out[2001].path, out[2001].search_name, out[2001].reachable) == ("lost > below", "lost below", False)
