from datetime import datetime as dt

from noticeworks import schemas
from noticeworks.operators.reconcile import status_view


def test_status_and_title_order(spark):
    pages = spark.createDataFrame(
        [("p1", "u1", None, None, dt(2024, 1, 2), "pq", "ps", ("page one", "website", None)), ("p2", "u2", None, None, None, "", None, ("page two", "", None))],
        schemas.RAW_PAGES,
    )
    from pyspark.sql import functions as F

    res = spark.createDataFrame(
        [(1, "http://u1", "u1"), (2, "http://title", "u2"), (3, "result three", "u3"), (4, "http://u4", "u4")], "id bigint, title string, url string"
    )
    results = spark.createDataFrame([], schemas.SEARCH_RESULTS).unionByName(res.withColumn("url_hash", F.md5("url")).withColumn("source_type", F.lit("st")), allowMissingColumns=True)
    par = spark.createDataFrame([(9, "", "u1", None), (8, "parsed three", "u3", "e")], "id bigint, title string, url string, parse_errors string")
    parsed = spark.createDataFrame([], schemas.PARSED_RESULTS).unionByName(par.withColumn("url_hash", F.md5("url")), allowMissingColumns=True)
    out = {r.url: r for r in status_view(results, pages, parsed).collect()}
    assert {u: (r.parse_status, r.title) for u, r in out.items()} == {
        "u1": ("parsed", "page one"), "u2": ("unparsed", "page two"), "u3": ("error", "parsed three"), "u4": ("unfetched", "(未抓到标题)"),
    }
    assert (out["u1"].source_type, out["u2"].source_type, out["u1"].search_query) == ("website", "st", "pq")
    assert {r.url for r in status_view(results, pages, parsed, driver="parsed").collect()} == {"u1", "u3"}
