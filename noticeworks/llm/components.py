"""Connected components by alternating large-star and small-star steps over edge tables.

Each step is two shuffles of the edges; every round is written to the shared folder, so nothing of the
graph is ever held by one task or the driver. The number of rounds is logarithmic in the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = both.join(least, "a")
    moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select("b", "m").toDF("a", "b").union(least.select("a", "m").toDF("a", "b"))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b of one orderable type); the root is the smallest node reachable.

    Repeated edges, either direction and loops are accepted, nulls are ignored; no edges give no rows.
    """
    edges = edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
