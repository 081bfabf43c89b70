"""Region registry: tree walks, name sets, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.lists import SEARCH_SUFFIXES, level_label, strip_region_suffix
from noticeworks.operators.merge import first_wins
from noticeworks.session import cut_lineage

# Levels below a district, and the pseudo city of municipalities.
SUB_LEVELS = ("street", "town", "village", "community")
PSEUDO_CITY = "市辖区"


def path_id(path: Column) -> Column:
    """Stable id of a region from its full path."""
    return F.conv(F.left(F.md5(path), F.lit(15)), 16, 10).cast("bigint")


def flatten_region_tree(tree: DataFrame) -> DataFrame:
    """Region rows of nested province, city and district records.

    Districts of the pseudo city belong to their province directly.
    """
    cities = tree.select(
        F.col("name").alias("province"), F.col("code").alias("province_code"),
        F.explode_outer("children").alias("city"),
    )
    districts = cities.select(
        "province", "city.name", F.explode("city.children").alias("district")
    ).withColumnRenamed("name", "city")
    own_city = F.col("city") != PSEUDO_CITY

    def rows(df: DataFrame, level: str, name: Column, code: Column, *parents: Column) -> DataFrame:
        path = F.concat_ws("/", *parents, name)
        parent = F.concat_ws("/", *parents)
        return df.select(
            path_id(path).alias("id"), name.alias("name"), code.alias("code"),
            F.lit(level).alias("level"),
            (path_id(parent) if parents else F.lit(None).cast("bigint")).alias("parent_id"),
            F.lit(False).alias("enabled"),
        )

    provinces = rows(tree, "province", F.col("name"), F.col("code"))
    city_rows = rows(
        cities.where(F.col("city").isNotNull() & (F.col("city.name") != PSEUDO_CITY)),
        "city", F.col("city.name"), F.col("city.code"), F.col("province"),
    )
    district_rows = rows(
        districts.withColumn("city", F.when(own_city, F.col("city"))),
        "district", F.col("district.name"), F.col("district.code"), F.col("province"), F.col("city"),
    )
    return provinces.unionByName(city_rows).unionByName(district_rows)


def merge_regions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows plus incoming ones whose (name, parent) is new."""
    keyed = incoming.withColumn("_parent", F.coalesce("parent_id", F.lit(-1)))
    fresh = first_wins(keyed, ["name", "_parent"], ["id"]).drop("_parent").alias("n")
    known = existing.select("name", "parent_id").alias("e")
    same = (F.col("n.name") == F.col("e.name")) & F.col("n.parent_id").eqNullSafe(F.col("e.parent_id"))
    return existing.unionByName(fresh.join(known, same, "left_anti").select(*existing.columns))


def enable_regions(regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Switch on the regions listed by (name, parent_id)."""
    r, c = regions.alias("r"), chosen.select("name", "parent_id").distinct().withColumn("_on", F.lit(True)).alias("c")
    same = (F.col("r.name") == F.col("c.name")) & F.col("r.parent_id").eqNullSafe(F.col("c.parent_id"))
    return r.join(c, same, "left").select(
        *[
            (F.col("r.enabled") | F.col("c._on").isNotNull()).alias("enabled") if x == "enabled" else F.col(f"r.{x}")
            for x in regions.columns
        ]
    )


def along_chains(nodes: DataFrame, joined: dict[str, Column]) -> DataFrame:
    """Values of whole chains of parents, by pointer doubling.

    ``nodes`` has ``id``, ``next`` (the parent) and a value per column for the node alone. ``joined`` says
    what a piece of chain ``low`` and the piece ``high`` above it are together.  Every round doubles the pieces and
    is written once, so a chain of n takes about log2(n) rounds.  ``lost`` tells that a parent is missing.
    Fails if parents form a circle.
    """
    state, rounds, most = cut_lineage(nodes.withColumn("lost", F.lit(False))), 0, None
    while not state.where(F.col("next").isNotNull()).isEmpty():
        most = nodes.count() if most is None else most
        if 1 << rounds > most:
            raise ValueError("the parents of some regions form a circle")
        low, high = state.alias("low"), state.alias("high")
        found = F.col("high.id").isNotNull()
        values = {c: F.when(found, joined[c]).otherwise(F.col(f"low.{c}")) for c in joined}
        missing = F.col("low.next").isNotNull() & ~found
        state = cut_lineage(
            low.join(high, F.col("low.next") == F.col("high.id"), "left").select(
                "low.id", F.col("high.next").alias("next"), *[v.alias(c) for c, v in values.items()],
                (F.col("low.lost") | missing | F.coalesce("high.lost", F.lit(False))).alias("lost"),
            )
        )
        rounds += 1
    return state.drop("next")


def with_ancestors(regions: DataFrame) -> DataFrame:
    """Each region with what its chain of parents tells.

    ``path``        full path from the root,
    ``search_name`` name with parents up to the district for levels below it,
    ``reachable``   the chain ends at a root and is enabled all the way,
    ``district_id`` district nearest to the root on the chain.
    """
    district = F.col("level") == "district"
    nodes = regions.select(
        "id", F.col("parent_id").alias("next"), F.col("name").alias("path"), F.col("name").alias("whole"), F.col("name").alias("short"),
        district.alias("ends"), F.coalesce("enabled", F.lit(False)).alias("on"), F.when(district, F.col("id")).alias("district_id"),
    )
    chains = along_chains(nodes, {
        "path": F.concat("high.path", F.lit(" > "), "low.path"),
        "whole": F.concat("high.whole", F.lit(" "), "low.whole"),
        # up to the first district, or as far as the piece goes
        "short": F.when(F.col("low.ends"), F.col("low.short")).otherwise(F.concat("high.short", F.lit(" "), "low.whole")),
        "ends": F.col("low.ends") | F.col("high.ends"),
        "on": F.col("low.on") & F.col("high.on"),
        "district_id": F.coalesce("high.district_id", "low.district_id"),
    })
    below = F.col("level").isin(*SUB_LEVELS)
    return regions.select("id", "name", "level", "parent_id", "enabled").join(chains, "id").select(
        "id", "name", "level", "parent_id", "enabled", "path", F.when(below, F.col("short")).otherwise(F.col("name")).alias("search_name"),
        (F.col("on") & ~F.col("lost")).alias("reachable"), "district_id",
    )


def region_paths(regions: DataFrame) -> DataFrame:
    return with_ancestors(regions).select("id", "name", "level", "enabled", "path", "search_name")


def district_subtrees(regions: DataFrame) -> DataFrame:
    """Enabled districts and what lies below them; a disabled parent hides its subtree."""
    return (
        with_ancestors(regions)
        .where(F.col("reachable") & F.col("district_id").isNotNull())
        .select(
            "district_id", "id", "name", "level", level_label(F.col("level")).alias("level_label"), "parent_id"
        )
    )


def region_children(regions: DataFrame) -> DataFrame:
    """Every region with the number of its direct children."""
    counts = regions.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.count(F.lit(1)).alias("child_count")
    )
    return regions.join(counts, "id", "left").select(
        "id", "name", "code", "level", level_label(F.col("level")).alias("level_label"), "parent_id",
        "enabled", F.coalesce("child_count", F.lit(0)).alias("child_count"),
    )


def region_search(regions: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """Regions whose name contains ``text`` (two characters at least), with their path; with ``n``, the first so many."""
    text = text.strip()
    hits = regions.where(F.contains("name", F.lit(text))) if len(text) >= 2 else regions.where(F.lit(False))
    first = (hits if n is None else hits.orderBy("id").limit(n)).select("id")
    return (
        with_ancestors(regions).join(first, "id", "left_semi")
        .select("id", "name", "level", level_label(F.col("level")).alias("level_label"), "enabled", "path")
        .orderBy("id")
    )


def region_name_set(regions: DataFrame, suffixes: tuple[str, ...] = SEARCH_SUFFIXES) -> DataFrame:
    """Distinct names below the province, with and without their suffix."""
    names = regions.where((F.col("level") != "province") & (F.length("name") >= 2)).select("name")
    bare = names.select(strip_region_suffix(F.col("name"), suffixes).alias("name")).where(F.length("name") >= 2)
    return names.union(bare).distinct()


def district_names(regions: DataFrame, enabled: bool) -> DataFrame:
    """Names the alert rules look for: districts, switched on or off."""
    return regions.where(
        (F.col("level") == "district") & (F.col("enabled") == enabled) & (F.length("name") >= 2)
    ).select("name").distinct()


def with_region_name(df: DataFrame, regions: DataFrame) -> DataFrame:
    names = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"))
    return df.join(names, "region_id", "left")


def resolve_region(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Region id for a region name; the oldest region of that name."""
    ids = regions.groupBy(F.col("name").alias("region_name")).agg(F.min("id").alias("region_id"))
    return items.join(ids, "region_name", "left")


def region_subtree(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of the given regions and everything below them."""
    chosen = roots.select("id").distinct().withColumn("hit", F.lit(True))
    nodes = regions.join(chosen, "id", "left").select("id", F.col("parent_id").alias("next"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return along_chains(nodes, {"hit": F.col("low.hit") | F.col("high.hit")}).where("hit").select("id")
