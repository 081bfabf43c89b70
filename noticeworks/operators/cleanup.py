"""Deletes that cascade: each returns the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.regions import region_subtree


def delete_targets(commands: DataFrame) -> DataFrame:
    """Read delete ids: ``pr:n`` and plain numbers are parsed rows, ``sr:n`` results."""
    raw = F.trim(F.col("id").cast("string"))
    prefix = F.when(F.contains(raw, F.lit(":")), F.split(raw, ":", 2)[0])
    number = F.when(F.contains(raw, F.lit(":")), F.split(raw, ":", 2)[1]).otherwise(raw)
    kind = F.when(prefix == "sr", F.lit("sr")).otherwise(F.lit("pr"))
    return (
        commands.select(kind.alias("kind"), number.try_cast("bigint").alias("target"))
        .where(F.col("target").isNotNull()).distinct()
    )


def cascade_delete(
    commands: DataFrame, parsed: DataFrame, results: DataFrame, outbox: DataFrame, samples: DataFrame
) -> dict[str, DataFrame]:
    """Tables after deleting parsed rows (with their messages and samples) or results."""
    targets = delete_targets(commands)
    parsed_ids = targets.where(F.col("kind") == "pr").select(F.col("target").alias("id"))
    result_ids = targets.where(F.col("kind") == "sr").select(F.col("target").alias("id"))
    doomed = parsed.join(parsed_ids, "id", "left_semi").select("url_hash").distinct()
    return {
        "parsed": parsed.join(parsed_ids, "id", "left_anti").select(*parsed.columns),
        "results": results.join(result_ids, "id", "left_anti").select(*results.columns),
        "outbox": outbox.join(doomed, "url_hash", "left_anti").select(*outbox.columns),
        "samples": samples.join(doomed, "url_hash", "left_anti").select(*samples.columns),
    }


def delete_channels(ids: DataFrame, channels: DataFrame, outbox: DataFrame) -> dict[str, DataFrame]:
    """Channels and messages left after deleting channels."""
    gone = ids.select(F.col("id").alias("channel_id"))
    return {
        "channels": channels.join(ids.select("id"), "id", "left_anti").select(*channels.columns),
        "outbox": outbox.join(gone, "channel_id", "left_anti").select(*outbox.columns),
    }


def delete_regions(ids: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions left after deleting regions with everything below them."""
    gone = region_subtree(regions, ids)
    return regions.join(gone, "id", "left_anti").select(*regions.columns)
