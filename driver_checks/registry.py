"""Collects queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_checks.model import Model, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so both engines show the same values."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Model(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
