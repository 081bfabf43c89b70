"""Reading and writing the model tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators.merge import PARSED_ALWAYS, PARSED_FIELDS, PARSED_TYPED, UNREADABLE, latest_rest, one_per_key, parse_outcome, rest_fields
from noticeworks.sources.runs import RunTable

PAGE_COLUMNS = ("id", "url", "html", "search_query", "source_name", "meta", "crawled_at")


def read_raw_pages(spark: SparkSession, path: str, columns: tuple[str, ...] = PAGE_COLUMNS) -> DataFrame:
    """Raw pages with only the columns asked for; missing columns read as NULL."""
    return spark.read.schema(schemas.RAW_PAGES).parquet(path).select(*columns)


def read_page_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw pages with the fields that the schema does not know as one object ``rest`` (a VARIANT; null if there are none).

    ``fmt`` is json (a document per line; lines that are no object are left out) or parquet.  Columns that
    are not selected later are not decoded.
    """
    known = spark.createDataFrame([], schemas.RAW_PAGES).schema
    if fmt == "parquet":
        stored = spark.read.parquet(path)
        unknown = [c for c in stored.columns if c not in known.names]
        rest = F.to_variant_object(F.struct(*unknown)) if unknown else F.lit(None).cast("variant")
        fields = [F.col(f.name).cast(f.dataType) if f.name in stored.columns else F.lit(None).cast(f.dataType) for f in known]
        documents = stored.select(*[c.alias(f.name) for c, f in zip(fields, known)], rest.alias("rest"))
    else:
        parsed = spark.read.text(path).select(F.try_parse_json("value").alias("d"))
        objects = parsed.where(F.try_variant_get("d", "$", "map<string,variant>").isNotNull())
        fields = [F.try_variant_get("d", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in known]
        others = F.map_filter(F.try_variant_get("d", "$", "map<string,variant>"), lambda k, _: ~k.isin(*known.names))
        documents = objects.select(*fields, F.to_variant_object(others).alias("rest"))
    filled = rest_fields(F.col("rest"))
    return documents.withColumn("rest", F.when(F.size(filled) > 0, F.to_variant_object(filled)))


def read_table(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan that has fewer splits than there are cores.

    Text work is bound by CPU, and a small file with one row group would keep one
    core busy.  Large tables have more splits than cores and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_region_tree(spark: SparkSession, path: str) -> DataFrame:
    """Nested region file, one JSON array."""
    return spark.read.schema(schemas.REGION_TREE).option("multiLine", True).json(path)


def save_bucketed(df: DataFrame, table: str, key: str = "url_hash", buckets: int = 512) -> None:
    """Store a table bucketed and sorted by its key, so merges and anti joins do not shuffle it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of a log; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """All batches of a log, of runs or plain ones, empty when there is none yet."""
    full = f"{schema.strip()}, batch_id bigint"
    if (runs := RunTable(spark, path, schema)).runs():
        return runs.read()
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


#: Order of the crawls of a URL in a log.
NEWEST = ("crawled_at", "batch_id", "id")


def current_pages(log: DataFrame) -> DataFrame:
    """Page table of a page log: newest crawl per URL, id of the first."""
    owned = ("html", "content_hash", "crawled_at", "search_query", "source_name", "meta")
    current = log.groupBy("url").agg(
        F.min_by("id", F.struct("batch_id", "crawled_at", "id")).alias("id"),
        F.max_by(F.struct(*owned), F.struct(*NEWEST)).alias("_row"),
    ).select("id", "url", "_row.*")
    return current.join(latest_rest(log, "url", NEWEST), "url", "left").select(*current.columns, "rest") if "rest" in log.columns else current


def current_parsed(log: DataFrame) -> DataFrame:
    """Parsed table of a parsed log: what merging the batches one after another gives."""
    outcome = parse_outcome(log)
    when = F.struct("batch_id", "mongo_doc_id")
    return (
        log.withColumn("_o", outcome).groupBy("url_hash").agg(
            F.max_by(F.struct(*PARSED_ALWAYS), when).alias("_a"),
            F.max_by(F.struct(*PARSED_TYPED), F.when(~F.col("_o").isin(*UNREADABLE), when)).alias("_t"),
            F.max_by(F.struct(*PARSED_FIELDS), F.when(F.col("_o") == "ok", when)).alias("_f"),
            F.min_by("created_by", when).alias("created_by"),
        ).select("url_hash", "_a.*", "_t.*", "_f.*", "created_by")
    )


def current_outbox(log: DataFrame) -> DataFrame:
    """Outbox of a message log: first message per channel and notice."""
    return one_per_key(log, ["channel_id", "url_hash"], ["batch_id"], keep="first")


# Rows of a log that its current table, and any later one, can still need.


def surviving_pages(log: DataFrame) -> DataFrame:
    """Of each URL the newest crawl, and without their html the first one, for its id, and the last one of each unknown field."""
    rows = F.struct(*log.columns)
    picked = log.groupBy("url").agg(F.min_by(rows, F.struct("batch_id", "crawled_at", "id")).alias("a"), F.max_by(rows, F.struct(*NEWEST)).alias("b"))

    def slim(row: Column) -> Column:
        return row.withField("html", F.lit(None).cast("string")).withField("meta", F.lit(None).cast(log.schema["meta"].dataType))

    def same(a: str, b: str) -> Column:
        return F.struct(*[f"{a}.{c}" for c in NEWEST]).eqNullSafe(F.struct(*[f"{b}.{c}" for c in NEWEST]))

    kept = picked.select(F.explode(F.when(same("a", "b"), F.array("b")).otherwise(F.array(slim(F.col("a")), "b"))).alias("r"))
    if "rest" not in log.columns:
        return kept.select("r.*")
    entries = log.where(F.col("rest").isNotNull()).select("url", F.struct(*NEWEST).alias("at"), F.explode(rest_fields(F.col("rest"))).alias("k", "v"), rows.alias("r"))
    holders = entries.groupBy("url", "k").agg(F.max_by("r", "at").alias("r")).groupBy("url", F.struct(*[f"r.{c}" for c in NEWEST]).alias("at")).agg(F.first("r").alias("r"))
    others = holders.join(picked, "url").where(~same("r", "a") & ~same("r", "b")).select(slim(F.col("r")).alias("r"))
    return kept.unionByName(others).select("r.*")


def surviving_parsed(log: DataFrame) -> DataFrame:
    """Of each URL the first row, the last one, the last readable one and the last good one."""
    rows, when = F.struct(*log.columns), F.struct("batch_id", "mongo_doc_id")
    judged = log.withColumn("_o", parse_outcome(log))
    readable, good = F.when(~F.col("_o").isin(*UNREADABLE), when), F.when(F.col("_o") == "ok", when)
    picked = judged.groupBy("url_hash").agg(
        F.array(F.min_by(rows, when), F.max_by(rows, when), F.max_by(rows, readable), F.max_by(rows, good)).alias("r")
    )
    return picked.select(F.explode(F.array_distinct(F.array_compact("r"))).alias("r")).select("r.*")


def surviving_messages(log: DataFrame) -> DataFrame:
    return current_outbox(log)
