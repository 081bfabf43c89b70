"""Corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives documents of the same columns (the last gives pieces). What a stage keeps is written to
the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import decontam, langid, nearcopies, packing, secrets
from noticeworks.session import bound_batches, cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longer texts of a lower cosine are no text of a known language.
LEAST_SCORE, LONG = 0.15, 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or a long text unlike every language learned. An unknown ``lang`` is filled in.

    If no row to learn from has a ``lang``, only documents without a letter go, and ``lang`` stays as it is.
    """
    bound_batches(spark)
    learned = langid.learn(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)) != 2))
    if not learned:
        return langid.with_letters(docs.select(*COLUMNS))
    found = langid.identify(docs.select(*COLUMNS), learned)
    known = (F.col("lang_pred") != langid.NO_LANGUAGE) & ((F.col("score") >= LEAST_SCORE) | (F.length("text") < LONG))
    return found.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group (ids before null; of one id, of the smallest text hash), once.

    Groups are documents linked by a Jaccard similarity of at least 0.8 of their five-word shingles. Null, empty and blank texts are one group; repeated
    rows stay once; no rows give none.
    """
    bound_batches(spark)
    keyed = docs.select(*COLUMNS).withColumn("key", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")))
    groups = nearcopies.near_copies(keyed, id_col="key")
    stay = cut_lineage(groups.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("rows")))
    kept = keyed.join(stay, [keyed["key"].eqNullSafe(stay["key"])]).drop("key")
    if stay.filter("rows > 1").isEmpty():
        return kept.select(*COLUMNS)
    return kept.filter("rows = 1").select(*COLUMNS).union(kept.filter("rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark text. Null and empty texts have none and stay; no rows give none."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(docs.select(*COLUMNS), benchmark).filter("not contaminated").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of a secret; documents stay. Null texts stay null, empty ones empty; no rows give none."""
    found = secrets.find_secrets(docs.select(*COLUMNS))
    return found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens. Null and empty texts are a piece of their end mark; no rows give none."""
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: SQL expresses neither the profiles nor the tokens; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
