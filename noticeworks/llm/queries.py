"""Registered queries opN_<name> and the pipeline: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from noticeworks.llm import decontam, langid, licenses, maintext, packing, passages, quality, secrets, simhash, substrings, urlfilter, variants, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("bench_items").cast("long").alias("n_items"), decontam.digest(F.col("bench_items")).alias("items_sha256"), "contaminated")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep=False)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)


def held_out() -> F.Column:
    """Null for a null id, which is neither learned from nor held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    prototypes = langid.learn(table(spark, sf_dir, "documents", "doc_id", "lang", "text").filter(~held_out()))
    found = langid.identify(docs, prototypes, keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep_html=False)


#: Stated rules of op9.
RULES = [urlfilter.Rule(*x) for x in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))]


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES).drop("url")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.shown(secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_shared(table(spark, sf_dir, "documents", "doc_id", "text"), keep=False)


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents", "doc_id", "text"), damage=31))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


# The other queries have no SQL: they need automata, trees, trained vectors, hashes or tokens; their tests hold them against plain loops.
ORACLES["op1_decontamination"] = decontam.ORACLE_SQL
ORACLES["op2_quality"] = quality.ORACLE_SQL
ORACLES["op11_passages"] = passages.ORACLE_SQL
ORACLES["op12_variants"] = variants.ORACLE_SQL
ORACLES["op9_urls"] = urlfilter.oracle_sql(RULES)

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
