"""The pipeline, stage by stage, against plain loops."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_nearcopies import similar_groups
from test_packing import checked
from test_secrets import merged, slow_spans

import corpus_pipeline as pipeline
from noticeworks.llm import decontam, secrets

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows that each stage gets and the last one's pieces."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34 ?", "en", "x", 7), (None, "Null id, some words here", None, "x", None), (0, docs.filter("doc_id = 0").first().text, "en", "x", 1), (0, docs.filter("doc_id = 0").first().text, "en", "x", 1)], docs.schema)
    docs = docs.union(extra)
    for name, stage in pipeline.STAGES[:-1]:
        out.append(docs.collect())
        after = stage(spark, docs, DIR)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(after.collect(), after.schema)
    out.append(docs.collect())
    return out, pipeline.STAGES[-1][1](spark, docs, DIR).collect()


def test_language_drops_what_has_no_letter(kept):
    before, after = kept[0][:2]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {-1, -2}
    assert len(after) == len(before) - 2 and all(r.lang for r in after)


def test_without_labels_only_what_has_no_letter_goes(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34 ?", None, "x", 7), (-3, "", None, "x", 0), (-4, "1 ж 2", None, "x", 5), (None, "日本", None, "x", 2)], docs.schema)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).union(extra)
    left = pipeline.language(spark, unlabelled, DIR)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = [tuple(r) for r in unlabelled.collect()], [tuple(r) for r in left.collect()]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if any(c.isalpha() for c in r[1] or "")) and len(after) >= len(before) - 4
    assert {-4, None} <= {r[0] for r in after} and not {-1, -2, -3} & {r[0] for r in after}


def test_one_document_of_each_group_stays(kept):
    """Groups by comparing all pairs of five-word shingle sets."""
    before, after = kept[0][1:3]
    groups = similar_groups([r.text for r in before])
    least = defaultdict(list)
    for r, g in zip(before, groups, strict=True):
        least[g].append((r.doc_id is None, r.doc_id))
    assert sorted(map(str, (min(g) for g in least.values()))) == sorted(str((r.doc_id is None, r.doc_id)) for r in after)


def test_contaminated_documents_go(spark, kept):
    before, after = kept[0][2:4]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    judged = decontam.brute_force([(r.doc_id, r.text) for r in before], items)
    clean = [d for d, *_, bad in judged if not bad]
    assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in after) and len(clean) < len(before)


def test_secrets_are_masked(kept):
    before, after = kept[0][3:]
    masked = {}
    for r, (_, spans) in zip(before, slow_spans([r.text for r in before]), strict=True):
        clean, at = "", 0
        for s, e in merged(spans):
            clean, at = clean + r.text[at:s] + secrets.MASK, e
        masked[r.doc_id] = clean + r.text[at:]
    assert {r.doc_id: r.text for r in after} == masked
    assert all(r.n_chars == len(r.text) for r in after) and not any(re.search("[0-9a-f]{24}", r.text) for r in after)


def test_pieces_of_what_is_left(kept):
    docs = [(r.doc_id, r.text) for r in kept[0][4]]
    assert checked(docs, kept[1], 2048) <= 0.01 * sum(r.length for r in kept[1])


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ours = pipeline.run(spark, DIR)
    key = ["doc_id", "doc_tokens"]
    assert sorted(map(tuple, ours.select(key).distinct().collect())) == sorted(map(tuple, docs.select(key).distinct().collect()))


def test_extra_columns_are_left_behind(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    more = docs.selectExpr("*", "1 AS key", "'x' AS unit", "'y' AS n_words", "2 AS row", "'z' AS lang_pred")
    for name, stage in pipeline.STAGES[:-1]:
        plain, extra = (sorted(map(str, stage(spark, d, DIR).collect())) for d in (docs, more))
        assert plain == extra and stage(spark, more, DIR).columns == docs.columns, name


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_python_gets_bounded_batches(spark):
    """Long texts reach the stages' Python in batches of bounded bytes, not by the ten thousand rows."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10_000).alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(110_000).cast("long").alias("n_chars"))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in pipeline.STAGES:
        if name != "secrets":
            spark.conf.unset(setting)
            stage(spark, docs.limit(0), DIR)
            got = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 300 and max(r.bytes for r in got) < 5 << 20, name
    try:
        spark.conf.set(setting, "123456")
        pipeline.language(spark, docs.limit(0), DIR)
        assert spark.conf.get(setting) == "123456"  # a limit that was given stays
    finally:
        spark.conf.unset(setting)
