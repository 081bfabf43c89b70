"""Labelled samples and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_checks.model import AS_OF, Model
from driver_checks.registry import query
from noticeworks.functions.labelling import training_input
from noticeworks.operators import ml
from noticeworks.operators import samples as S
from noticeworks.plans import jobs
from noticeworks.profile import LATIN_TEST


@query("sample_import", """
    SELECT p.id AS parsed_id, p.url_hash, t.text AS content
    FROM m_parsed p JOIN m_results r ON p.url_hash = r.url_hash JOIN m_doc_text t ON p.mongo_doc_id = t.id
    WHERE p.parse_errors IS NULL AND p.notice_type NOT IN ('list_page', 'search_serp') AND r.domain = 'src1.example'
    UNION ALL SELECT * FROM (
        SELECT p.id, p.url_hash, t.text FROM m_parsed p JOIN m_doc_text t ON p.mongo_doc_id = t.id
        WHERE p.url_hash NOT IN (SELECT url_hash FROM m_samples WHERE labeled_by = 'admin')
        ORDER BY p.created_at DESC, p.id DESC LIMIT 30)
""")
def sample_import(m: Model):
    none = m.samples.where("false")
    by_domain = S.import_samples(m.parsed, m.results, m.doc_pages, none, domain="src1.example")
    known = m.samples.where("labeled_by = 'admin'")
    newest = S.import_samples(m.parsed, m.results, m.doc_pages, known, limit=30, include_low_quality=True)
    return by_domain.unionByName(newest).select("parsed_id", "url_hash", "content")


@query("sample_candidates", """
    SELECT id FROM m_parsed WHERE parse_errors IS NULL AND notice_type NOT IN ('list_page', 'search_serp')
      AND url_hash NOT IN (SELECT url_hash FROM m_samples WHERE labeled_by = 'ai')
""")
def sample_candidates(m: Model):
    return S.sample_candidates(m.parsed, m.results, m.samples.where("labeled_by = 'ai'")).select("id")


@query("label_stats", """
    SELECT count(*) AS total, count(label) AS labeled, count(*) FILTER (label IS NULL) AS unlabeled,
           count(*) FILTER (label = 1) AS relevant, count(*) FILTER (label = 0) AS irrelevant, count(*) FILTER (labeled_by = 'ai') AS ai
    FROM m_samples
""")
def label_stats(m: Model):
    return S.label_stats(m.samples)


@query("typed_notices", "SELECT count(notice_type) AS typed FROM m_parsed")
def typed_notices(m: Model):
    return S.typed_notices(m.parsed)


@query("label_commands", """
    SELECT id, CASE WHEN label IS NULL AND contains(search_query, 'en') THEN 1 ELSE label END AS label,
           CASE WHEN label IS NULL AND contains(search_query, 'en') THEN 'admin' ELSE labeled_by END AS labeled_by FROM m_samples
""")
def label_commands(m: Model):
    new = m.samples.where("label IS NULL").select(
        "id", F.when(F.contains("search_query", F.lit("en")), F.lit(1)).otherwise(F.lit(5)).alias("label"),
        F.lit("admin").alias("labeled_by"), F.lit(AS_OF).alias("at"),
    )
    return S.apply_labels(m.samples, new).select("id", "label", "labeled_by")


@query("delete_samples", "SELECT id FROM m_samples WHERE label IS NULL OR label = 1")
def delete_samples(m: Model):
    return S.delete_samples(m.samples, m.samples.where("label = 0")).select("id")


@query("training_text", """
    SELECT concat('__label__', CASE WHEN label = 1 THEN 'relevant' ELSE 'irrelevant' END, ' ',
        trim(regexp_replace(concat_ws(' ', t, t, t, c), '[\\r\\n]+', ' ', 'g'), ' ')) AS value
    FROM (SELECT label, trim(title, ' ' || chr(10)) AS t, trim(content, ' ' || chr(10)) AS c FROM m_samples WHERE label IS NOT NULL)
    WHERE t <> '' OR c <> ''
""")
def training_text(m: Model):
    return S.export_training_text(m.samples)


@query("training_inputs", """
    SELECT id, CASE WHEN c = '' THEN t ELSE concat(t, ' [SEP] ', c) END AS model_text
    FROM (SELECT id, trim(title, ' ' || chr(10)) AS t, trim(content, ' ' || chr(10)) AS c FROM m_samples)
    WHERE t <> '' OR c <> ''
""")
def training_inputs(m: Model):
    made = m.samples.select("id", training_input(F.col("title"), F.col("content")).alias("model_text"))
    return made.where(F.col("model_text").isNotNull())


@query("label_balance", """
    SELECT *, round(greatest(relevant, irrelevant) / greatest(least(relevant, irrelevant), 1), 6) AS imbalance_ratio,
        total >= 20 AND least(relevant, irrelevant) >= 5 AS enough,
        CASE WHEN greatest(relevant, irrelevant) > 3 * greatest(least(relevant, irrelevant), 1) THEN 'both' ELSE 'none' END AS strategy
    FROM (SELECT count(*) AS total, count(*) FILTER (label = 1) AS relevant, count(*) FILTER (label = 0) AS irrelevant
          FROM m_samples WHERE label IS NOT NULL AND (trim(title) <> '' OR trim(content) <> ''))
""")
def label_balance(m: Model):
    return S.label_balance(m.samples)


@query("strat_split", """
    SELECT url_hash, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url_hash))
        <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.15)) THEN 'val' ELSE 'train' END AS split FROM m_samples
""")
def strat_split(m: Model):
    return S.stratified_split(m.samples).select("url_hash", "label", "split")


@query("strat_split_orders", """
    SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url_hash))
        <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.15)) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT id, notice_type AS label, url_hash FROM m_notices)
""")
def strat_split_orders(m: Model):
    return S.stratified_split(m.notices.select("id", F.col("notice_type").alias("label"), "url_hash")).select("id", "label", "split")


@query("class_weights", """
    SELECT label, n, 1.0::double / n AS sample_weight, sum(n) OVER () / (2.0::double * n) AS class_weight
    FROM (SELECT label, count(*) AS n FROM m_samples WHERE label IN (0, 1) GROUP BY label)
""")
def class_weights(m: Model):
    return S.class_weights(m.samples)


@query("balanced_weights", """
    SELECT id, total / (2.0::double * n) AS weight FROM (
        SELECT id, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM m_samples WHERE label IN (0, 1))
""")
def balanced_weights(m: Model):
    return S.with_balance(m.samples, "weight").select("id", "weight")


@query("balance_sampler", """
    WITH sized AS (SELECT id, label, count(*) OVER () / (2.0::double * count(*) OVER (PARTITION BY label)) AS weight,
        ('0x' || substr(md5('42:' || url_hash), 1, 8))::bigint / 4294967296.0::double AS share FROM m_samples WHERE label IN (0, 1))
    SELECT id, label, weight FROM (SELECT id, label, weight,
        unnest(generate_series(1, floor(weight)::bigint + CASE WHEN share < weight - floor(weight) THEN 1 ELSE 0 END)) FROM sized)
""")
def balance_sampler(m: Model):
    return S.with_balance(m.samples, "both").select("id", "label", "weight")


@query("binary_metrics", """
    SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (
        SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (
            SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp,
                   count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels))
""")
def binary_metrics(m: Model):
    return S.binary_metrics(m.table("labels").selectExpr("quality AS prediction", "1 - toxic AS label"))


@query("uncertain_topk", """
    SELECT id, round(score, 4) AS score FROM (
        SELECT id, length(content) / 2000.0::double AS score FROM (
            SELECT * FROM m_samples WHERE label IS NULL))
    WHERE score BETWEEN 0.3 AND 0.7 ORDER BY abs(score - 0.5), id LIMIT 50
""")
def uncertain_topk(m: Model):
    def by_length(df):
        return df.withColumn("score", F.length("content") / 2000.0)

    return S.uncertain_topk(m.samples, by_length).select("id", "score")


@query("score_with_batches", """
    SELECT id, length(CASE WHEN title <> '' THEN concat(title, ' [SEP] ', content) ELSE content END) / 10000.0::double AS score
    FROM m_samples
""")
def score_with_batches(m: Model):
    scored = ml.score_with(m.samples, lambda texts: texts.str.len() / 10000.0, text="content")
    return scored.select("id", "score")


REJUDGE = """
    SELECT id, CASE WHEN notice_type = 'search_serp' THEN 'skipped' ELSE 'scored' END AS action,
        CASE WHEN notice_type = 'search_serp' THEN is_relevant ELSE amount_value / 2000 >= 0.5 END AS is_relevant,
        coalesce(notice_type, CASE WHEN regexp_matches(concat(title, ' ', text), '(?i)\\b(award|winner)\\b') THEN 'award'
            WHEN regexp_matches(concat(title, ' ', text), '(?i)\\b(correction|amend\\w*)\\b') THEN 'change'
            WHEN regexp_matches(concat(title, ' ', text), '(?i)\\b(the|der|les|los)\\b') THEN 'tender' END) AS notice_type
    FROM (SELECT p.*, coalesce(nullif(t.text, ''), concat(p.summary, ' ', p.title)) AS text FROM m_parsed p LEFT JOIN m_doc_text t ON p.mongo_doc_id = t.id)
"""


@query("rejudge_job", REJUDGE)
def rejudge_job(m: Model):
    def by_amount(df):
        return df.withColumn("score", F.col("amount_value") / 2000)

    done = jobs.rejudge_job(m.parsed, m.doc_pages, ["the"], by_amount, LATIN_TEST)
    return done.select("id", "action", "is_relevant", "notice_type")


TRAINABLE = """
    SELECT url_hash, label FROM m_samples WHERE label IN (0, 1) AND (trim(title, ' ' || chr(10)) <> '' OR trim(content, ' ' || chr(10)) <> '')
"""
HELD_OUT = """
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url_hash))
        <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.15)) AS held_out FROM
"""


@query("train_relevance", f"""
    SELECT count(*) AS samples, count(*) FILTER (held_out AND label = 1) AS relevant, count(*) FILTER (held_out AND label = 0) AS irrelevant,
        true AS rated FROM ({HELD_OUT} ({TRAINABLE}))
""")
def train_relevance(m: Model):
    """Rows used, held-out rows of each class, and whether the metrics are shares."""
    metrics = ml.train_relevance(m.samples, features=1 << 12, iterations=5)[1]
    return metrics.selectExpr(
        "cast(samples AS bigint) AS samples", "tp + fn AS relevant", "fp + tn AS irrelevant",
        "accuracy BETWEEN 0 AND 1 AND precision BETWEEN 0 AND 1 AND recall BETWEEN 0 AND 1 AND f1 BETWEEN 0 AND 1 AS rated",
    )


NOTICE_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("train_notice_type", f"""
    SELECT count(*) AS samples, count(*) FILTER (held_out) AS held_out, true AS rated FROM ({HELD_OUT} (
        SELECT url_hash, notice_type AS label FROM (SELECT * FROM m_notices WHERE notice_type IS NOT NULL ORDER BY id DESC LIMIT 5000) WHERE trim(title) <> ''))
""")
def train_notice_type(m: Model):
    metrics = ml.train_notice_type(m.notices, features=1 << 10, iterations=5, labels=NOTICE_KINDS)[1]
    return metrics.selectExpr("cast(samples AS bigint) AS samples", "held_out", "accuracy BETWEEN 0 AND 1 AS rated")


@query("score_samples", "SELECT id, true AS scored FROM m_samples")
def score_samples(m: Model):
    model, _ = ml.train_relevance(m.samples, features=1 << 12, iterations=5)
    return ml.score_text(m.samples, model, text="content").selectExpr("id", "score BETWEEN 0 AND 1 AS scored")


@query("score_types", "SELECT id, true AS scored FROM m_notices")
def score_types(m: Model):
    model, _ = ml.train_notice_type(m.notices, features=1 << 10, iterations=5, labels=NOTICE_KINDS)
    scored = ml.score_type(m.notices, model, text="summary")
    known = F.col("model_type").isin(*NOTICE_KINDS) & F.col("type_confidence").between(0, 1)
    return scored.select("id", known.alias("scored"))
