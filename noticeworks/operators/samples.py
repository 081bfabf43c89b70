"""Labelled samples: import, statistics, split, weights, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.basics import blank_to_null, leading, strip
from noticeworks.functions.labelling import training_input
from noticeworks.functions.text import html_to_text, strip_nul
from noticeworks.functions.urls import domain_matches
from noticeworks.operators.merge import one_per_key
from noticeworks.profile import LIST_PAGE, SEARCH_SERP
from noticeworks.session import cut_lineage

VALIDATION_SHARE = 0.15
SEED = 42
# Leading hex digits of the split order: 65,536 groups per class.
SPLIT_DIGITS = 4


def sample_candidates(
    parsed: DataFrame, results: DataFrame, samples: DataFrame, domain: str = "",
    include_low_quality: bool = False,
) -> DataFrame:
    """Parsed rows that may become samples: right domain, not imported yet, with content.

    Rows without a notice type are left out by default, as ``not in`` leaves out NULL.
    """
    found = parsed
    if not include_low_quality:
        found = found.where(
            F.col("parse_errors").isNull() & ~F.col("notice_type").isin(LIST_PAGE, SEARCH_SERP)
        )
    if domain.strip():
        inside = results.where(domain_matches(F.col("domain"), domain)).select("url_hash")
        found = found.join(inside, "url_hash", "left_semi")
    return found.join(samples.select("url_hash"), "url_hash", "left_anti").select(*parsed.columns)


def import_samples(
    parsed: DataFrame, results: DataFrame, pages: DataFrame, samples: DataFrame, limit: int | None = None,
    domain: str = "", include_low_quality: bool = False, content_chars: int | None = None,
) -> DataFrame:
    """Candidates as unlabelled samples, with the page text as content.

    ``limit`` takes only so many of the newest; ``content_chars`` only the first
    characters of a page.  Only the pages of the chosen rows are read; how they are joined follows from their size.
    """
    chosen = sample_candidates(parsed, results, samples, domain, include_low_quality).select(
        "id", "url", "url_hash", "mongo_doc_id", "title", "summary", "search_query", "source_name", "created_at"
    )
    if limit is not None:
        chosen = chosen.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(max(1, limit))
    chosen = cut_lineage(chosen)
    wanted = chosen.select(F.col("mongo_doc_id").alias("page_id")).distinct()
    texts = (
        pages.select(F.col("id").cast("string").alias("page_id"), "html")
        .join(wanted, "page_id", "left_semi")
        .select(
            F.col("page_id").alias("mongo_doc_id"),
            leading(html_to_text(F.col("html")), content_chars).alias("page_text"),
        )
    )
    content = F.coalesce(
        F.nullif("page_text", F.lit("")), F.nullif("summary", F.lit("")), F.nullif("title", F.lit("")), F.lit("")
    )
    return chosen.join(texts, "mongo_doc_id", "left").select(
        F.col("id").alias("parsed_id"), "url", "url_hash", strip_nul(F.col("title")).alias("title"),
        strip_nul(content).alias("content"), strip_nul(F.col("search_query")).alias("search_query"),
        strip_nul(F.col("source_name")).alias("source_name"),
    )


def apply_labels(samples: DataFrame, commands: DataFrame) -> DataFrame:
    """Set labels 0 or 1 from commands (``id``, ``label``, ``labeled_by``, ``at``); others are ignored."""
    last = one_per_key(commands.where(F.col("label").isin(0, 1)), ["id"], ["at"]).select(
        "id", F.col("label").alias("_label"), F.col("labeled_by").alias("_by"), F.col("at").alias("_at")
    )
    hit = F.col("_label").isNotNull()
    values = {"label": "_label", "labeled_by": "_by", "labeled_at": "_at"}
    return samples.join(last, "id", "left").select(
        *[
            F.when(hit, F.col(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in samples.columns
        ]
    )


def delete_samples(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return samples.join(ids.select("id"), "id", "left_anti").select(*samples.columns)


def label_stats(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("label").alias("labeled"),
        F.count_if(F.col("label").isNull()).alias("unlabeled"),
        F.count_if(F.col("label") == 1).alias("relevant"),
        F.count_if(F.col("label") == 0).alias("irrelevant"),
        F.count_if(F.col("labeled_by") == "ai").alias("ai"),
    )


def typed_notices(parsed: DataFrame) -> DataFrame:
    """Number of notices a type classifier can learn from."""
    return parsed.agg(F.count("notice_type").alias("typed"))


def export_training_text(samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines of the supervised text format: label, title three times, body."""
    head = F.coalesce(blank_to_null(strip(F.col("title"))), F.lit(""))
    body = F.coalesce(blank_to_null(leading(strip(F.col("content")), limit)), F.lit(""))
    label = F.when(F.col("label") == 1, F.lit("__label__relevant")).otherwise(F.lit("__label__irrelevant"))
    line = F.concat(label, F.lit(" "), strip(F.concat_ws(" ", head, head, head, body)))
    return (
        samples.where(F.col("label").isNotNull() & ((head != "") | (body != "")))
        .select(F.regexp_replace(line, r"[\r\n]+", " ").alias("value"))
    )


def trainable(samples: DataFrame) -> DataFrame:
    """Labelled samples with some text, and that text as ``model_text``."""
    return (
        samples.where(F.col("label").isin(0, 1))
        .withColumn("model_text", training_input(F.col("title"), F.col("content")))
        .where(F.col("model_text").isNotNull())
    )


def label_balance(samples: DataFrame) -> DataFrame:
    """Class sizes, imbalance ratio, the strategy 'auto' stands for, and whether training may start."""
    ready = trainable(samples)
    relevant, irrelevant = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return ready.agg(
        F.count(F.lit(1)).alias("total"), relevant.alias("relevant"), irrelevant.alias("irrelevant")
    ).withColumns(
        {
            "imbalance_ratio": F.round(
                F.greatest("relevant", "irrelevant")
                / F.greatest(F.least("relevant", "irrelevant"), F.lit(1)), 6,
            ),
            "enough": (F.col("total") >= 20) & (F.least("relevant", "irrelevant") >= 5),
        }
    ).withColumn(
        "strategy",
        F.when(
            F.greatest("relevant", "irrelevant")
            > 3 * F.greatest(F.least("relevant", "irrelevant"), F.lit(1)), F.lit("both"),
        ).otherwise(F.lit("none")),
    )


def split_order(seed: int = SEED, key: str = "url_hash") -> Column:
    """Repeatable random order of samples."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def stratified_split(
    samples: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED, key: str = "url_hash"
) -> DataFrame:
    """Add ``split``: per label the first ``share`` of a hash order (one row at least) is 'val'.

    The exact cut is found without sorting a class: counts per leading digits of
    the order give the group in which the cut lies, and only that group is ranked.
    """
    order = split_order(seed, key)
    slim = samples.select("label", order.alias("_order"), F.left(order, F.lit(SPLIT_DIGITS)).alias("_group"))
    groups = slim.groupBy("label", "_group").agg(F.count(F.lit(1)).alias("n"))
    sizes = (
        groups.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("_group")))
        .withColumn("total", F.sum("n").over(Window.partitionBy("label")))
        .withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("total") * share)))
    )
    edge = sizes.where((F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut"))).select(
        F.col("label").alias("_label"), F.col("_group").alias("_edge"),
        (F.col("cut") - F.col("upto") + F.col("n")).alias("room"),
    )
    inside = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_group") == F.col("_edge"))
    cuts = (
        slim.join(edge, inside)
        .withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("_order")))
        .where("rn <= room")
        .groupBy(F.col("label").alias("_label")).agg(F.max("_order").alias("_cut"))
    )
    # one row per label comes back to the samples
    out = samples.join(cuts, samples["label"].eqNullSafe(cuts["_label"]))
    split = F.when(order <= F.col("_cut"), F.lit("val")).otherwise(F.lit("train"))
    return out.select(*samples.columns, split.alias("split"))


def class_weights(samples: DataFrame) -> DataFrame:
    """Per label: size, sampling weight 1/n and balanced weight total/(2 n)."""
    sizes = samples.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select(
        "label", "n",
        (F.lit(1.0) / F.col("n")).alias("sample_weight"),
        (total / (F.lit(2.0) * F.col("n"))).alias("class_weight"),
    )


def with_balance(samples: DataFrame, strategy: str = "auto", seed: int = SEED) -> DataFrame:
    """Training rows with ``weight`` for a strategy: none, weight, sampler, both or auto.

    The sampler draws about as many rows as there are, with replacement, so that both
    classes contribute alike: a row is repeated n / (2 n_class) times on average, the fraction decided by a
    hash of ``seed`` and ``url_hash``, so the draw is the same on any cluster.
    Weights follow from the sizes before the draw.
    """
    if strategy in (None, "auto"):
        strategy = label_balance(samples).select("strategy").first()[0]
    rows = samples.where(F.col("label").isin(0, 1))
    if strategy not in ("sampler", "both", "weight"):
        return rows.withColumn("weight", F.lit(1.0))
    # one row per label, and there are two labels
    sized = rows.join(F.broadcast(class_weights(rows).select("label", F.col("class_weight").alias("weight"))), "label")
    if strategy in ("sampler", "both"):
        share = F.conv(F.left(split_order(seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
        times = F.floor(F.col("weight")) + (share < F.col("weight") - F.floor("weight")).cast("bigint")
        drawn = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
        sized = sized.withColumn("_draw", drawn).drop("_draw")
    return sized if strategy != "sampler" else sized.withColumn("weight", F.lit(1.0))


def binary_metrics(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; 0 where a denominator is 0."""
    p, t = F.col(prediction), F.col(label)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    counts = scored.agg(
        F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t == 1)).alias("fn"), F.count_if((p == 0) & (t == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        }
    )
    product = 2 * F.col("precision") * F.col("recall")
    return rated.withColumn("f1", ratio(product, F.col("precision") + F.col("recall")))


def uncertain_topk(
    samples: DataFrame, scorer: Callable[[DataFrame], DataFrame], scan: int | None = None, low: float = 0.3,
    high: float = 0.7, take: int = 50, text_chars: int | None = None,
) -> DataFrame:
    """The ``take`` unlabelled samples the model is least sure of; with ``scan``, of the newest so many.

    ``scorer`` adds ``score`` to a frame with ``title`` and ``text``.
    """
    newest = samples.where(F.col("label").isNull())
    if scan is not None:
        newest = newest.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(scan)
    joined = F.concat(
        F.coalesce("title", F.lit("")), F.lit(" [SEP] "), leading(F.coalesce("content", F.lit("")), text_chars)
    )
    text = F.regexp_replace(joined, r"\A[ \[SEP\]]+|[ \[SEP\]]+\z", "")
    scored = scorer(newest.withColumn("text", text))
    return (
        scored.where(F.col("score").between(low, high))
        .withColumn("distance", F.abs(F.col("score") - 0.5))
        .orderBy("distance", "id")
        .limit(take)
        .select(
            "id", F.coalesce("title", F.lit("")).alias("title"), "url",
            F.coalesce("search_query", F.lit("")).alias("search_query"),
            F.coalesce("source_name", F.lit("")).alias("source_name"),
            F.left(F.coalesce("content", F.lit("")), F.lit(500)).alias("content_preview"),
            F.round("score", 4).alias("score"),
        )
    )
