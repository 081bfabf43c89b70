"""Relevance and notice-type classifiers on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.basics import blank_to_null, leading, strip
from noticeworks.functions.labelling import NOTICE_LABELS, model_input, notice_label, training_input
from noticeworks.operators.samples import binary_metrics, stratified_split, trainable, with_balance
from noticeworks.session import cut_lineage, dealt

TITLE_WEIGHT = 3
NOTICE_ROWS = 5000
MIN_SAMPLES = 10


def weighted_text(title: Column, text: Column, limit: int | None = None) -> Column:
    """Title three times, then the body: the title counts more."""
    head = F.coalesce(blank_to_null(strip(title)), F.lit(""))
    body = F.coalesce(blank_to_null(leading(strip(text), limit)), F.lit(""))
    return strip(F.concat_ws(" ", *([head] * TITLE_WEIGHT), body))


def _counting(features: int) -> list:
    """Character pairs, hashed and counted; no word segmentation needed."""
    return [
        SQLTransformer(
            statement="SELECT *, filter(split(lower(features_text), ''), c -> c NOT IN ('', ' ')) AS _chars FROM __THIS__"
        ),
        NGram(n=2, inputCol="_chars", outputCol="_pairs"),
        HashingTF(inputCol="_pairs", outputCol="_counts", numFeatures=features),
    ]


def _counted(split: DataFrame, features: int) -> DataFrame:
    """``split`` with its pair counts, written once: weights, learner and metrics read them from there."""
    split = dealt(split)
    for stage in _counting(features):
        split = stage.transform(split)
    return cut_lineage(split.drop("features_text", "_chars", "_pairs"))


def _fitted(train: DataFrame, features: int, learner: LogisticRegression, before: tuple = (), after: tuple = ()) -> tuple[PipelineModel, PipelineModel]:
    """(model from texts on, model from counts on), fitted to counted rows."""
    weights = IDF(inputCol="_counts", outputCol="_features", minDocFreq=2).fit(train)
    model = learner.fit(weights.transform(train))
    return PipelineModel([*before, *_counting(features), weights, model, *after]), PipelineModel([weights, model, *after])


def train_relevance(
    samples: DataFrame, balance: str = "auto", features: int = 1 << 16, iterations: int = 20
) -> tuple[PipelineModel, DataFrame]:
    """Relevance classifier and its metrics on held-out samples."""
    ready = cut_lineage(
        trainable(samples).select(
            "url_hash", "label", "title", "content",
            weighted_text(F.col("title"), F.col("content")).alias("features_text"),
        )
    )
    labelled = ready.count()
    if labelled < MIN_SAMPLES:
        raise ValueError(f"{labelled} labelled samples, at least {MIN_SAMPLES} are needed")
    split = _counted(stratified_split(ready), features)
    train = with_balance(split.where(F.col("split") == "train"), balance)
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", maxIter=iterations, regParam=0.01
    )
    model, counted = _fitted(train, features, learner)
    scored = counted.transform(split.where(F.col("split") == "val"))
    metrics = binary_metrics(scored).withColumn("samples", F.lit(labelled))
    return model, metrics


def train_notice_type(
    parsed: DataFrame, features: int = 1 << 16, iterations: int = 20,
    labels: tuple[str, ...] = NOTICE_LABELS, rows: int = NOTICE_ROWS,
) -> tuple[PipelineModel, DataFrame]:
    """Notice-type classifier over title and summary; unknown types count as the last label.

    The number of training rows is a setting of the trainer; the newest rows count.
    """
    typed = parsed.where(F.col("notice_type").isNotNull())
    newest = typed.orderBy(F.col("id").desc()).limit(rows).select(
        "url_hash", notice_label(F.col("notice_type"), labels).alias("label"),
        training_input(F.col("title"), F.col("summary")).alias("features_text"), "title",
    ).where(blank_to_null(strip(F.col("title"))).isNotNull())
    newest = cut_lineage(newest)
    total = newest.count()
    if total < 20:
        raise ValueError(f"{total} typed notices, at least 20 are needed")
    indexer = StringIndexerModel.from_labels(list(labels), inputCol="label", outputCol="_label", handleInvalid="keep")
    learner = LogisticRegression(
        featuresCol="_features", labelCol="_label", family="multinomial", maxIter=iterations, regParam=0.01
    )
    named = IndexToString(inputCol="prediction", outputCol="model_type", labels=[*labels, labels[-1]])
    split = _counted(indexer.transform(stratified_split(newest)), features)
    model, counted = _fitted(split.where(F.col("split") == "train"), features, learner, (indexer,), (named,))
    scored = counted.transform(split.where(F.col("split") == "val"))
    metrics = scored.agg(
        F.count(F.lit(1)).alias("held_out"),
        F.avg((F.col("model_type") == F.col("label")).cast("double")).alias("accuracy"),
    ).withColumn("samples", F.lit(total))
    return model, metrics


def score_text(df: DataFrame, model: PipelineModel, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``score``, the probability of relevance."""
    scored = model.transform(df.withColumn("features_text", weighted_text(F.col(title), F.col(text))))
    return scored.select(
        *df.columns, F.round(vector_to_array("probability")[1], 4).alias("score")
    )


def score_type(df: DataFrame, model: PipelineModel, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``model_type`` and ``type_confidence``."""
    ready = df.withColumn("features_text", training_input(F.col(title), F.col(text))).withColumn(
        "label", F.lit(NOTICE_LABELS[-1])
    )
    scored = model.transform(ready.withColumn("features_text", F.coalesce("features_text", F.lit(""))))
    return scored.select(
        *df.columns, "model_type", F.array_max(vector_to_array("probability")).alias("type_confidence")
    )


def score_with(
    df: DataFrame, predict: Callable[[pd.Series], pd.Series], title: str = "title", text: str = "text"
) -> DataFrame:
    """Add ``score`` from any batch predictor over ``title [SEP] text``, and ``score_error``.

    The predictor works on Arrow batches and must keep their length; a failing
    batch gives NULL scores and what went wrong instead of failing the job.
    """

    @F.pandas_udf("score double, error string")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, error = [None] * len(batch), None
            try:
                found = list(predict(batch))
                if len(found) == len(batch):
                    out = found
                else:
                    error = f"{len(found)} scores for {len(batch)} texts"
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"score": pd.Series(out, dtype="float64"), "error": pd.Series([error] * len(batch), dtype="object")})

    scored = df.withColumn("_scored", scores(model_input(F.col(title), F.col(text))))
    return scored.select(*df.columns, F.col("_scored.score").alias("score"), F.col("_scored.error").alias("score_error"))
