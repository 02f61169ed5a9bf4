"""A learned second opinion for sentences the rules are unsure about."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def add_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Words of two or more characters and their bigrams."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return df.withColumn("__words", words).withColumn(
        "terms", F.concat("__words", T.ngrams(F.col("__words"), 2))).drop("__words")


def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 5000,
                     iterations: int = 500) -> PipelineModel:
    """TF-IDF over words and bigrams, then multinomial logistic regression."""
    rows = add_terms(labelled, text)
    n = labelled.count()
    indexer = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    steps = [
        indexer, CountVectorizer(inputCol="terms", outputCol="__tf", vocabSize=features),
        IDF(inputCol="__tf", outputCol="__tfidf"), Normalizer(inputCol="__tfidf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", maxIter=iterations, regParam=1.0 / max(n, 1)),
        IndexToString(inputCol="__p", outputCol="predicted", labels=indexer.labels),
    ]
    return Pipeline(stages=steps).fit(rows)


def second_opinion(classified: DataFrame, model: PipelineModel, text: str = "text", below: float = 0.5) -> DataFrame:
    """Replace ``label`` by the prediction where the rules were less sure than ``below``."""
    stages = [s for s in model.stages if not hasattr(s, "labelsArray") or s.getOutputCol() == "predicted"]
    rows = add_terms(classified, text)
    for stage in stages:
        rows = stage.transform(rows)
    label = F.when(F.col("label_confidence") < below, F.col("predicted")).otherwise(F.col("label"))
    return rows.withColumn("label", label).select(*classified.columns)
