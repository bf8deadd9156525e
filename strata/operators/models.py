"""Estimators of the screening work on Spark ML, and checked scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20260827


def prior_score(train: DataFrame) -> float:
    """The positive share: what a model has to beat."""
    return float(train.agg(F.avg("label")).first()[0] or 0.0)


def logistic(rows: int, c: float = 1.0) -> Pipeline:
    """Standardised, L2-penalised logistic regression; the penalty is that of ``C`` on ``rows`` rows."""
    return Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1 / (c * max(1, rows)), elasticNetParam=0.0, maxIter=2000, standardization=False),
    ])


def forest(trees: int = 300) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=SEED)])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``score``; a score that is no number in [0, 1] fails the query."""
    s = vector_to_array("probability")[1]
    sane = s.isNotNull() & ~F.isnan(s) & s.between(0, 1)
    return model.transform(rows).withColumn("score", F.when(sane, s).otherwise(F.raise_error(F.lit("score out of range")).cast("double")))
