"""Preprocessing and the competing estimators, on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.operators.clean import assert_modelled_columns
from staylight.spec import PanelSpec

WEIGHT = "class_weight"


@dataclass(frozen=True)
class Candidate:
    key: str
    label: str
    rationale: str
    #: (training rows, seed) -> unfitted estimator
    estimator: Callable[[int, int], Estimator]
    balanced: bool
    #: Whether all fits of a cross-validation are solved together over shared scans.
    shared_scans: bool = False


def candidates(trees: int = 300, boosting_rounds: int = 120) -> list[Candidate]:
    """The three competitors, from most explainable to most powerful."""

    # Regularisation, depths, leaf sizes, rates and iteration limits.
    def logistic(rows: int, seed: int) -> Estimator:
        # Spark divides the loss by the total weight, so C = 0.5 is regParam 1 / (0.5 n).
        return LogisticRegression(
            regParam=1.0 / (0.5 * rows), elasticNetParam=0.0, standardization=False,
            maxIter=5000, tol=1e-8, weightCol=WEIGHT,
        )

    def forest(rows: int, seed: int) -> Estimator:
        return RandomForestClassifier(
            numTrees=trees, maxDepth=4, minInstancesPerNode=3,
            featureSubsetStrategy="sqrt", weightCol=WEIGHT, seed=seed,
        )

    def boosting(rows: int, seed: int) -> Estimator:
        return GBTClassifier(
            maxIter=boosting_rounds, stepSize=0.05, maxDepth=2, minInstancesPerNode=4,
            subsamplingRate=0.9, seed=seed,
        )

    # Keys, names and the texts shown beside them.
    return [
        Candidate(
            "logistic_regression", "Logistic Regression",
            "Transparent linear baseline - every feature gets a readable weight.",
            logistic, True, shared_scans=True,
        ),
        Candidate(
            "random_forest", "Random Forest",
            "Hundreds of shallow decision trees voting together.",
            forest, True,
        ),
        Candidate(
            "gradient_boosting", "Gradient Boosting",
            "Trees built in sequence, each correcting the last one's mistakes.",
            boosting, False,
        ),
    ]


def _indexed(c: str) -> str:
    return f"{c}__index"


def _hot(c: str) -> str:
    return f"{c}__hot"


#: Vector columns of an encoded frame: one-hot categories, and raw numbers.
CATEGORIES, NUMBERS = "categories", "numbers"


def fit_encoder(frame: DataFrame, spec: PanelSpec) -> PipelineModel:
    """One-hot encoding of the model categoricals, and the numerics as one vector.

    Every known category has its own slot; unseen and missing ones are all zeros.
    """
    columns = list(spec.model_categoricals)
    assert_modelled_columns(columns, spec)
    indexer = StringIndexer(
        inputCols=columns, outputCols=[_indexed(c) for c in columns],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    )
    # The extra "unknown" index is the last one, and the last one gets no slot.
    encoder = OneHotEncoder(
        inputCols=[_indexed(c) for c in columns], outputCols=[_hot(c) for c in columns],
        dropLast=True,
    )
    categories = VectorAssembler(inputCols=[_hot(c) for c in columns], outputCol=CATEGORIES)
    numbers = VectorAssembler(inputCols=list(spec.model_numerics), outputCol=NUMBERS)
    return Pipeline(stages=[indexer, encoder, categories, numbers]).fit(frame)


def fit_scaler(encoded: DataFrame, rows: int) -> tuple[StandardScalerModel, ElementwiseProduct]:
    """Standardise the numbers by mean and *population* deviation; constants become 0.

    The stock scaler divides by the sample deviation, a product by a constant corrects
    that. Both keep their figures in vectors, so the compiled code is the same for every
    fit.
    """
    scaler = StandardScaler(
        inputCol=NUMBERS, outputCol="centred", withMean=True, withStd=True
    ).fit(encoded)
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    correction = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * scaler.mean.size),
        inputCol="centred", outputCol="scaled",
    )
    return scaler, correction


def scaling_figures(
    scaler: StandardScalerModel, correction: ElementwiseProduct, spec: PanelSpec
) -> list[tuple[str, float, float]]:
    """``(column, mean, population deviation)`` that a fitted scaling works with."""
    factors = correction.getScalingVec().toArray()
    deviations = scaler.std.toArray() / factors
    return [
        (c, float(m), float(d))
        for c, m, d in zip(spec.model_numerics, scaler.mean.toArray(), deviations)
    ]


@dataclass(frozen=True)
class FittedStages:
    """Scaling, assembly and the estimator, fitted on one set of rows."""

    stages: tuple[Transformer, ...]

    def transform(self, encoded: DataFrame) -> DataFrame:
        for stage in self.stages:
            encoded = stage.transform(encoded)
        return encoded


def fit_stages(
    encoded: DataFrame, spec: PanelSpec, label: str, candidate: Candidate, seed: int = 42,
    totals: tuple[int, float] | None = None,
) -> FittedStages:
    """Fit a candidate on encoded rows; means and class weights come from these rows only.
    ``totals``: the number of rows and of positive ones, where the caller has counted them."""
    if totals is None:
        totals = encoded.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    rows, yes = totals[0], totals[1] or 0.0
    if not 0 < yes < rows:
        raise ValueError("training rows need both outcomes")
    scaler, correction = fit_scaler(encoded, rows)
    assemble = VectorAssembler(inputCols=[CATEGORIES, "scaled"], outputCol="features")
    ready = FittedStages((scaler, correction, assemble)).transform(encoded)
    columns = [F.col(label).cast("double").alias(label), F.col("features")]
    if candidate.balanced:
        weight = F.when(F.col(label) == 1, rows / (2 * yes)).otherwise(rows / (2 * (rows - yes)))
        columns.append(weight.alias(WEIGHT))
    estimator = candidate.estimator(rows, seed).copy()
    model = estimator.setLabelCol(label).setFeaturesCol("features").fit(ready.select(*columns))
    _drop_summary(model)
    return FittedStages((scaler, correction, assemble, model))


def _drop_summary(model: Transformer) -> None:
    """Take the training summary off a fitted model. It holds the session, which travels with the model into every
    task that scores, and which cannot be serialised any more once anything in it has been observed (a log
    entry's totals are)."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())


def as_pipeline(encoder: PipelineModel, fitted: FittedStages) -> PipelineModel:
    """Encoding, scaling, assembly and model as one object that saves and loads whole."""
    return PipelineModel(stages=[*encoder.stages, *fitted.stages])
