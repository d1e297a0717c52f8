"""From a panel to probabilities, bands, decisions and the money at stake."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.functions import derived as D
from staylight.operators.features import engineer
from staylight.spec import PanelSpec


class Scorer(Protocol):
    label: str

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``probability`` to a frame that has the model columns."""


def _points(value: Column, table: Mapping[str, float]) -> Column:
    case = F.lit(0.0)
    for category, points in table.items():
        case = F.when(value == category, F.lit(float(points))).otherwise(case)
    return case


@dataclass(frozen=True)
class Scorecard:
    """A fixed logistic score: points per category, and slopes on standardised numbers.

    Categories that are not listed score nothing. It is a plain Column expression, so
    scoring stays inside code generation.
    """

    label: str
    intercept: float
    points: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    #: column -> (centre, scale, weight)
    slopes: Mapping[str, tuple[float, float, float]] = field(default_factory=dict)

    def probability(self) -> Column:
        z = F.lit(float(self.intercept))
        for column, table in self.points.items():
            z = z + _points(F.col(column), table)
        for column, (centre, scale, weight) in self.slopes.items():
            z = z + (F.col(column) - centre) / scale * weight
        return 1.0 / (1.0 + F.exp(-z))

    def score(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("probability", self.probability())


@dataclass(frozen=True)
class FittedScorer:
    """A fitted Spark ML pipeline."""

    label: str
    model: PipelineModel

    def score(self, frame: DataFrame) -> DataFrame:
        scored = self.model.transform(frame)
        second = vector_to_array(F.col("probability"))[1].alias("probability")
        return scored.select(*frame.columns, second)


def score(df: DataFrame, spec: PanelSpec, scorer: Scorer) -> DataFrame:
    """Engineer and score a cleaned panel: all columns, derived ones and ``probability``.

    A narrow transformation: no shuffle at any table size.
    """
    return scorer.score(engineer(df, spec))


def with_decision(scored: DataFrame, spec: PanelSpec, threshold: float) -> DataFrame:
    """Add flag, band, advice, percent and expected cost, all from the exact probability."""
    p = F.col("probability")
    return scored.withColumns(
        {
            "percent": F.bround(p * 100, 1),
            "will_leave": p >= threshold,
            "threshold": F.lit(float(threshold)),
            "risk_band": D.risk_band(p),
            "advice": D.risk_advice(p),
            "cost_at_risk": F.bround(D.expected_cost(F.col(spec.income).cast("double"), p), 0).cast(
                "bigint"
            ),
        }
    )


def flagged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("probability") >= threshold)


def banded(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """Label scores from a band table ``(low, high, band, advice)``.

    Band edges and not rows decide the size of this join: each row meets the one band
    that holds it. A score outside every band takes the highest one.
    """
    ordered = bands.agg(F.sort_array(F.collect_list(F.struct("low", "high", "band", "advice"))))
    table = scored.withColumn("_bands", ordered.scalar())
    inside = F.filter(
        "_bands", lambda b: (b["low"] <= F.col("probability")) & (F.col("probability") < b["high"])
    )
    chosen = F.coalesce(F.get(inside, F.lit(0)), F.try_element_at("_bands", F.lit(-1)))
    return table.withColumns({"risk_band": chosen["band"], "advice": chosen["advice"]}).drop("_bands")


def ranked_batch(scored: DataFrame, spec: PanelSpec, threshold: float, row: Column) -> DataFrame:
    """The batch report: input row number, id, context, score; highest risk first."""
    roles = spec.roles
    context = [roles.job, roles.group, roles.years_here] if roles else list(spec.form_fields)
    decided = with_decision(scored.withColumn("row", row), spec, threshold)
    return decided.select(
        "row",
        spec.entity_id,
        *dict.fromkeys([*context, spec.income]),
        F.bround("probability", 4).alias("probability"),
        "percent",
        "risk_band",
        "will_leave",
        F.col("probability").alias("_exact"),
    ).orderBy(F.desc("_exact"), spec.entity_id).drop("_exact")


def batch_summary(scored: DataFrame, spec: PanelSpec, threshold: float) -> DataFrame:
    p = F.col("probability")
    cost = F.sum(D.expected_cost(F.col(spec.income).cast("double"), p))
    share = F.count_if(p >= threshold) / F.nullif(F.count("*"), F.lit(0))
    return scored.agg(
        F.count("*").alias("count"),
        F.count_if(p >= threshold).alias("flagged"),
        F.bround(F.coalesce(share, F.lit(0.0)), 4).alias("flagged_share"),
        F.bround(F.coalesce(cost, F.lit(0.0)), 0).cast("bigint").alias("cost_at_risk"),
        F.lit(float(threshold)).alias("threshold"),
    )
