"""Results and fitted models on disk, one table per part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from staylight.operators.scoring import FittedScorer
from staylight.plans.training import Trained
from staylight.spec import PanelSpec

_FACTS_TYPE = (
    "threshold double, model_label string, trained_at string, columns array<string>, "
    "typical_text map<string,string>, typical_number map<string,double>"
)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each result table to ``folder/<name>``, replacing an earlier one."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def metric_tables(trained: Trained) -> dict[str, DataFrame]:
    return {
        "card": trained.card,
        "leaderboard": trained.leaderboard,
        "curve_points": trained.curve_points,
        "confusion": trained.confusion,
        "importance": trained.importance,
    }


@dataclass(frozen=True)
class Artifact:
    """A saved model with everything needed to score and explain."""

    scorer: FittedScorer
    threshold: float
    typical: dict[str, object]
    columns: list[str]
    trained_at: str


def save_model(trained: Trained, folder: str) -> None:
    """The fitted pipeline, and beside it one row of facts."""
    trained.model.write().overwrite().save(f"{folder}/pipeline")
    spec = trained.spec
    text = {c: trained.typical[c] for c in spec.model_categoricals}
    number = {c: trained.typical[c] for c in spec.model_numerics}
    row = (trained.threshold, trained.label, trained.trained_at, trained.columns, text, number)
    facts = trained.card.sparkSession.createDataFrame([row], _FACTS_TYPE)
    facts.write.mode("overwrite").parquet(f"{folder}/facts")


def load_model(spark: SparkSession, folder: str, spec: PanelSpec) -> Artifact:
    facts = spark.read.schema(_FACTS_TYPE).parquet(f"{folder}/facts").first()
    if list(facts.columns) != list(spec.model_columns):
        raise ValueError("the saved model was trained on other columns than this spec has")
    pipeline = PipelineModel.load(f"{folder}/pipeline")
    return Artifact(
        scorer=FittedScorer(facts.model_label, pipeline),
        threshold=facts.threshold,
        typical={**facts.typical_text, **facts.typical_number},
        columns=list(facts.columns),
        trained_at=facts.trained_at,
    )
