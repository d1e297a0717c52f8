"""Permutation importance: shuffle one column, see how far the ROC-AUC falls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.operators.curves import cumulative_counts, ranking_metrics
from staylight.operators.ordering import shuffle_key, with_positions
from staylight.operators.scoring import Scorer
from staylight.spec import PanelSpec

#: How many features the ranking keeps, and the usual repeats.
TOP_FEATURES = 12
REPEATS = 30


def shuffled_auc(
    frame: DataFrame, spec: PanelSpec, label: str, scorer: Scorer, repeats: int, seed: int = 42
) -> DataFrame:
    """``feature, repeat, roc_auc`` with that feature's column shuffled.

    One shuffle per repeat serves all columns: row ``i`` of one random order lends its
    values to row ``i`` of another, and every column is swapped on its own. So the rows
    move once per repeat, not once per repeat and column.
    """
    key, columns = spec.entity_id, list(spec.model_columns)
    frame = frame.select(key, label, *columns)
    receivers = with_positions(
        frame.withColumn("_key", shuffle_key(F.col(key), F.lit(seed))), [], "_key", key
    ).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    donors = frame.select(key, F.struct(*columns).alias("_donor")).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    donors = with_positions(
        donors.withColumn("_key", shuffle_key(F.col(key), F.lit(seed), F.lit("swap"), F.col("repeat"))),
        ["repeat"], "_key", key,
    ).select("repeat", "position", "_donor")
    # Merged, as either side holds the whole table once per repeat: a broadcast would pass it through the driver.
    paired = receivers.drop("_key").join(donors.hint("merge"), ["repeat", "position"])
    swapped = paired.withColumn("feature", F.explode(F.array(*(F.lit(c) for c in columns)))).select(
        "feature",
        "repeat",
        label,
        *(
            F.when(F.col("feature") == c, F.col(f"_donor.{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ),
    )
    curve = cumulative_counts(scorer.score(swapped), label, "probability", ("feature", "repeat"))
    return ranking_metrics(curve, ("feature", "repeat")).select("feature", "repeat", "roc_auc")


def feature_importance(
    frame: DataFrame, spec: PanelSpec, label: str, scorer: Scorer,
    repeats: int = REPEATS, seed: int = 42,
) -> DataFrame:
    """``feature, importance, std`` for every model column (see :func:`top_features`)."""
    own = ranking_metrics(cumulative_counts(scorer.score(frame), label, "probability"))
    base = own.select("roc_auc").scalar()
    drops = shuffled_auc(frame, spec, label, scorer, repeats, seed)
    return (
        drops.groupBy("feature")
        .agg(F.avg("roc_auc").alias("_mean"), F.stddev_pop("roc_auc").alias("_std"))
        .select(
            "feature",
            F.bround(base - F.col("_mean"), 5).alias("importance"),
            F.bround("_std", 5).alias("std"),
        )
    )


def top_features(importance: DataFrame, limit: int = TOP_FEATURES) -> DataFrame:
    """The features that matter, most important first."""
    return (
        importance.filter(F.col("importance") > 0)
        .orderBy(F.desc("importance"), "feature")
        .limit(limit)
    )
