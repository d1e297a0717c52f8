"""Evaluation of scores against outcomes: counts, curves, thresholds, metrics.

Scores are compared exactly. Outcomes are first counted per distinct score. The counts are
then laid out once in ranges of scores (:func:`cumulative_counts`, a stage that writes), so
that running totals need one number per range and an order inside each range only: dense
scores get more ranges, and no window grows beyond the rows of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylight.workspace import written

#: The range a tuned threshold may take, and the one without scores.
THRESHOLD_RANGE = (0.15, 0.85)
DEFAULT_THRESHOLD = 0.5
CURVE_LIMIT = 60


def score_counts(df: DataFrame, label: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, threshold, pos, neg``: outcomes per distinct score."""
    return (
        df.select(*keys, F.col(score).cast("double").alias("threshold"), F.col(label).cast("bigint").alias("_y"))
        .groupBy(*keys, "threshold")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def _with_totals_above(df: DataFrame, keys, sums) -> DataFrame:
    """Add ``above_<s>``, the total of ``s`` over all larger scores, and ``all_<s>``.

    ``block`` numbers ranges of rising scores. Totals per block (as few as there were tasks)
    are summed over higher blocks, rows over the higher ones of their own block.
    """
    higher = W.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = df.groupBy(*keys, "block").agg(*(F.sum(s).alias(s) for s in sums))
    totals = totals.select(
        *keys, "block",
        *(F.coalesce(F.sum(s).over(higher), F.lit(0)).alias(f"above_{s}") for s in sums),
        *(F.sum(s).over(whole).alias(f"all_{s}") for s in sums),
    )
    above = W.partitionBy(*keys, "block").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, -1)
    inside = df.withColumns({f"_in_{s}": F.coalesce(F.sum(s).over(above), F.lit(0)) for s in sums})
    return inside.join(totals, [*keys, "block"]).withColumns(
        {f"above_{s}": F.col(f"above_{s}") + F.col(f"_in_{s}") for s in sums}
    ).drop(*(f"_in_{s}" for s in sums))


def cumulative_counts(
    df: DataFrame, label: str, score: str, keys: tuple[str, ...] = (), blocks: int | None = None
) -> DataFrame:
    """True and false positives when everything at or above each score is flagged.

    Per distinct score: ``position`` (1 = highest), ``threshold``, ``pos``, ``neg``,
    ``tp``, ``fp``, the totals ``positives``, ``negatives``, ``scores_n``, and the ``block`` it lies in.

    A stage: calling it runs the job that produces the scores and writes their counts to
    the shared folder. They are read several times below, and a block is only a lasting
    range of scores once it is written. ``blocks`` sets their number, which changes no figure.
    """
    counts = score_counts(df, label, score, keys)
    order = [*keys, "threshold"]
    ranged = counts.repartitionByRange(blocks, *order) if blocks else counts.repartitionByRange(*order)
    placed = written(ranged.withColumn("block", F.spark_partition_id()), "score-counts")
    counts = placed.withColumn("one", F.lit(1).cast("bigint"))
    summed = _with_totals_above(counts, list(keys), ["pos", "neg", "one"])
    return summed.select(
        *keys,
        (F.col("above_one") + 1).alias("position"),
        "threshold",
        "block",
        "pos",
        "neg",
        (F.col("above_pos") + F.col("pos")).alias("tp"),
        (F.col("above_neg") + F.col("neg")).alias("fp"),
        F.col("all_pos").alias("positives"),
        F.col("all_neg").alias("negatives"),
        F.col("all_one").alias("scores_n"),
    )


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def ranking_metrics(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC and average precision (the step sum) from :func:`cumulative_counts`."""
    below = F.col("negatives") - F.col("fp") + F.col("neg") / 2
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    pairs = F.max("positives").cast("double") * F.max("negatives")
    return curve.groupBy(*keys).agg(
        _over(F.sum(F.col("pos") * below), pairs).alias("roc_auc"),
        _over(F.sum(F.col("pos") * precision), F.max("positives")).alias("pr_auc"),
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(_over(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The score with the best F1 (the lowest on ties), clipped and rounded.

    One row: ``raw_threshold`` (null without scores), ``best_f1`` and ``threshold``.
    """
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp"))
    low, high = THRESHOLD_RANGE
    best = curve.agg(
        F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("raw_threshold"),
        F.max(f1).alias("best_f1"),
    )
    inside = F.least(F.greatest("raw_threshold", F.lit(low)), F.lit(high))
    return best.withColumn(
        "threshold",
        F.when(F.col("raw_threshold").isNull(), DEFAULT_THRESHOLD).otherwise(F.bround(inside, 3)),
    )


def roc_points(curve: DataFrame) -> DataFrame:
    """``point, points_n, x, y``: the ROC curve from (0, 0), without the points that lie
    on the line between their neighbours.

    An interior point lies on that line exactly when the next score adds the same
    counts, so each row only has to see the next one; rows meet by position.
    """
    following = curve.select(
        (F.col("position") - 1).alias("position"),
        F.col("pos").alias("_next_pos"),
        F.col("neg").alias("_next_neg"),
    )
    bend = (F.col("pos") != F.col("_next_pos")) | (F.col("neg") != F.col("_next_neg"))
    kept = (
        curve.join(following, "position", "left")
        .filter((F.col("position") == 1) | F.col("_next_pos").isNull() | bend)
        .select("position", "threshold", "block", "tp", "fp", "positives", "negatives")
        .withColumn("one", F.lit(1).cast("bigint"))
    )
    numbered = _with_totals_above(kept, [], ["one"])
    x = _over(F.col("fp"), F.col("negatives"))
    y = _over(F.col("tp"), F.col("positives"))
    point = F.struct((F.col("above_one") + 1).alias("point"), x.alias("x"), y.alias("y"))
    origin = F.struct(
        F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
    )
    rows = F.when(F.col("position") == 1, F.array(origin, point)).otherwise(F.array(point))
    return numbered.select((F.col("all_one") + 1).alias("points_n"), F.inline(rows)).select(
        "point", "points_n", "x", "y"
    )


def pr_points(curve: DataFrame) -> DataFrame:
    """``point, points_n, x, y``: recall and precision by rising score, then (0, 1)."""
    recall = _over(F.col("tp"), F.col("positives"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    point = F.struct(
        (F.col("scores_n") - F.col("position")).alias("point"),
        recall.alias("x"),
        precision.alias("y"),
    )
    end = F.struct(F.col("scores_n").alias("point"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    rows = F.when(F.col("position") == 1, F.array(point, end)).otherwise(F.array(point))
    return curve.select((F.col("scores_n") + 1).alias("points_n"), F.inline(rows)).select(
        "point", "points_n", "x", "y"
    )


def thinned(points: DataFrame, limit: int = CURVE_LIMIT) -> DataFrame:
    """At most ``limit`` points at evenly spaced positions, ends included, 4 decimals."""
    point, last = F.col("point"), F.col("points_n") - 1
    step = last / float(limit - 1)
    near = F.floor(point / step)
    hit = F.exists(
        F.array(near - 1, near, near + 1, near + 2),
        lambda i: i.between(0, limit - 1)
        & (F.when(i == limit - 1, last).otherwise(F.floor(i * step)) == point),
    )
    kept = points.filter((F.col("points_n") <= limit) | hit)
    return kept.select("point", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"))


def confusion(df: DataFrame, label: str, score: str, threshold) -> DataFrame:
    """True/false negatives/positives at a threshold, in one row."""
    flagged, actual = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(
        F.count_if(~actual & ~flagged).alias("true_negative"),
        F.count_if(~actual & flagged).alias("false_positive"),
        F.count_if(actual & ~flagged).alias("false_negative"),
        F.count_if(actual & flagged).alias("true_positive"),
    )


def decision_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from :func:`confusion`; 0 where undefined."""
    tn, fp = F.col("true_negative"), F.col("false_positive")
    fn, tp = F.col("false_negative"), F.col("true_positive")

    def share(a: Column, b: Column) -> Column:
        return F.bround(F.coalesce(_over(a, b), F.lit(0.0)), 4)

    return matrix.select(
        share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        F.bround(f1_of(tp, fp, fn), 4).alias("f1"),
    )


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    miss = F.col(score) - F.col(label)
    return df.agg(F.avg(miss * miss).alias("brier"))


def score_block(
    df: DataFrame, label: str, score: str, threshold, curve: DataFrame | None = None
) -> DataFrame:
    """All seven quality figures in one row, 4 decimals. ``curve`` saves counting again."""
    curve = cumulative_counts(df, label, score) if curve is None else curve
    ranking = ranking_metrics(curve).select(F.struct("roc_auc", "pr_auc")).scalar()
    miss = brier(df, label, score).scalar()
    return (
        decision_metrics(confusion(df, label, score, threshold))
        .withColumn("_ranking", ranking)
        .select(
            "accuracy", "precision", "recall", "f1",
            F.bround("_ranking.roc_auc", 4).alias("roc_auc"),
            F.bround("_ranking.pr_auc", 4).alias("pr_auc"),
            F.bround(miss, 4).alias("brier"),
        )
    )
