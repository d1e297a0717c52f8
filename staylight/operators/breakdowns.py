"""Outcome rates: headline figures, breakdowns, histograms and risk segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylight.functions import derived as D
from staylight.functions.text import bin_label
from staylight.operators.clean import target_flag
from staylight.spec import PanelSpec

MISSING = "(missing)"


def _rate(left: Column, total: Column) -> Column:
    return F.bround(left / total, 4)


def kpis(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Headline figures of the whole panel, in one row and one pass."""
    left = target_flag(spec) == 1
    income = F.col(spec.income).cast("double")
    lost = F.coalesce(F.sum(F.when(left, income)), F.lit(0.0))

    def mean(column: Column, keep: Column, digits: int) -> Column:
        return F.bround(F.avg(F.when(keep, column)), digits)

    means = {}
    if spec.roles is not None:
        tenure = F.col(spec.roles.years_here).cast("double")
        age = F.col(spec.roles.age).cast("double")
        means = {
            "avg_tenure_left": mean(tenure, left, 1),
            "avg_tenure_stayed": mean(tenure, ~left, 1),
            "avg_age_left": mean(age, left, 1),
            "avg_age_stayed": mean(age, ~left, 1),
        }
    return df.agg(
        F.count("*").alias("employees"),
        F.count_if(left).alias("left"),
        F.count_if(~left).alias("stayed"),
        _rate(F.count_if(left), F.nullif(F.count("*"), F.lit(0))).alias("attrition_rate"),
        F.bround(lost, 0).cast("bigint").alias("monthly_salary_lost"),
        F.bround(lost * D.REPLACEMENT_COST_MONTHS, 0).cast("bigint").alias("replacement_cost"),
        F.lit(D.REPLACEMENT_COST_MONTHS).alias("replacement_cost_months"),
        mean(income, left, 0).cast("bigint").alias("avg_salary_left"),
        mean(income, ~left, 0).cast("bigint").alias("avg_salary_stayed"),
        *(column.alias(name) for name, column in means.items()),
    )


def _category_counts(df: DataFrame, spec: PanelSpec, columns) -> DataFrame:
    """One scan for all columns: every row becomes one (attribute, category) pair per
    column, and the counts are combined within each task before the shuffle."""
    base = df.select(
        target_flag(spec).alias("_left"),
        F.col(spec.income).cast("double").alias("_income"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns),
    )
    pairs = base.unpivot(["_left", "_income"], list(columns), "attribute", "category")
    return pairs.groupBy("attribute", "category").agg(
        F.count("*").alias("total"),
        F.sum("_left").alias("left"),
        F.avg("_income").alias("_avg_income"),
    )


def _declared_rank(spec: PanelSpec, columns) -> Column:
    rank = F.lit(None).cast("int")
    for column in columns:
        if column in spec.orderings:
            known = D.rank_in(spec.orderings[column], F.col("category"))
            rank = F.when(F.col("attribute") == column, known).otherwise(rank)
    return rank


def breakdowns(df: DataFrame, spec: PanelSpec, columns=None) -> DataFrame:
    """Outcome rate per category of every breakdown column.

    ``position`` is the display order inside an attribute: the declared order where
    there is one (undeclared categories follow by name), else rate descending.
    It is numbered over categories, not rows.
    """
    columns = list(columns or spec.breakdowns)
    ordered = [c for c in columns if c in spec.orderings]
    counts = _category_counts(df, spec, columns)
    rated = counts.select(
        "attribute",
        "category",
        "total",
        "left",
        (F.col("total") - F.col("left")).alias("stayed"),
        _rate(F.col("left"), F.col("total")).alias("attrition_rate"),
        F.bround("_avg_income", 0).cast("bigint").alias("avg_salary"),
        _declared_rank(spec, columns).alias("_rank"),
    )
    by_rate = F.when(
        ~F.col("attribute").isin(*ordered) if ordered else F.lit(True),
        F.col("left") / F.col("total"),
    )
    order = W.partitionBy("attribute").orderBy(
        F.col("_rank").asc_nulls_last(), by_rate.desc_nulls_last(), "category"
    )
    attribute = F.col("attribute")
    caption = F.coalesce(
        *(F.when(attribute == c, spec.caption(c)) for c in columns), F.lit("")
    )
    return rated.select(
        "attribute",
        caption.alias("caption"),
        (attribute.isin(*spec.monitor_only) if spec.monitor_only else F.lit(False)).alias(
            "monitor_only"
        ),
        F.row_number().over(order).alias("position"),
        "category",
        "total",
        "left",
        "stayed",
        "attrition_rate",
        "avg_salary",
    )


def histogram(
    df: DataFrame, spec: PanelSpec, column: str, edges, template: str = "{low}-{high}"
) -> DataFrame:
    """Outcome counts per left-closed bin.

    The last bin width is repeated as far as the data reach, so nothing is dropped at
    the top; values under the first edge are left out, and so are empty bins.
    """
    edges = [float(e) for e in edges]
    if len(edges) < 2 or sorted(set(edges)) != edges:
        raise ValueError("edges must be at least two ascending numbers")
    value, top, step = F.col(column).cast("double"), edges[-1], edges[-1] - edges[-2]
    beyond = F.floor((value - top) / step)
    low = F.when(value >= top, F.lit(top) + beyond * step)
    high = F.when(value >= top, F.lit(top) + (beyond + 1) * step)
    for left_edge, right_edge in zip(reversed(edges[:-1]), reversed(edges[1:])):
        low = low.when(value >= left_edge, left_edge)
        high = high.when(value >= left_edge, right_edge)
    binned = df.select(
        low.alias("low"), high.alias("high"), target_flag(spec).alias("_left")
    ).filter(F.col("low").isNotNull())
    counts = binned.groupBy("low", "high").agg(
        F.count("*").alias("total"), F.sum("_left").alias("left")
    )
    return counts.select(
        bin_label(F.col("low"), F.col("high"), template).alias("label"),
        "low",
        "high",
        "total",
        "left",
        (F.col("total") - F.col("left")).alias("stayed"),
        _rate(F.col("left"), F.col("total")).alias("attrition_rate"),
    )


def risk_segments(
    rates: DataFrame, baseline: Column, spec: PanelSpec, min_size: int = 8, top: int = 8
) -> DataFrame:
    """The categories whose rate is furthest above average, from :func:`breakdowns`.

    ``baseline`` is the overall rate: a literal, or ``kpi_frame.select(...).scalar()``.
    """
    order = D.rank_in(spec.breakdowns, F.col("attribute"))
    best = (
        rates.filter(~F.col("monitor_only") & (F.col("total") >= min_size))
        .withColumn("_order", order)
        .orderBy(F.desc("attrition_rate"), "_order", "position")
        .limit(top)
    )
    place = W.orderBy(F.desc("attrition_rate"), "_order", "position")  # at most `top` rows
    return best.select(
        F.row_number().over(place).alias("position"),
        F.concat("caption", F.lit(": "), "category").alias("segment"),
        F.col("total").alias("employees"),
        "attrition_rate",
        D.lift(F.col("attrition_rate"), baseline).alias("lift"),
    )


def overall_rate(df: DataFrame, spec: PanelSpec) -> Column:
    """The panel's outcome rate as a scalar subquery (one row, never a join)."""
    flag = target_flag(spec)
    return df.agg(F.coalesce(F.avg(flag), F.lit(0.0))).scalar()


def roster(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every row with its derived columns, sorted by time here, then id."""
    from staylight.operators.features import engineer

    by = [spec.roles.years_here] if spec.roles else []
    return engineer(df, spec).orderBy(*by, spec.entity_id)
