"""Sentences that are only published when the figures support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.functions.text import indian_amount, whole_percent
from staylight.operators.breakdowns import breakdowns, kpis
from staylight.spec import PanelSpec, RateClaim


def _entry(position: int, title: str, detail: Column, holds: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(title).alias("title"),
        detail.alias("detail"),
        F.coalesce(holds, F.lit(False)).alias("holds"),
    )


def headlines(
    df: DataFrame, spec: PanelSpec, rates: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """``position, title, detail`` of every claim whose comparison holds. ``rates`` and ``totals`` are the
    breakdowns and KPIs of ``df`` where they are stored already.

    The rates are picked out of the breakdown table in one aggregate, next to the
    one-row KPI table; a claim about an absent category does not hold.
    """
    fields = list(dict.fromkeys(c.field for c in spec.claims if isinstance(c, RateClaim)))

    def rate(field: str, category: str) -> Column:
        hit = (F.col("attribute") == field) & (F.col("category") == category)
        return F.max(F.when(hit, F.col("attrition_rate")))

    picked = []
    for i, claim in enumerate(spec.claims):
        if isinstance(claim, RateClaim):
            picked.append(rate(claim.field, claim.worse).alias(f"worse_{i}"))
            picked.append(rate(claim.field, claim.better).alias(f"better_{i}"))
    totals = kpis(df, spec) if totals is None else totals
    figures = totals.select(F.struct("*")).scalar().alias("kpi")
    if fields:
        rates = breakdowns(df, spec, fields) if rates is None else rates
        facts = rates.agg(*picked).select("*", figures)
    else:
        facts = totals.select(F.struct("*").alias("kpi"))

    entries = []
    for i, claim in enumerate(spec.claims):
        if isinstance(claim, RateClaim):
            worse, better = F.col(f"worse_{i}"), F.col(f"better_{i}")
            detail = F.format_string(claim.detail, whole_percent(worse), whole_percent(better))
            holds = worse > better
        elif claim.kind == "pay_gap":
            gone, here = F.col("kpi.avg_salary_left"), F.col("kpi.avg_salary_stayed")
            detail = F.format_string(
                claim.detail, indian_amount(gone), indian_amount(here), indian_amount(here - gone)
            )
            holds = gone < here
        else:
            detail = F.format_string(
                claim.detail,
                F.col("kpi.left").cast("string"),
                indian_amount(F.col("kpi.monthly_salary_lost")),
                F.col("kpi.replacement_cost_months").cast("string"),
                indian_amount(F.col("kpi.replacement_cost")),
            )
            holds = F.lit(True)
        entries.append(_entry(i + 1, claim.title, detail, holds))
    rows = facts.select(F.inline(F.array(*entries)))
    return rows.filter("holds").drop("holds")
