"""Derived numbers and bands, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylight.functions.cells import literal_map

# Probability bands and the advice that goes with each.
RISK_BANDS = (
    (0.00, 0.25, "Low", "Settled. Keep doing what you are doing."),
    (0.25, 0.50, "Moderate", "Worth a check-in at the next one-to-one."),
    (0.50, 0.75, "High", "Book a stay interview this month."),
    (0.75, 1.01, "Critical", "Escalate to HR and the line manager this week."),
)
#: Months of pay it takes to replace somebody.
REPLACEMENT_COST_MONTHS = 6
#: Pay rises tried as counterfactuals.
PAY_RISES = (0.10, 0.20)


def clipped(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def career_share(years_here: Column, total_years: Column) -> Column:
    share = F.when(total_years > 0, years_here / F.nullif(total_years, F.lit(0.0)))
    return F.bround(clipped(F.coalesce(share, F.lit(1.0)), 0, 1), 3)


def promotion_gap(since_change: Column, years_here: Column) -> Column:
    gap = F.when(years_here > 0, since_change / F.nullif(years_here, F.lit(0.0))).otherwise(
        since_change
    )
    return F.bround(clipped(F.coalesce(gap, F.lit(0.0)), 0, 5), 3)


def level_rank(level: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(literal_map(ranks, level), F.lit(1))


def pay_per_level(income: Column, rank: Column) -> Column:
    return F.bround(income / rank.cast("double"), 0)


def tenure_band(years: Column, edges, top: str) -> Column:
    band = F.when(F.lit(False), F.lit(top))
    for upper, label in edges:
        band = band.when(years < upper, label)
    return band.otherwise(top)


def _band_case(probability: Column, position: int) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for band in RISK_BANDS:
        low, high = band[0], band[1]
        case = case.when((probability >= low) & (probability < high), band[position])
    return case.otherwise(RISK_BANDS[-1][position])


def risk_band(probability: Column) -> Column:
    return _band_case(probability, 2)


def risk_advice(probability: Column) -> Column:
    return _band_case(probability, 3)


def rank_in(values, col: Column) -> Column:
    """1-based position of ``col`` in an ordered value list; null when absent."""
    return literal_map({value: i + 1 for i, value in enumerate(values)}, col)


def lift(rate: Column, baseline: Column) -> Column:
    return F.bround(F.coalesce(rate / F.nullif(baseline, F.lit(0.0)), F.lit(0.0)), 2)


def pay_rise(income: Column, rise: Column | float) -> Column:
    """The raised amount, to the nearest hundred."""
    return F.bround(income * (rise + 1.0), -2)


def expected_cost(income: Column, probability: Column) -> Column:
    return income * REPLACEMENT_COST_MONTHS * probability
