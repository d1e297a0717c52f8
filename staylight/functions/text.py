"""Number formatting for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sign printed before amounts.
CURRENCY_SIGN = "₹"
LAKH = 100_000
CRORE = 10_000_000


def _grouped(digits: Column) -> Column:
    """``1250000`` -> ``12,50,000``: the last three digits, then pairs."""
    head = F.substr(digits, F.lit(1), F.length(digits) - 3)
    return F.when(F.length(digits) <= 3, digits).otherwise(
        F.concat(
            F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), F.right(digits, F.lit(3))
        )
    )


def indian_amount(amount: Column) -> Column:
    """Whole amount with Indian digit grouping, e.g. ``₹12,50,000``."""
    whole = F.bround(amount, 0).cast("decimal(38,0)")
    sign = F.when(whole < 0, "-").otherwise("")
    return F.concat(F.lit(CURRENCY_SIGN), sign, _grouped(F.abs(whole).cast("string")))


def _scaled(whole: Column, unit: int, decimals: int, suffix: str) -> Column:
    """``whole / unit`` as text, without decimals when it divides evenly."""
    # decimal(20,0) leaves room for every digit of the quotient.
    exact = whole.cast("decimal(20,0)") / F.lit(unit)
    text = F.when(whole % unit == 0, exact.cast("decimal(20,0)").cast("string")).otherwise(
        F.round(exact, decimals).cast(f"decimal(22,{decimals})").cast("string")
    )
    return F.concat(F.lit(CURRENCY_SIGN), text, F.lit(suffix))


def short_amount(amount: Column) -> Column:
    """Compact amount in crore or lakh, e.g. ``₹8.24 Cr``, ``₹1.3 L``."""
    # Halves go up, also below zero: floor(x + 0.5).
    whole = F.floor(F.coalesce(amount.cast("double"), F.lit(0.0)) + 0.5).cast("decimal(38,0)")
    return (
        F.when(F.abs(whole) >= CRORE, _scaled(whole, CRORE, 2, " Cr"))
        .when(F.abs(whole) >= LAKH, _scaled(whole, LAKH, 1, " L"))
        .otherwise(indian_amount(whole))
    )


def whole_percent(rate: Column) -> Column:
    """``0.5625`` -> ``56%``; halves go to the even number."""
    return F.concat(F.bround(rate * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def bin_label(low: Column, high: Column, template: str) -> Column:
    """Fill ``{low}`` and ``{high}`` with whole-number bin edges."""
    pattern = template.replace("%", "%%").replace("{low}", "%1$d").replace("{high}", "%2$d")
    return F.format_string(pattern, low.cast("bigint"), high.cast("bigint"))
