"""Cell-level cleaning: text and numbers as they arrive in hand-edited exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: Plain and scientific notation only: no type suffixes, no ``Infinity``.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def parsed_number(col: Column) -> Column:
    """The cell as a finite double, or null when it does not hold one."""
    text = stripped(col.cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def number_or_zero(col: Column, numeric: bool) -> Column:
    """Missing, unparseable and non-finite values become 0."""
    value = col.cast("double") if numeric else parsed_number(col)
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(0.0))


def is_yes(col: Column) -> Column:
    """1 for ``yes`` in any letter case, else 0 (also for null)."""
    return F.coalesce((F.lower(col) == "yes").cast("int"), F.lit(0))


def literal_map(mapping: dict, col: Column) -> Column:
    """Look a value up in a small fixed mapping; null when it is not there."""
    if not mapping:
        return F.lit(None)
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    # try_element_at, since looking up a missing key is an error in ANSI mode.
    return F.try_element_at(F.create_map(*entries), col)
