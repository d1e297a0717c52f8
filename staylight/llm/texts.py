"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def plain_text(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case in which no other character turns into an ASCII letter.

    The Kelvin sign is the one character outside ASCII whose lower case is an ASCII
    letter by itself, so it is put aside first."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ķ")))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and the named columns: whatever else a table carries
    cannot clash with names used inside an operator."""
    return docs.select("doc_id", plain_text().alias("text"), *columns)


def same_row(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    """Equality of key columns in which missing values are equal."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
