"""The typical entity: median of every number, most common value of every category.

Both are exact at any size. ``percentile`` would gather all distinct values of a
column in one task, so medians are found by narrowing: count values in equal-width
bins, keep the bin that holds the middle, repeat until it holds one value. The method
is the same at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylight.spec import PanelSpec

_BINS = 512


def modes(df: DataFrame, columns) -> DataFrame:
    """``field, value``: the most common non-null value, the smallest on ties."""
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    counts = texts.unpivot([], list(columns), "field", "value").dropna().groupBy("field", "value").count()
    best = F.min_by("value", F.struct(-F.col("count"), F.col("value")))
    return counts.groupBy("field").agg(best.alias("value"))


def _narrowed(df: DataFrame, brackets: dict) -> dict:
    """One round: split every open bracket into bins and keep the one with the target.

    A bracket is (low, high, rows below low, rows inside). Only bin counts, at most
    ``_BINS`` per target, come back to the driver. Targets of a column that share a bracket (the middle
    two mostly do to the end) are counted once, under the first one's rank.
    """
    shared: dict[tuple, list[int]] = {}
    for (column, rank), (low, high, below, _) in brackets.items():
        shared.setdefault((column, low, high, below), []).append(rank)
    targets = {(column, ranks[0]): ranks for (column, *_), ranks in shared.items()}
    counts = []
    for (column, low, high, _), (rank, *_) in shared.items():
        value = F.col(column)
        width = (high - low) / _BINS
        number = F.least(F.floor((value - low) / width), F.lit(_BINS - 1)).cast("int")
        bin_no = F.when(value.between(low, high), number)
        counts.append(
            F.struct(F.lit(column).alias("field"), F.lit(rank).alias("rank"), bin_no.alias("bin"),
                     value.alias("value"))
        )
    rows = (
        df.select(F.inline(F.array(*counts)))
        .filter("bin IS NOT NULL")
        .groupBy("field", "rank", "bin")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .orderBy("field", "rank", "bin")
        .collect()
    )
    out = {}
    for row in rows:
        for rank in targets[(row.field, row.rank)]:
            key = (row.field, rank)
            below = out.get(key, (None, None, brackets[key][2], None))
            if below[0] is not None:
                continue
            if rank < below[2] + row.n:
                out[key] = (row.low, row.high, below[2], row.n)
            else:
                out[key] = (None, None, below[2] + row.n, None)
    return out


def medians(df: DataFrame, columns) -> dict[str, float | None]:
    """The exact median of every column (the mean of the middle two for even counts).

    A round leaves at most one 512th of a bracket's width, so seven or eight rounds settle any
    doubles. A bracket as narrow as some neighbouring doubles is finished by counting those.
    """
    numbers = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    stats = numbers.agg(
        *(F.count(c).alias(f"n_{c}") for c in columns),
        *(F.min(c).alias(f"low_{c}") for c in columns),
        *(F.max(c).alias(f"high_{c}") for c in columns),
    ).first()
    brackets, found = {}, {}
    for c in columns:
        n = stats[f"n_{c}"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            brackets[(c, rank)] = (stats[f"low_{c}"], stats[f"high_{c}"], 0, n)
    while True:
        for key, (low, high, _, _) in list(brackets.items()):
            # A range too narrow to split by arithmetic has only neighbouring doubles.
            if low == high:
                found[key] = brackets.pop(key)[0]
        wide = {
            k: b for k, b in brackets.items()
            if (b[1] - b[0]) / _BINS > math.ulp(max(abs(b[0]), abs(b[1])))
        }
        if not wide:
            break
        brackets.update(_narrowed(numbers, wide))
    if brackets:
        found.update(_settled(numbers, brackets))
    out = {}
    for c in columns:
        values = [v for (name, _), v in found.items() if name == c]
        out[c] = sum(values) / len(values) if values else None
    return out


def _settled(df: DataFrame, brackets: dict) -> dict:
    """Pick each target by counting the few distinct values its bracket holds."""
    entries = [
        F.when(
            F.col(column).between(low, high),
            F.struct(
                F.lit(column).alias("field"),
                F.lit(rank).cast("bigint").alias("rank"),
                F.lit(below).cast("bigint").alias("below"),
                F.col(column).alias("value"),
            ),
        )
        for (column, rank), (low, high, below, _) in brackets.items()
    ]
    inside = df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    counts = inside.groupBy("field", "rank", "below", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("field", "rank").orderBy("value"))
    picked = (
        counts.withColumn("upto", F.col("below") + upto)
        .filter(F.col("rank") < F.col("upto"))
        .groupBy("field", "rank")
        .agg(F.min("value").alias("value"))
    )
    return {(r.field, r.rank): r.value for r in picked.collect()}


def typical_entity(frame: DataFrame, spec: PanelSpec) -> dict[str, object]:
    """``column -> typical value`` over the model columns of ``frame``.

    Reads ``frame`` three times or more; pass a stored table when it is costly to derive.
    """
    out = {r.field: r.value for r in modes(frame, spec.model_categoricals).collect()}
    out |= medians(frame, spec.model_numerics)
    return {c: out.get(c) for c in spec.model_columns}


def typical_table(frame: DataFrame, spec: PanelSpec) -> DataFrame:
    """:func:`typical_entity` as ``field, kind, text, number`` rows."""
    typical = typical_entity(frame, spec)
    rows = [
        (c, "category", typical[c], None) if c in spec.model_categoricals
        else (c, "number", None, typical[c])
        for c in spec.model_columns
    ]
    return frame.sparkSession.createDataFrame(
        rows, "field string, kind string, text string, number double"
    )
