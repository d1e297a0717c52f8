"""Row numbers over a whole table without sorting it in one task.

Rows are ordered by an md5 key. Its leading hex digits cut the table into even
buckets, which are numbered in parallel; a running total over the few thousand
bucket sizes then gives every bucket its offset. The result equals a plain global
``row_number()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: 16 ** 3 = 4096 buckets.
PREFIX_DIGITS = 3


def shuffle_key(entity: Column, *salts) -> Column:
    """md5 of ``id:salt:...``: a fixed pseudo-random order, the same on every run."""
    parts = [entity.cast("string"), *(F.lit(s) if not isinstance(s, Column) else s for s in salts)]
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def with_positions(
    df: DataFrame, keys: list[str], order_key: str, tie: str, name: str = "position"
) -> DataFrame:
    """Number the rows of each ``keys`` group from 1 in order of ``(order_key, tie)``."""
    df = df.withColumn("_bucket", F.substring(order_key, 1, PREFIX_DIGITS))
    numbered = df.withColumn(
        "_within", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order_key, tie))
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    # Merged: the rows already lie by key and bucket, and the driver need not hold 4096 offsets per group.
    joined = numbered.join(offsets.hint("merge"), [*keys, "_bucket"])
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop(
        "_bucket", "_before", "_within"
    )


def stratified_folds(
    df: DataFrame, entity: str, label: str, folds: int, repeats: int = 1, seed: int = 0,
    row: str | None = None,
) -> DataFrame:
    """``entity, label, repeat, fold`` (and ``row``): each label spread evenly over the folds, in
    another order for every repeat. ``row`` names a column that tells rows with equal or
    missing ids apart."""
    own = [entity, label] if row is None else [entity, label, row]
    spread = df.select(*own, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    keyed = spread.withColumn("_key", shuffle_key(F.col(entity), F.col("repeat") + seed))
    placed = with_positions(keyed, ["repeat", label], "_key", row or entity)
    return placed.select(
        *own, "repeat", ((F.col("position") - 1) % folds).cast("int").alias("fold")
    )
