"""One row per customer account, from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days before the last order on record at which the panel looks back.
HORIZON_DAYS = 180
YEAR_DAYS = 365.25


def _banded(parts: Column, whole: Column, edges, top: str) -> Column:
    """Label ``parts / whole`` by edges given as fractions ``(a, b)``; whole numbers only,
    so a share on an edge never depends on rounding."""
    band = F.when(F.lit(False), F.lit(top))
    for (a, b), label in edges:
        band = band.when(parts * b < whole * a, label)
    return band.otherwise(top)


def _tier(balance: Column) -> Column:
    band = F.when(F.lit(False), F.lit(""))
    for upper, label in ((1200, "Entry"), (3500, "Junior"), (5700, "Mid"), (8000, "Senior")):
        band = band.when(balance < upper, label)
    return band.otherwise("Executive")


def _order_figures(orders: DataFrame) -> DataFrame:
    """Per customer, from orders up to the snapshot day; plus whether any came later."""
    snapshot, start = F.col("snapshot"), F.col("start")
    day = F.col("o_orderdate").cast("date")
    past = day <= snapshot
    cents = F.round(F.col("o_totalprice") * 100, 0).cast("bigint")
    recent = past & (day > F.date_sub(snapshot, 365))
    return orders.groupBy("o_custkey").agg(
        F.count_if(past).alias("orders_n"),
        F.count_if(past & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent_n"),
        F.count_if(past & (F.col("o_orderstatus") == "F")).alias("filled_n"),
        F.count_if(recent).alias("orders_last_year"),
        F.sum(F.when(past, cents)).alias("cents"),
        F.datediff(F.max(snapshot), F.min(F.when(past, day))).alias("tenure_days"),
        F.datediff(F.max(snapshot), F.max(F.when(past, day))).alias("recency_days"),
        F.max(F.datediff(snapshot, start)).alias("span_days"),
        F.count_if(~past).alias("later_n"),
    )


def _line_figures(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per customer: lines, returned lines, discount points and distinct suppliers.

    Grouped by (customer, supplier) first: that spreads a customer who holds a large
    part of all lines, and turns the distinct count into a plain one.
    """
    # The stored column itself is compared, so that files can skip row groups.
    kind = orders.schema["o_orderdate"].dataType
    past = orders.filter(F.col("o_orderdate") < F.date_add("snapshot", 1).cast(kind)).select(
        "o_orderkey", "o_custkey"
    )
    line = lines.select(
        "l_orderkey",
        "l_suppkey",
        F.round(F.col("l_discount") * 100, 0).cast("bigint").alias("points"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("returned"),
    )
    pairs = (
        line.join(past, line.l_orderkey == past.o_orderkey)
        .groupBy("o_custkey", "l_suppkey")
        .agg(
            F.count("*").alias("lines"),
            F.sum("returned").alias("returned"),
            F.sum("points").alias("points"),
        )
    )
    return pairs.groupBy("o_custkey").agg(
        F.count("l_suppkey").alias("suppliers_n"),
        F.sum("lines").alias("lines_n"),
        F.sum("returned").alias("returned_n"),
        F.sum("points").alias("points"),
    )


def account_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The :data:`staylight.bindings.ACCOUNTS` panel.

    Features look at orders up to the snapshot (the last order day less 180 days); the
    target is whether an order came after it. Customers without an earlier order are
    not part of it. Both figures come out partitioned by customer, so joining them
    moves only the customer table.
    """
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    raw = table("orders")
    day = F.col("o_orderdate").cast("date")
    # Scalar subqueries: each is one number, computed once from the date column alone.
    snapshot = raw.agg(F.date_sub(F.max(day), HORIZON_DAYS)).scalar()
    start = raw.agg(F.min(day)).scalar()
    orders = raw.select("*", snapshot.alias("snapshot"), start.alias("start"))

    figures = _order_figures(orders).filter("orders_n > 0")
    places = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    joined = (
        table("customer")
        .join(figures, F.col("c_custkey") == F.col("o_custkey"))
        .drop("o_custkey")
        .join(_line_figures(orders, table("lineitem")), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    lines = F.coalesce("lines_n", F.lit(0).cast("bigint"))
    orders_n = F.col("orders_n")
    months = F.greatest(F.expr("tenure_days div 30"), F.lit(1).cast("bigint"))
    shaped = joined.withColumn("months", months)
    # Whole cents per month, halves up.
    monthly = F.expr("(2 * cents + months) div (2 * months)") / 100
    return shaped.select(
        F.col("c_custkey").alias("account_id"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        _tier(F.col("c_acctbal")).alias("tier"),
        F.when(F.col("urgent_n") * 5 >= orders_n, "Yes").otherwise("No").alias("urgent"),
        _banded(
            F.coalesce("returned_n", F.lit(0)), lines,
            (((30, 100), "None"), ((37, 100), "Rare")), "Frequent",
        ).alias("returns"),
        _banded(
            F.coalesce("points", F.lit(0)), lines,
            (((47, 10), "None"), ((50, 10), "Basic"), ((53, 10), "Standard")), "Premium",
        ).alias("discount"),
        _banded(
            F.col("filled_n"), orders_n,
            (((1, 5), "Low"), ((1, 3), "Medium"), ((1, 2), "High")), "Very High",
        ).alias("fulfilment"),
        monthly.alias("monthly_spend"),
        (F.col("tenure_days") / YEAR_DAYS).alias("tenure_years"),
        (F.col("recency_days") / YEAR_DAYS).alias("recency_years"),
        (F.col("span_days") / YEAR_DAYS).alias("span_years"),
        "orders_n",
        "orders_last_year",
        F.coalesce("suppliers_n", F.lit(0).cast("bigint")).alias("suppliers_n"),
        F.when(F.col("later_n") == 0, "Yes").otherwise("No").alias("churned"),
    )


def document_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The :data:`staylight.bindings.DOCUMENTS` panel: labelled documents."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "lang", "source", "n_chars"
    )
    return documents.join(labels, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, "Good").otherwise("Poor").alias("quality"),
        "lang",
        "source",
        "n_chars",
        F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("toxic"),
    )
