"""Whole-table checks of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.operators.breakdowns import breakdowns
from staylight.operators.clean import target_flag
from staylight.operators.features import engineer
from staylight.spec import PanelSpec
from staylight.workspace import written


def quality_checks(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``check, passed, observed``: nulls, repeated ids, target values and rates.

    A stage: the panel is derived and written once, and so are its breakdowns; the checks then read
    narrow columns of what is stored."""
    columns = [spec.entity_id, spec.target, *spec.monitor_only, *spec.contract]
    df = written(df.select(*dict.fromkeys(columns)), "checked-panel")
    # Two steps instead of a distinct count: repeated ids are combined before the shuffle.
    ids = df.groupBy(spec.entity_id).agg(F.count("*").alias("n"))
    repeated = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    odd = ~F.lower(F.col(spec.target)).isin("yes", "no")
    rates = written(breakdowns(engineer(df, spec), spec), "checked-rates")
    outside = rates.agg(F.count_if(~F.col("attrition_rate").between(0, 1))).scalar()
    uneven = (
        rates.groupBy("attribute").agg(F.sum("total").alias("total"))
        .agg(F.count_if(F.col("total") != df.agg(F.count("*")).scalar()))
        .scalar()
    )
    nulls = sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    facts = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"),
        F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"),
        F.count_if(target_flag(spec) == 1).alias("yes"),
    ).withColumns({"repeated": repeated, "outside": outside, "uneven": uneven})

    def check(name: str, observed, passed):
        return F.struct(
            F.lit(name).alias("check"), passed.alias("passed"),
            observed.cast("bigint").alias("observed"),
        )

    both = (F.col("yes") > 0) & (F.col("yes") < F.col("rows"))
    return facts.select(
        F.inline(
            F.array(
                check("no nulls", F.col("nulls"), F.col("nulls") == 0),
                check("ids are unique", F.col("repeated"), F.col("repeated") == 0),
                check("target is yes or no", F.col("odd"), F.col("odd") == 0),
                check("both outcomes occur", F.col("yes"), both),
                check("rates are proportions", F.col("outside"), F.col("outside") == 0),
                check("breakdowns cover all rows", F.col("uneven"), F.col("uneven") == 0),
            )
        )
    )
