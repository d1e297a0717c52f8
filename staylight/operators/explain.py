"""Why a score is what it is, and what would lower it.

Every row becomes a handful of what-if rows (at most one per field and better
option) that run through the same features and the same scorer. Rows are spread by
their content *before* they multiply, so the regrouping afterwards needs no second
shuffle; each then gets a number of its own, so rows that share an id, or have none, are
explained one by one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylight.functions import derived as D
from staylight.functions.cells import literal_map
from staylight.operators.features import engineer
from staylight.operators.scoring import Scorer, with_decision
from staylight.spec import PanelSpec

#: List lengths and the smallest reduction worth proposing.
TOP_DRIVERS = 6
TOP_ACTIONS = 4
MIN_REDUCTION = 0.01

#: What tells rows apart inside an explanation: where a row was sent, and its number there.
ROW = ("_spread", "_row")

KINDS = ("base", "driver", "action", "pay")
_OPTION_TYPE = (
    "array<struct<no:int,kind:string,field:string,text:string,number:double,display:string,rung:int>>"
)


def options(spec: PanelSpec, typical: Mapping | None, kinds=KINDS) -> list[dict]:
    """Every change that is tried at all, before looking at an entity's own values."""
    out = []
    if "base" in kinds:
        out.append({"kind": "base", "display": ""})
    if "driver" in kinds:
        for field in spec.contract:
            value = (typical or {}).get(field)
            if value is None:
                continue
            new = {"text": value} if field in spec.categoricals else {"number": float(value)}
            shown = value if field in spec.categoricals else str(float(value))
            out.append({"kind": "driver", "field": field, "display": shown, **new})
    if "action" in kinds:
        for field, ladder in spec.ladders.items():
            for i, value in enumerate(ladder):
                out.append(
                    {"kind": "action", "field": field, "text": value, "display": value, "rung": i + 1}
                )
    if "pay" in kinds and spec.pay_pitch:
        for i, rise in enumerate(D.PAY_RISES):
            out.append(
                {"kind": "pay", "field": spec.income, "number": rise, "display": f"+{rise:.0%}",
                 "rung": i + 1}
            )
    return out


def variants(
    df: DataFrame, spec: PanelSpec, typical: Mapping | None, kinds=KINDS, carry=()
) -> DataFrame:
    """The entity itself (``kind = base``) and its what-ifs, not yet scored.

    Drivers: a field set to its typical value, unless it has it already. Actions: a
    strictly better rung of a ladder (``step`` rungs up), for values that are on it.
    Pay: a raised income, where there is one.

    What an entity holds now is put into arrays once, before it multiplies, and looked up
    by field number: code that is repeated per what-if stays small enough to be compiled.
    """
    columns = [spec.entity_id, *spec.contract, *carry]
    number = {c: i for i, c in enumerate(spec.contract)}
    tried = [{"no": number.get(o.get("field")), **o} for o in options(spec, typical, kinds)]
    income = F.col(spec.income).cast("double")

    nothing = F.lit(None)
    texts = [F.col(c) if c in spec.categoricals else nothing.cast("string") for c in number]
    numbers = [F.col(c).cast("double") if c in spec.numerics else nothing for c in number]
    shown = [F.col(c) if c in spec.categoricals else F.col(c).cast("double") for c in number]
    rungs = [
        D.rank_in(spec.ladders[c], F.col(c)) if c in spec.ladders else nothing for c in number
    ]
    # Spread by content, which a repeated task finds again, and numbered behind the shuffle: a
    # row and all its what-ifs stay in one task, whatever its id.
    spread = df.select(*columns, F.xxhash64(*columns).alias("_spread")).repartition("_spread")
    own = spread.select(
        *columns,
        "_spread",
        F.monotonically_increasing_id().alias("_row"),
        F.array(*texts).alias("_text"),
        F.array(*numbers).cast("array<double>").alias("_number"),
        F.array(*(c.cast("string") for c in shown)).alias("_shown"),
        F.array(*rungs).cast("array<int>").alias("_rung"),
    )
    exploded = own.select(
        "*", F.inline(F.from_json(F.lit(json.dumps(tried)), _OPTION_TYPE))
    )

    kind, no = F.col("kind"), F.col("no")
    at_typical = F.get("_text", no).eqNullSafe(F.col("text")) & F.get("_number", no).eqNullSafe(
        F.col("number")
    )
    kept = (
        F.when(kind == "driver", ~at_typical)
        .when(kind == "action", F.coalesce(F.col("rung") > F.get("_rung", no), F.lit(False)))
        .when(kind == "pay", F.coalesce(income > 0, F.lit(False)))
        .otherwise(True)
    )
    raised = F.when(kind == "pay", D.pay_rise(income, F.col("number"))).otherwise(F.col("number"))
    replaced = [
        F.when(no == i, F.col("text")).otherwise(F.col(c)).alias(c)
        if c in spec.categoricals
        else F.when(no == i, raised if c == spec.income else F.col("number"))
        .otherwise(F.col(c).cast("double"))
        .alias(c)
        for c, i in number.items()
    ]
    return exploded.filter(kept).select(
        spec.entity_id,
        *ROW,
        *carry,
        "kind",
        "field",
        "display",
        F.when(kind == "action", F.col("rung") - F.get("_rung", no))
        .otherwise(F.coalesce("rung", F.lit(0)))
        .alias("step"),
        F.get("_shown", no).alias("value"),
        *replaced,
    )


def scored_variants(
    df: DataFrame, spec: PanelSpec, scorer: Scorer, typical: Mapping | None, kinds=KINDS
) -> DataFrame:
    """Every what-if with its score, the entity's own score and the difference."""
    own = scorer.score(engineer(df, spec)).withColumnRenamed("probability", "base")
    scored = scorer.score(engineer(variants(own, spec, typical, kinds, ("base",)), spec))
    return scored.withColumn("delta", F.col("base") - F.col("probability"))


def _shortlist(what_ifs: DataFrame, spec: PanelSpec, *carry: str) -> DataFrame:
    """The base row, the top drivers and the top actions of every entity.

    ``list`` says which, ``position`` counts inside it. Of several options for one field
    the one that lowers the score most stays, on ties the smallest step. The minimum
    reduction is checked after the first ranking: placed before it, the filter would be
    pushed through the scorer and have every what-if scored twice.
    """
    key, income = spec.entity_id, F.col(spec.income).cast("double")
    narrow = what_ifs.select(
        key, *ROW, "kind", "field", "value", "display", "step", "delta", "probability",
        income.alias("income"), *carry,
        F.when(F.col("kind") == "pay", "action").otherwise(F.col("kind")).alias("list"),
        F.bround("delta", 4).alias("effect"),
    )
    per_field = W.partitionBy(*ROW, "list", "field").orderBy(F.desc("delta"), "step")
    best = W.partitionBy(*ROW, "list").orderBy(F.desc(F.abs("effect")), "field")
    length = (
        F.when(F.col("list") == "driver", TOP_DRIVERS)
        .when(F.col("list") == "action", TOP_ACTIONS)
        .otherwise(1)
    )
    return (
        narrow.withColumn("_option", F.row_number().over(per_field))
        .filter("_option = 1")
        .filter((F.col("list") != "action") | (F.col("delta") > MIN_REDUCTION))
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= length)
    )


def _label(spec: PanelSpec) -> Column:
    return F.coalesce(literal_map(dict(spec.labels), F.col("field")), F.col("field"))


def _driver_fields(spec: PanelSpec) -> list[Column]:
    return [
        F.col("position"),
        F.col("field"),
        _label(spec).alias("label"),
        F.col("value"),
        F.col("display").alias("compared_to"),
        F.col("effect").alias("impact"),
        F.when(F.col("delta") > 0, "increases").otherwise("decreases").alias("direction"),
    ]


def _action_fields(spec: PanelSpec) -> list[Column]:
    is_pay = F.col("kind") == "pay"
    pitch = F.coalesce(literal_map(dict(spec.playbook), F.col("field")), F.lit(""))
    raised = F.replace(F.lit(spec.pay_pitch), F.lit("%s"), F.col("display"))
    return [
        F.col("position"),
        F.col("field"),
        _label(spec).alias("label"),
        F.col("value").alias("from"),
        F.when(is_pay, F.col("income").cast("string")).otherwise(F.col("display")).alias("to"),
        F.col("display"),
        F.col("effect").alias("reduction"),
        F.bround("probability", 4).alias("new_probability"),
        F.when(is_pay, raised).otherwise(pitch).alias("recommendation"),
        F.col("kind"),
    ]


def drivers(df: DataFrame, spec: PanelSpec, scorer: Scorer, typical: Mapping) -> DataFrame:
    """Per entity the fields whose typical value would move the score most."""
    what_ifs = scored_variants(df, spec, scorer, typical, ("driver",))
    return _shortlist(what_ifs, spec).select(spec.entity_id, *_driver_fields(spec))


def actions(df: DataFrame, spec: PanelSpec, scorer: Scorer) -> DataFrame:
    """Per entity the single changes that lower the score most; only ever improvements."""
    what_ifs = scored_variants(df, spec, scorer, None, ("action", "pay"))
    return _shortlist(what_ifs, spec).select(spec.entity_id, *_action_fields(spec))


def explained(
    df: DataFrame, spec: PanelSpec, scorer: Scorer, typical: Mapping, threshold: float
) -> DataFrame:
    """One row per row of ``df``: score, decision, derived values, ``drivers`` and ``actions``."""
    names = spec.derived
    derived = [names.share, names.gap, names.pay, names.band] if names else []
    short = _shortlist(scored_variants(df, spec, scorer, typical), spec, *derived)
    part = F.col("list")

    def listed(name: str, fields: list[Column]) -> Column:
        # At most six rows; those of the other lists give null, which is left out.
        return F.sort_array(F.collect_list(F.when(part == name, F.struct(*fields))))

    own = F.struct("probability", "income", *derived)
    flat = (
        short.groupBy(*ROW, spec.entity_id)
        .agg(
            F.max(F.when(part == "base", own)).alias("_own"),
            listed("driver", _driver_fields(spec)).alias("drivers"),
            listed("action", _action_fields(spec)).alias("actions"),
        )
        .select(
            spec.entity_id, "drivers", "actions",
            F.col("_own.probability").alias("probability"),
            F.col("_own.income").alias(spec.income),
            *(F.col(f"_own.{c}").alias(c) for c in derived),
        )
    )
    return with_decision(flat, spec, threshold).select(
        spec.entity_id,
        F.bround("probability", 4).alias("probability"),
        "percent",
        "will_leave",
        "threshold",
        "risk_band",
        "advice",
        F.lit(scorer.label).alias("model"),
        *([F.struct(*derived).alias("engineered")] if derived else []),
        "drivers",
        "actions",
        "cost_at_risk",
    )
