"""Cleaning, validation and the column contracts around a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylight.functions.cells import is_yes, number_or_zero, parsed_number, stripped
from staylight.spec import PanelSpec

VIOLATION_TYPE = "array<struct<field:string,rule:string,value:string>>"


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip white space around every string column."""
    return df.select(
        *(
            stripped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema
        )
    )


def coerce_numerics(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Turn the declared numerics into doubles; missing or unparseable becomes 0."""
    present = [c for c in spec.numerics if c in df.columns]
    return df.withColumns({c: number_or_zero(F.col(c), _is_numeric(df, c)) for c in present})


def keep_first(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate rather than a window, so a key repeated very often is reduced to
    one row per task before the shuffle. Rows without a key count as one key.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*(F.col(key) if c == key else F.col(f"_first.{c}") for c in df.columns))


def clean(df: DataFrame, spec: PanelSpec, order: Column | str | None = None) -> DataFrame:
    """Trim text, force numbers and keep the first row per id.

    ``order`` says which duplicate came first; a column named here is dropped from
    the result. Without it the table is taken to hold each id once.
    """
    tidy = coerce_numerics(trim_strings(df), spec)
    if order is None:
        return tidy
    if isinstance(order, str):
        return keep_first(tidy, spec.entity_id, F.col(order)).drop(order)
    return keep_first(tidy, spec.entity_id, order)


def target_flag(spec: PanelSpec) -> Column:
    return is_yes(F.col(spec.target))


def with_target(df: DataFrame, spec: PanelSpec, name: str = "label") -> DataFrame:
    return df.withColumn(name, target_flag(spec))


def drop_unmodelled(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Remove id, target and protected columns before modelling."""
    return df.drop(spec.target, spec.entity_id, *spec.monitor_only)


def assert_modelled_columns(columns, spec: PanelSpec) -> None:
    forbidden = {spec.target, spec.entity_id, *spec.monitor_only} & set(columns)
    if forbidden:
        raise ValueError(f"columns must not reach the model: {sorted(forbidden)}")


def require_columns(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Refuse an input that lacks contract columns, naming all of them."""
    missing = [c for c in spec.contract if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing required columns: {', '.join(missing)}")
    return df


def contract_columns(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Only the contract columns, and the id where there is one."""
    keep = [spec.entity_id, *spec.contract]
    return df.select(*(c for c in keep if c in df.columns))


def form_projection(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A reported row as scoring input: without outcome, protected and derived columns."""
    derived = spec.derived
    names = (derived.share, derived.gap, derived.pay, derived.band) if derived else ()
    return df.drop(spec.target, *spec.monitor_only, *names)


def apply_defaults(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add absent contract columns with their declared default. Null cells stay null."""
    absent = [c for c in spec.contract if c not in df.columns]
    unknown = [c for c in absent if c not in spec.defaults]
    if unknown:
        raise ValueError(f"no default declared for: {', '.join(unknown)}")
    return df.withColumns({c: F.lit(spec.defaults[c]) for c in absent})


def _violation(field: str, rule: str, broken: Column) -> Column:
    found = F.struct(
        F.lit(field).alias("field"),
        F.lit(rule).alias("rule"),
        F.col(field).cast("string").alias("value"),
    )
    return F.when(broken, found)


def _number_name(field: str) -> str:
    return f"_number_{field}"


def _rules(spec: PanelSpec) -> list[Column]:
    rules = []
    for field, allowed in spec.categoricals.items():
        value = F.col(field)
        rules.append(_violation(field, "missing", value.isNull()))
        if allowed:
            rules.append(_violation(field, "unknown category", ~value.isin(*allowed)))
    for field in spec.numerics:
        value, number = F.col(field), F.col(_number_name(field))
        rules.append(_violation(field, "missing", value.isNull()))
        rules.append(_violation(field, "not a number", value.isNotNull() & number.isNull()))
        if field in spec.whole_numbers:
            rules.append(_violation(field, "not a whole number", number != F.floor(number)))
        if field in spec.ranges:
            low, high = spec.ranges[field]
            rules.append(_violation(field, "below minimum", number < low))
            rules.append(_violation(field, "above maximum", number > high))
    return rules


def with_violations(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add ``violations``: every broken rule of the row, in one pass.

    Numbers are read once per cell, before the rules that look at them.
    """
    numbers = {
        _number_name(c): F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        if _is_numeric(df, c) else parsed_number(F.col(c))
        for c in spec.numerics
    }
    found = F.filter(F.array(*_rules(spec)), lambda v: v.isNotNull())
    return df.withColumns(numbers).withColumn("violations", found).drop(*numbers)


def split_valid(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; the rejected rows keep their violations."""
    checked = with_violations(df, spec)
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)


def violation_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per broken rule: id, field, rule, value."""
    # The outer form: a plain inline would make Catalyst check the list's size first, and
    # so evaluate every rule again.
    found = with_violations(df, spec).select(spec.entity_id, F.inline_outer("violations"))
    return found.filter(F.col("rule").isNotNull()).select(spec.entity_id, "field", "rule", "value")


def with_row_reference(df: DataFrame, spec: PanelSpec, sequence: Column) -> DataFrame:
    """Give rows without an id the reference ``row-<n>``."""
    fallback = F.concat(F.lit("row-"), sequence.cast("string"))
    if spec.entity_id not in df.columns:
        return df.withColumn(spec.entity_id, fallback)
    given = F.nullif(F.col(spec.entity_id).cast("string"), F.lit(""))
    return df.withColumn(spec.entity_id, F.coalesce(given, fallback))
