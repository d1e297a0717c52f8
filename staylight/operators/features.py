"""Derived columns: the same expressions for training rows, scoring rows and what-ifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.functions import derived as D
from staylight.operators.clean import assert_modelled_columns
from staylight.spec import PanelSpec


def engineer(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add the share, gap, pay-per-level and tenure-band columns the spec names."""
    if spec.derived is None:
        return df
    roles, names = spec.roles, spec.derived
    here = F.col(roles.years_here).cast("double")
    rank = D.level_rank(F.col(roles.level), spec.level_ranks)
    return df.withColumns(
        {
            names.share: D.career_share(here, F.col(roles.total_years).cast("double")),
            names.gap: D.promotion_gap(F.col(roles.since_change).cast("double"), here),
            names.pay: D.pay_per_level(F.col(roles.income).cast("double"), rank),
            names.band: D.tenure_band(here, spec.tenure_edges, spec.tenure_top),
        }
    )


def model_frame(df: DataFrame, spec: PanelSpec, *carry: str) -> DataFrame:
    """Engineer, then keep exactly the model columns in declared order.

    ``carry`` names bookkeeping columns (id, label) to keep in front of them.
    """
    assert_modelled_columns(spec.model_columns, spec)
    return engineer(df, spec).select(*carry, *spec.model_columns)
