"""The whole analysis of a panel as a set of result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.operators import breakdowns as B
from staylight.operators.features import engineer
from staylight.operators.headlines import headlines
from staylight.sources.files import record_input
from staylight.sources.store import read_tables, write_tables
from staylight.spec import PanelSpec

#: The histogram edges and labels of the HR report.
HR_HISTOGRAMS = {
    "tenure_histogram": ("YearsAtCompany", (0, 5, 10, 15, 20), "{low}-{high}y"),
    "age_histogram": ("Age", (18, 27, 36, 45, 54), "{low}-{high}"),
}


def insight_tables(
    df: DataFrame, spec: PanelSpec, histograms: Mapping | None = None,
    rates: DataFrame | None = None, totals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """KPIs, breakdowns, histograms, segments, headlines and the roster of a clean panel. Segments
    and headlines follow from ``rates`` and ``totals``, the breakdowns and KPIs, where those are stored."""
    enriched = engineer(df, spec)
    rates = B.breakdowns(enriched, spec) if rates is None else rates
    totals = B.kpis(enriched, spec) if totals is None else totals
    overall = totals.select(F.coalesce(F.col("left") / F.nullif("employees", F.lit(0)), F.lit(0.0))).scalar()
    tables = {
        "kpis": totals,
        "breakdowns": rates,
        "risk_segments": B.risk_segments(rates, overall, spec),
        "headlines": headlines(enriched, spec, rates, totals),
        "roster": B.roster(df, spec),
    }
    for name, (column, edges, template) in (histograms or {}).items():
        tables[name] = B.histogram(enriched, spec, column, edges, template)
    return tables


def write_analysis(
    df: DataFrame, spec: PanelSpec, folder: str, histograms: Mapping | None = None, input_path: str | None = None
) -> list[str]:
    """Compute and store every table; the panel is prepared once and read by all of them.

    KPIs and breakdowns are stored first, and what follows from them reads the stored tables. With ``input_path``
    the fingerprint of those files is stored last, as ``folder/input``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        enriched = engineer(df, spec)
        first = {"kpis": B.kpis(enriched, spec), "breakdowns": B.breakdowns(enriched, spec)}
        write_tables(first, folder)
        stored = read_tables(df.sparkSession, folder, *first)
        tables = insight_tables(df, spec, histograms, stored["breakdowns"], stored["kpis"])
        write_tables({k: v for k, v in tables.items() if k not in first}, folder)
    finally:
        df.unpersist()
    if input_path is not None:
        record_input(df.sparkSession, input_path, f"{folder}/input")
    return list(tables)
