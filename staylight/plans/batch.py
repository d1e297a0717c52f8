"""A delimited batch from file to report: the parts of one upload, scored once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.operators.scoring import Scorer, batch_summary, ranked_batch
from staylight.sources.files import export_ranked, score_file
from staylight.sources.log import append, log_rows
from staylight.spec import PanelSpec


@dataclass(frozen=True)
class Batch:
    """``scored``: every valid row. ``ranked``: the report, highest risk first, with the input row
    number. ``rejected``: rows that broke a rule, with their violations. ``summary``: one row."""

    scored: DataFrame
    ranked: DataFrame
    rejected: DataFrame
    summary: DataFrame


def score_batch(
    spark: SparkSession, path: str, spec: PanelSpec, scorer: Scorer, threshold: float,
    log_path: str | None = None, export_path: str | None = None, created_at: dt.datetime | None = None,
    source: str = "csv",
) -> Batch:
    """Read, check the contract, validate, score once, then report.

    The stored scores feed the ranking, the summary, the log and the export; none of them
    scores again. A log or an export is written only if its path is given. A file without the
    contract is refused; rows that break a rule are set apart, not scored.
    """
    scored, rejected = score_file(spark, path, spec, scorer)
    if log_path is not None:
        append(log_rows(scored, spec, threshold, source, created_at, F.col("row")), log_path)
    if export_path is not None:
        export_ranked(scored, spec, threshold, export_path)
    return Batch(
        scored,
        ranked_batch(scored, spec, threshold, F.col("row")),
        rejected,
        batch_summary(scored, spec, threshold),
    )
