"""Scoring a stream of entity rows into the log, and the running totals beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from staylight.operators.clean import apply_defaults, coerce_numerics, split_valid, trim_strings, with_violations
from staylight.operators.scoring import Scorer, score
from staylight.sources.files import delimited_options
from staylight.sources.log import append, log_rows, stored_summary
from staylight.spec import PanelSpec
from staylight.workspace import written


def read_entities(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files under ``path`` as a stream of rows. Delimited files are read as
    :func:`staylight.sources.files.read_delimited` reads them, and refused if their header differs from
    ``schema``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**delimited_options())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def scored_stream(
    entities: DataFrame, spec: PanelSpec, scorer: Scorer, threshold: float,
    created_at: Column | None = None, sequence: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(log rows, rejected rows)``; row by row, so there is no state to keep."""
    valid, rejected = split_valid(apply_defaults(trim_strings(entities), spec), spec)
    scored = score(coerce_numerics(valid, spec), spec, scorer)
    # A stream has no running row id; the entity's hash orders rows of one time stamp.
    order = F.xxhash64(F.col(spec.entity_id)) if sequence is None else sequence
    return log_rows(scored, spec, threshold, "stream", created_at, order), rejected


def append_stream(rows: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append to the log that batches use too; takes what has arrived and ends.

    Each micro-batch is one run of the log, named after the stream and its number. A restart
    with the same checkpoint continues where it stopped; a micro-batch that runs again
    replaces itself. Streams that share a log need different names.
    """
    return (
        rows.writeStream.foreachBatch(lambda batch, number: append(batch, path, f"{name}-{number:012d}"))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    entities: DataFrame, spec: PanelSpec, scorer: Scorer, threshold: float, path: str, checkpoint: str,
    created_at: Column | None = None, sequence: Column | None = None, name: str = "stream",
) -> StreamingQuery:
    """Validate, score and log a stream in one query: takes what has arrived and ends.

    Each micro-batch is read and validated once; its scored and its rejected rows are committed together as
    one run (:func:`staylight.sources.log.read_log`, :func:`~staylight.sources.log.read_rejected`)."""

    def one(batch: DataFrame, number: int) -> None:
        checked = written(with_violations(apply_defaults(trim_strings(batch), spec), spec), "checked-batch")
        valid = checked.filter(F.size("violations") == 0).drop("violations")
        scored = score(coerce_numerics(valid, spec), spec, scorer)
        order = F.xxhash64(F.col(spec.entity_id)) if sequence is None else sequence
        rows = log_rows(scored, spec, threshold, "stream", created_at, order)
        append(rows, path, f"{name}-{number:012d}", rejected=checked.filter(F.size("violations") > 0))

    return (
        entities.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_summary(spark: SparkSession, path: str) -> DataFrame:
    """Totals over the log that streams append to (one row): every run's own part, added up. A micro-batch that runs
    again after a failure replaces its part, so it is never counted twice."""
    return stored_summary(spark, path)
