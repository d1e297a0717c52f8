"""The scoring log: an append-only dataset of runs, each committed by one entry.

Batches and streams share it: both append whole runs. A run has a name, and appending a run
again replaces it, so a stream that repeats a batch after a failure leaves no double rows. The files of an
attempt lie in a folder of their own, one below it per day, and nothing is overwritten or deleted: readers that
have begun keep what they read. The entry of a run carries its totals, so the summary of the whole log costs
no scan, and a run that comes again replaces its part of it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from staylight.functions import derived as D
from staylight.sources.commits import live, publish
from staylight.spec import PanelSpec

LOG_TYPE = (
    "id bigint, created_at timestamp, source string, employee_ref string, probability double, "
    "risk_band string, will_leave int, salary double, years_here int, job_role string, "
    "payload string, score_date date, run string"
)
#: Length of a reference, and the bounds of a "latest rows" request.
REFERENCE_LENGTH = 64
RECENT_RANGE = (1, 200)


def log_rows(
    scored: DataFrame, spec: PanelSpec, threshold: float, source: str,
    created_at: dt.datetime | Column | None = None, sequence: Column | None = None,
) -> DataFrame:
    """Scored rows in the shape of the log. Rows of one run share their time stamp;
    ``id`` orders them inside it."""
    when = F.current_timestamp() if created_at is None else created_at
    stamp = F.date_trunc("second", when if isinstance(when, Column) else F.lit(when))
    p, roles = F.col("probability"), spec.roles
    years = F.col(roles.years_here) if roles else F.lit(0)
    job = F.col(roles.job) if roles else F.lit(None)
    order = F.monotonically_increasing_id() if sequence is None else sequence
    reference = F.substring(F.col(spec.entity_id).cast("string"), 1, REFERENCE_LENGTH)
    return scored.select(
        order.cast("bigint").alias("id"),
        stamp.cast("timestamp").alias("created_at"),
        F.lit(source).alias("source"),
        F.nullif(reference, F.lit("")).alias("employee_ref"),
        F.bround(p, 4).alias("probability"),
        D.risk_band(p).alias("risk_band"),
        (p >= threshold).cast("int").alias("will_leave"),
        F.coalesce(F.col(spec.income).cast("double"), F.lit(0.0)).alias("salary"),
        F.coalesce(years.cast("double").cast("int"), F.lit(0)).alias("years_here"),
        job.cast("string").alias("job_role"),
        F.to_json(F.struct(spec.entity_id, *spec.contract)).alias("payload"),
        stamp.cast("date").alias("score_date"),
    )


def append(rows: DataFrame, path: str, run: str | None = None, rejected: DataFrame | None = None) -> None:
    """Append one run, and the rows that were turned away with it: both appear together when the entry is
    committed, or not at all, however many days they touch.

    Without a name the run gets one that sorts by the time of the call, so that later runs
    of one second stay newer. What the entry says of the run is counted while it is written."""
    spark = rows.sparkSession
    name = run or f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    attempt, seen, turned_away = uuid.uuid4().hex, Observation(), Observation()
    counted = rows.withColumn("run", F.lit(name)).observe(
        seen,
        F.count("*").alias("rows"), F.sum("will_leave").alias("flagged"), F.sum("probability").alias("probability"),
        F.sum(F.col("salary") * F.col("probability")).alias("at_risk"),
        F.min("score_date").cast("string").alias("first_day"), F.max("score_date").cast("string").alias("last_day"),
    )
    counted.write.partitionBy("score_date").parquet(f"{_data(path)}/attempt={attempt}")
    entry = {"op": "append", "run": name, "attempt": attempt, **seen.get, "rejected": 0}
    if rejected is not None:
        kept = rejected.withColumn("run", F.lit(name)).observe(turned_away, F.count("*").alias("rows"))
        kept.write.parquet(f"{_rejected(path)}/attempt={attempt}")
        entry["rejected"] = turned_away.get["rows"]
    publish(spark, path, entry)


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def _rejected(path: str) -> str:
    return f"{path.rstrip('/')}/rejected"


def _read(spark: SparkSession, path: str, attempts: list[str]) -> DataFrame:
    if not attempts:
        return spark.createDataFrame([], LOG_TYPE)
    reader = spark.read.schema(f"{LOG_TYPE}, attempt string").option("basePath", _data(path))
    found = reader.parquet(*(f"{_data(path)}/attempt={a}" for a in attempts))
    return found.select(*(part.split()[0] for part in LOG_TYPE.split(", ")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all live runs; the driver holds one name per run."""
    return _read(spark, path, [r["attempt"] for r in live(spark, path).filter("rows > 0").select("attempt").collect()])


def read_rejected(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that live runs turned away, with their violations and ``run``; nothing if there are none."""
    attempts = [r["attempt"] for r in live(spark, path).filter("rejected > 0").select("attempt").collect()]
    if not attempts:
        return None
    reader = spark.read.option("basePath", _rejected(path))
    return reader.parquet(*(f"{_rejected(path)}/attempt={a}" for a in attempts)).drop("attempt")


def stored_summary(spark: SparkSession, path: str) -> DataFrame:
    """:func:`summary` of a stored log from the totals of its live runs; no row is read."""
    rows, zero = F.coalesce(F.sum("rows"), F.lit(0)), F.lit(0.0)
    mean = F.coalesce(F.try_divide(F.sum("probability"), F.sum("rows")), zero)
    return live(spark, path).agg(
        rows.alias("total"),
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged"),
        F.bround(mean, 4).alias("avg_probability"),
        F.bround(F.coalesce(F.sum("at_risk"), zero), 0).cast("bigint").alias("salary_at_risk"),
    )


def summary(log: DataFrame) -> DataFrame:
    """Totals over the log, zeros when it is empty."""
    at_risk = F.coalesce(F.sum(F.col("salary") * F.col("probability")), F.lit(0.0))
    return log.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("will_leave"), F.lit(0)).alias("flagged"),
        F.bround(F.coalesce(F.avg("probability"), F.lit(0.0)), 4).alias("avg_probability"),
        F.bround(at_risk, 0).cast("bigint").alias("salary_at_risk"),
    )


def recent(log: DataFrame, limit: int = 25) -> DataFrame:
    """The newest rows, newest first; ``limit`` is held within 1..200. Rows of one second go by
    run, later runs first, and by their number in it."""
    low, high = RECENT_RANGE
    newest = log.orderBy(F.desc("created_at"), F.desc("run"), F.desc("id")).limit(max(low, min(limit, high)))
    return newest.drop("payload", "score_date", "run")


def recent_from(spark: SparkSession, path: str, limit: int = 25) -> DataFrame:
    """:func:`recent` on a stored log, opening only the runs and days that can hold the newest rows.

    The entries say how many rows each run has and from which day on: the last day from which on
    whole runs hold enough rows bounds what is opened.
    """
    low, high = RECENT_RANGE
    wanted = max(low, min(limit, high))
    runs = live(spark, path).filter("rows > 0").select("attempt", "rows", "first_day", "last_day").collect()
    runs.sort(key=lambda r: r["first_day"], reverse=True)
    since, held = None, 0
    for run in runs:
        held += run["rows"]
        if held >= wanted:
            since = run["first_day"]
            break
    if since is None:
        return recent(_read(spark, path, [r["attempt"] for r in runs]), wanted)
    opened = _read(spark, path, [r["attempt"] for r in runs if r["last_day"] >= since])
    return recent(opened.filter(F.col("score_date") >= F.lit(since)), wanted)


def clear(spark: SparkSession, path: str) -> int:
    """Empty the log by an entry; returns how many rows it held.

    Runs committed before it no longer count, those after it do, and readers that have begun are not disturbed: the
    files stay. A stream keeps its own checkpoint: after a restart it goes on with new arrivals and does
    not bring cleared rows back."""
    removed = live(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    publish(spark, path, {"op": "clear"})
    return removed
