"""Reading entity tables and writing reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from staylight.operators.clean import (
    clean,
    contract_columns,
    require_columns,
    trim_strings,
    with_row_reference,
    with_violations,
)
from staylight.operators.scoring import Scorer, ranked_batch, score
from staylight.spec import PanelSpec
from staylight.workspace import written


def delimited_options(sep: str = ",", multiline: bool = False) -> dict:
    """How delimited text is read, in batches and in streams alike."""
    return {"header": True, "sep": sep, "multiLine": multiline, "escape": '"', "enforceSchema": False}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Every column as text, so that ``None`` and ``NA`` stay values and only an empty
    cell is missing. A path that does not exist is an error, and so is, once it is read, a
    file whose header differs from the others': its cells would land in wrong columns.

    ``multiline`` allows line breaks inside quotes, at the price that a file can no
    longer be split between tasks.
    """
    reader = spark.read.options(**delimited_options(sep, multiline))
    return reader.schema(reader.csv(path).schema).csv(path)


def file_order() -> Column:
    """A row's place in the files it was read from, for "keep the first" rules.

    Only valid directly on a file-backed frame. Rows of one file block are read by one
    task in order, so the id increases inside it.
    """
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def load_clean(
    spark: SparkSession, path: str, spec: PanelSpec, fmt: str = "csv", order: str | None = None
) -> DataFrame:
    """Read and clean in one call; ``fmt`` is ``csv``, ``parquet`` or ``table``.

    ``order`` names a column that says which duplicate came first; without it the place
    in the files decides (for a table, which has no such place, it is required).
    """
    if fmt == "table":
        if order is None:
            raise ValueError("a table needs an order column to keep the first duplicate")
        return clean(spark.read.table(path), spec, order)
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    raw = read_delimited(spark, path) if fmt == "csv" else spark.read.parquet(path)
    if order is not None:
        return clean(raw, spec, order)
    return clean(raw.withColumn("_file_order", file_order()), spec, "_file_order")


def with_row_numbers(df: DataFrame, name: str = "row") -> DataFrame:
    """Number the rows of a file-backed frame from 1, files by name and rows as they stand.

    A stage: the rows are written once, because a running id is only lasting then. A block of
    a file is read by one task in order, so one offset per block is all that is summed up.
    """
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    rows = written(df.select("*", *(c.alias(k) for k, c in place.items()), F.monotonically_increasing_id().alias("_id")), "numbered")
    earlier = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    offsets = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    number = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("bigint")
    return rows.join(offsets, ["_file", "_block"]).select(*df.columns, number.alias(name))


def read_scoring_input(spark: SparkSession, path: str, spec: PanelSpec) -> DataFrame:
    """A delimited file whose columns include the contract; anything else is ignored. ``row`` is the
    row's number in the input; a row without an id is called ``row-<n>``."""
    rows = with_row_numbers(contract_columns(require_columns(read_delimited(spark, path), spec), spec))
    return with_row_reference(trim_strings(rows), spec, F.col("row"))


def score_file(
    spark: SparkSession, path: str, spec: PanelSpec, scorer: Scorer
) -> tuple[DataFrame, DataFrame]:
    """``(scored, rejected)`` rows of a delimited file: contract, validation, cleaning, one scoring
    pass that is stored. Rejected rows keep their cells and list their ``violations``. The checked
    rows are stored too, so every rule is evaluated once however they are used."""
    checked = written(with_violations(read_scoring_input(spark, path, spec), spec), "checked-file")
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    rejected = checked.filter(F.size("violations") > 0)
    return written(score(clean(valid, spec), spec, scorer), "scored-file"), rejected


def export_ranked(scored: DataFrame, spec: PanelSpec, threshold: float, path: str) -> None:
    """The ranked batch as delimited text: nine columns, highest risk first. Rows without an id
    column are called by their number."""
    row = F.col("row") if "row" in scored.columns else F.monotonically_increasing_id() + 1
    named = scored if spec.entity_id in scored.columns else with_row_reference(scored, spec, row)
    ranked = ranked_batch(named, spec, threshold, F.lit(0)).drop("row")
    ranked.write.mode("overwrite").option("header", True).csv(path)


def modified_at(spark: SparkSession, path: str) -> DataFrame:
    """The newest modification time under a path; file contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.agg(F.max("modificationTime").alias("modified_at"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the path, size and time of every file under ``path``, added up where they are listed; contents
    are not read. Files that are added, removed, changed or put back from elsewhere change it."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256), 1, 15), 16, 10)
    total = listing.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("sum")).first()
    return hashlib.sha256(f"{total['n']}:{total['sum']}".encode()).hexdigest()[:24]


def record_input(spark: SparkSession, input_path: str, record: str) -> None:
    """Store the input's fingerprint beside what was made of it."""
    spark.createDataFrame([(fingerprint(spark, input_path),)], "input string").write.mode("overwrite").parquet(record)


def outputs_are_stale(spark: SparkSession, input_path: str, *output_paths: str, record: str | None = None) -> bool:
    """True when an output is missing, or the input is not what the outputs were made of.

    With ``record`` (see :func:`record_input`) fingerprints decide, so files that were removed or put back with an
    older time count, and a missing record is stale. Without it the newest input file is
    compared with the outputs' times. An input that is gone makes nothing stale."""
    made = []
    for path in output_paths:
        try:
            made.append(modified_at(spark, path).first()[0])
        except AnalysisException:
            return True
    if any(w is None for w in made):
        return True
    try:
        if record is not None:
            now = fingerprint(spark, input_path)
        else:
            newest = modified_at(spark, input_path).first()[0]
    except AnalysisException:
        return False
    if record is None:
        return newest is not None and any(w < newest for w in made)
    try:
        return spark.read.schema("input string").parquet(record).first()["input"] != now
    except AnalysisException:
        return True
