"""Commits of a dataset that several writers append to: numbered entries, each created once or not at all.

A writer puts its files into folders of its own and then publishes one entry that names them; readers go by the
entries, so a run appears whole, over however many days and tables, and a writer that is broken off leaves only
folders that nobody reads. The next number is taken by creating its file, which fails for all writers but one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY_TYPE = (
    "token string, op string, run string, attempt string, rows long, flagged long, probability double, "
    "at_risk double, first_day date, last_day date, rejected long"
)
#: Numbers tried before a writer gives up against others.
MOST_TRIES = 1000


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/commits"


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _last_number(spark: SparkSession, path: str) -> int:
    files, at = _file_system(spark, _folder(path))
    if not files.exists(at):
        return 0
    names = (entry.getPath().getName() for entry in files.listStatus(at))
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)


def _create(spark: SparkSession, name: str, entry: dict) -> bool:
    """Create the entry unless its file is there; an empty file is an entry whose writer was lost."""
    files, at = _file_system(spark, name)
    try:
        out = files.create(at, False)
    except Py4JJavaError as error:
        if files.exists(at):
            return False
        raise error
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    # File systems that only look before they create may let two writers pass: the content decides.
    return spark.read.schema(ENTRY_TYPE).json(name).filter(F.col("token") == entry["token"]).count() == 1


def publish(spark: SparkSession, path: str, entry: dict) -> int:
    """Commit ``entry`` under the next free number, which is returned."""
    entry = {"token": uuid.uuid4().hex, **entry}
    number = _last_number(spark, path)
    for _ in range(MOST_TRIES):
        number += 1
        if _create(spark, f"{_folder(path)}/{number:012d}.json", entry):
            return number
    raise RuntimeError(f"no free commit number after {MOST_TRIES} tries")


def live(spark: SparkSession, path: str) -> DataFrame:
    """The entries that count now: of each run the last one, of those after the last clearing."""
    files, at = _file_system(spark, _folder(path))
    if not files.exists(at):
        return spark.createDataFrame([], f"{ENTRY_TYPE}, number long")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long")
    entries = spark.read.schema(ENTRY_TYPE).json(_folder(path)).withColumn("number", number)
    cleared = entries.filter("op = 'clear'").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    newest = W.partitionBy("run").orderBy(F.desc("number"))
    kept = entries.filter((F.col("op") == "append") & (F.col("number") > cleared))
    return kept.withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place")
