"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session without one gets a fresh folder; a cluster session must name
    it, because a folder on one machine is not visible to the others.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="staylight-")
    spark.conf.set(_SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that
    survives lost executors and is computed once however often it is read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written whole: Spark's commit leaves its marker last."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


class Journal:
    """The steps of one long run, each a table below a folder, that a later start finds again.

    ``settings`` (anything with a lasting ``repr``) names the run: another one never meets these tables. A step
    counts once its table is committed; one that was broken off is written anew. One process
    at a time works on a run.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: object):
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(repr(settings).encode()).hexdigest()[:24]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def done(self, name: str) -> bool:
        return _committed(self.spark, self.path(name))

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step; ``build`` is called only if it is not there."""
        if not self.done(name):
            build().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))
