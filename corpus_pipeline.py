"""The corpus pipeline: raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes what a stage
returns to the shared folder and reads it again as the next one's ``docs``. All but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where texts change.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.llm.bpe import round_trip
from staylight.llm.decontaminate import clean_documents
from staylight.llm.line_dedup import without_repeats
from staylight.llm.near_dup import representatives
from staylight.llm.pu_quality import good_documents, learn
from staylight.llm.queries import _find_package
from staylight.workspace import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject. Where no trusted positive is among
    them nothing is learnt (all weights are zero), so none is rejected."""
    _find_package(spark)
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return good_documents(docs, net) if any(w.any() for w in net.weights) else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs that stand earlier in the corpus; a text with nothing left goes."""
    _find_package(spark)
    cut = without_repeats(docs)
    left = F.col("text").isNull() | F.col("text").rlike(r"\S") | (F.col("removed_lines") == 0)
    count = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter(left).withColumn("n_chars", count).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8 or more)."""
    _find_package(spark)
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    _find_package(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit numbers) and the SHA-256 of the bytes they
    decode to, which is that of the text."""
    _find_package(spark)
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Stages that learn, cluster or tokenise have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
