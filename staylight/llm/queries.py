"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.llm.bpe import decode_documents, encode_documents
from staylight.llm.collocations import mine_collocations
from staylight.llm.decontaminate import contaminated
from staylight.llm.fim import fill_in_middle, restored
from staylight.llm.id_store import read_ids, write_ids
from staylight.llm.license_scan import scan_licenses
from staylight.llm.line_dedup import without_repeats
from staylight.llm.line_rules import clean_lines
from staylight.llm.near_dup import Hashing, near_duplicates
from staylight.llm.pu_quality import learn, scored
from staylight.llm.secret_scan import joined, scan_secrets
from staylight.llm.token_count import count_tokens
from staylight.llm.warc import archived

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of one Arrow batch: documents are large rows, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1_000


def _find_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever it was started, and keep
    Arrow batches small. On a cluster the package is installed or sent with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    return archived(_table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    found = scan_secrets(_table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return without_repeats(docs)


def op4_pu_quality(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    docs = _table(spark, sf, "documents")
    return scored(docs, learn(docs, _table(spark, sf, "labels")))


def op5_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    return near_duplicates(_table(spark, sf, "documents"), Hashing(words=4))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    return clean_lines(_table(spark, sf, "documents")).drop("clean_text")


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode_documents(encode_documents(_table(spark, sf, "documents"), ranks), ranks)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_count(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    return count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(_table(spark, sf, "documents"), wrapped=True)


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    return mine_collocations(_table(spark, sf, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    made = fill_in_middle(_table(spark, sf, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_id_store(spark: SparkSession, sf: str) -> DataFrame:
    _find_package(spark)
    store = write_ids(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, store).drop("packed_bytes")


def queries() -> dict[str, Query]:
    numbered = (
        op1_warc, op2_secret_scan, op3_line_dedup, op4_pu_quality, op5_near_dup, op6_decontamination, op7_line_rules,
        op8_byte_bpe, op9_token_count, op10_license_scan, op11_collocations, op12_fill_in_middle, op13_id_store,
    )
    return {f.__name__: f for f in numbered}
