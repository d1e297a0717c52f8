import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline as cp
from staylight.llm import bpe, decontaminate, line_dedup, pu_quality
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_near


@pytest.fixture(scope="module")
def stages(spark, sample):
    """What each stage got and returned on the smallest tables."""
    from staylight.workspace import written

    folder, _ = sample
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES:
        result = written(stage(spark, docs, folder), name)
        out.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in out}


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_order_and_registration():
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()


def test_columns_and_counts(stages):
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.dtypes == before.dtypes
            rows = after.select("text", "n_chars").collect()
            assert 0 < len(rows) <= before.count() and all(len(r["text"]) == r["n_chars"] for r in rows)


def test_quality_stage(spark, sample, stages):
    before, after = stages["quality"]
    net = pu_quality.learn(before, spark.read.parquet(f"{sample[0]}/labels.parquet"))
    want = {i for i, t in texts(before).items() if net.score(np.array([pu_quality.features(t)]))[0] >= 0.7}
    assert set(texts(after)) == want and len(want) < before.count()


def test_line_stage(stages):
    before, after = map(texts, stages["line_dedup"])
    want = {i: words for i, (words, gone) in brute_lines(before, line_dedup.Runs().words).items() if words or not gone}
    assert {i: (t or "").split() for i, t in after.items()} == want and after != before


def test_near_stage(stages):
    before, after = map(texts, stages["near_dedup"])
    kept = {i for i, (_, _, k) in brute_near(list(before.items()), 5).items() if k}
    assert after == {i: before[i] for i in kept}


def test_decontamination_stage(spark, sample, stages):
    before, after = map(texts, stages["decontamination"])
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{sample[0]}/benchmark.parquet").collect()]
    finder = decontaminate.Finder(items, decontaminate.Matching())
    assert after == {i: t for i, t in before.items() if not finder.find(decontaminate.plain(t))}
    assert not any(item in decontaminate.plain(t) for t in after.values() for _, item in items)


def test_token_stage_and_run(spark, sample, stages):
    before, after = stages["tokens"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = {
        i: (n := library.encode_ordinary(t), len(n), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(before).items()
    }
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded_sha256"]) for r in after.collect()}
    assert got == want
    whole = {r["doc_id"]: r["decoded_sha256"] for r in cp.run(spark, sample[0]).collect()}
    assert whole == {i: h for i, (_, _, h) in want.items()}


def test_missing_values_and_empty_tables(spark, sample, make):
    folder = sample[0]
    odd = make([(None, "a text without an id. " * 3), (1, None), (2, ""), (3, "word"), (3, "word")])
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0
        assert stage(spark, odd, folder).count() <= 5
    assert cp.line_dedup(spark, odd, folder).count() == 5
    # The repeated row leaves once; the row without an id and the two without words stand for themselves.
    assert cp.near_dedup(spark, odd, folder).count() == 4


def test_quality_keeps_all_documents_when_nothing_is_learnt(spark, make, tmp_path):
    docs = make([f"A clean text, number {i}, with a few plain words in it." for i in range(8)])
    spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.quality(spark, docs, str(tmp_path)).count() == 8
