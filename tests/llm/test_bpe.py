import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from staylight.llm import bpe
from staylight.llm.queries import op8_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_query_equals_the_library(spark, sample, library):
    folder, docs = sample
    got = {r["doc_id"]: r for r in op8_byte_bpe(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        want = library.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_random_texts(ranks, library, monkeypatch):
    rng, alphabet = random.Random(3), " \n\t'strvelmd A1é½_-!\x1c中🙂\U0001e5f0"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["'re'LL've 'dog", "a'll 's''s 'rest", " " * 700, "ab" * 2000, "x" * 300, ""]
    for remembered in (10**6, 50):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        encoder = bpe.Encoder(ranks)
        got = encoder.encode(texts)
        assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in texts]
        assert [encoder.decode(g).decode() for g in got] == texts


def test_another_pattern(ranks):
    pattern = r"\p{L}+|\P{L}"
    want = tiktoken.Encoding("two", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert ids(bpe.Encoder(ranks, pattern).encode(["some words, 12 and more"])[0]) == want.encode_ordinary(
        "some words, 12 and more"
    )


def test_character_classes_are_the_librarys(ranks):
    for pattern, kind in ((r"\p{L}", 1), (r"\p{N}", 2), (r"\s", 3)):
        one = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        codes = [c for c in range(0, 0x32000, 7) if not 0xD800 <= c < 0xE000]
        assert all(bool(one.encode_ordinary(chr(c))) == (bpe._classes()[c] == kind) for c in codes)


def test_matrix_and_heap_agree(ranks):
    pairs, rng = bpe.Pairs(ranks), random.Random(5)
    texts = ["".join(rng.choices("the nag io", k=rng.randint(1, 90))).encode() for _ in range(300)]
    matrix = np.full((len(texts), 90), -1, np.int64)
    for row, text in zip(matrix, texts):
        row[: len(text)] = [ranks[bytes([b])] for b in text]
    for got, text in zip(bpe.merge_matrix(matrix, pairs), texts):
        assert got.tolist() == bpe.merge_long(text, ranks).tolist()


def test_odd_texts_nulls_clashes_and_empty_table(make, odd_texts, library):
    docs = make([*enumerate(odd_texts), (None, "lost"), (3, "word"), (3, "word")]).selectExpr("*", "1 as ids", "2 as n_tokens")
    coded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert len(coded) == len(odd_texts) + 3
    by = {}
    for r in coded:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(odd_texts):
        assert any(ids(r["ids"]) == library.encode_ordinary(text or "") and r["decoded"].decode() == (text or "") for r in by[i])
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_ranks_must_hold_every_byte():
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0})
