import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from staylight.llm import token_count as tc
from staylight.llm.queries import op9_token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_the_library(spark, sample, library):
    folder, docs = sample
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op9_token_count(spark, folder).collect()}
    want = {i: (len((t or "").encode()), n := count(library, t), n > 1024) for i, t in docs}
    assert got == want


def test_splices_equal_whole_texts(library):
    rng, aligned = random.Random(1), tc._aligned(library)
    parts = ["the ", "'re", "  ", "\n\n", "naïve", " 12", "<|endoftext|>", "<|endof", "中文", "🙂", "aaaa", " ", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 80))) for _ in range(300)]
    texts += ["a" * 500, " " * 500, "<|endoftext|>" * 40, " \n" * 200]
    for text in texts:
        for chunk, overlap in ((30, 4), (50, 40), (97, 20)):
            assert tc.count_spliced(text, aligned, 17, chunk, overlap) == count(library, text)


def test_odd_texts_nulls_clashes_and_empty_table(make, odd_texts, library):
    texts = [*odd_texts, "some words <|endoftext|> and more\n" * 300]
    docs = make([*enumerate(texts), (None, "lost"), (3, "word")]).selectExpr("*", "1 as n_tokens", "2 as n_bytes")
    got = tc.count_tokens(docs, PATH, limit=5, chunk=100, overlap=8).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted([*(count(library, t) for t in texts), count(library, "lost"), count(library, "word")])
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_go_whole(make, name):
    path = public_tokenizers.path(name)
    texts = ["Some words here.", "", "x" * 300]
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(make(texts), path, chunk=50).collect()}
    if name.endswith(".json"):
        want = [count(Tokenizer.from_file(path), t) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert got == dict(enumerate(want))
