import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from staylight.llm.id_store import Encoder, IdFile, fetch_ids, read_ids, trained, write_ids
from staylight.llm.queries import op13_id_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_query_equals_the_library(spark, sample, library):
    folder, docs = sample
    want, start = [], 0
    for doc_id, text in sorted(docs):
        coded = ids(library, text)
        want.append((doc_id, start, len(coded) // 4, zlib.crc32(coded)))
        start += len(coded) // 4
    found = op13_id_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == want


def test_units_encode_as_whole_texts(library):
    encode = Encoder(open(PATH, "rb").read(), limit=50_000)
    assert encode.cuts
    rng = random.Random(4)
    parts = ["the", "'re", " ", "  ", "\n\n", "\n", "naïve", " 12", "<|endoftext|>", "<|endof", "中文", "🙂", "\x1c", "\x85",
             "᠎", "　", ".", "'s", " '", "\t", "\r", "É", "×", ",", "#", "Don't", " word", " "]
    for _ in range(1500):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3)]
        assert encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_other_vocabularies_go_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Encoder(open(path, "rb").read())
    text = "Some  Words here, <|endoftext|> and more"
    assert not encode.cuts
    assert encode([text]) == [np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_order_nulls_repeats_clashes_seeks_and_empty_table(spark, make, odd_texts, library):
    rows = [*((i * 3 - 6, t) for i, t in enumerate(odd_texts)), (None, "lost"), (None, "found"), (3, "again"), (3, "again"), (3, "other")]
    docs = make(rows).selectExpr("*", "1 as start", "2 as ids", "'x' as h")
    store = write_ids(docs, PATH)
    found = read_ids(spark, store, ids=True).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in found) == sorted(
        (i is not None, i or 0, ids(library, t)) for i, t in rows
    )
    before = 0
    for r in found:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (before, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        before += r["n_tokens"]
    order = [r["doc_id"] for r in found]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    wanted = spark.createDataFrame([(3,), (0,), (3,), (None,), (77,)], "doc_id long")
    fetched = sorted((r["doc_id"], bytes(r["ids"])) for r in fetch_ids(wanted, store).collect())
    assert fetched == sorted((i, ids(library, t)) for i, t in rows if i in (3, 0))
    empty = write_ids(docs.limit(0), PATH)
    assert read_ids(spark, empty).count() == 0 and fetch_ids(wanted, empty).count() == 0


def test_another_dictionary_or_a_broken_file_is_refused(spark, make):
    store = write_ids(make(["some words", "and some more"]), PATH)
    system, root = fs.FileSystem.from_uri(store.folder)
    name = store.files.first()["file"]
    with system.open_input_file(f"{root}/{name}") as file:
        with pytest.raises(ValueError, match="another dictionary"):
            IdFile(file, b"other")
        file.seek(0)
        whole = file.read()
    with pytest.raises(ValueError, match="not whole"):
        IdFile(pa.BufferReader(whole[:-3]), store.load_dictionary())


def test_a_shared_dictionary_makes_short_documents_smaller(spark, sample):
    folder, _ = sample
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "substr(text, 1, 300) as text")
    store = write_ids(docs, PATH)
    read = read_ids(spark, store).selectExpr("sum(packed_bytes) as packed", "sum(n_tokens) as n").first()
    assert len(store.load_dictionary()) > 1000 and read["packed"] < 0.55 * 4 * read["n"]
    assert trained([]) == b"" and trained([b"abc"]) == b"abc"
