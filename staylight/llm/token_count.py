"""Token counts of whole texts as a tokenizer library gives them.

Huge texts go in overlapping chunks, spliced where two neighbours agree on the start
of a word-like piece. Cutting into pieces runs from left to right and looks at most one
character ahead, so from such a start on the right chunk continues as the whole text
would; and the left chunk, which begins at such a start itself, is right up to it if it
goes on for some characters. Where two chunks agree on no start, the overlap widens.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import documents

#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 256

#: text -> number of tokens, and the number of tokens before each piece by its first character.
Aligned = Callable[[str], tuple[int, dict[int, int]]]


def count_spliced(text: str, aligned: Aligned, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``margin``: characters beyond a start that a left chunk must hold."""
    begin, stop = 0, min(chunk, len(text))
    total, starts = aligned(text[begin:stop])
    skipped = 0  # tokens of this chunk that the one before has counted
    counted = 0
    while stop < len(text):
        lap, found = overlap, None
        while found is None:
            right = stop - lap
            if right <= begin + 1:  # nothing in common: this chunk grows instead
                stop = min(len(text), stop + max(chunk, stop - begin))
                total, starts = aligned(text[begin:stop])
                break
            next_stop = min(len(text), right + max(chunk, 2 * lap))
            next_total, next_starts = aligned(text[right:next_stop])
            common = [
                p for p in next_starts
                if right + p - begin in starts and right + p <= stop - margin and starts[right + p - begin] >= skipped
            ]
            if common:
                found = max(common)
            else:
                lap *= 2
        if found is not None:
            counted += starts[right + found - begin] - skipped
            begin, stop, total, starts, skipped = right, next_stop, next_total, next_starts, next_starts[found]
    return counted + total - skipped


def _aligned(tokenizer) -> Aligned:
    def run(text: str) -> tuple[int, dict[int, int]]:
        found = tokenizer.encode(text, add_special_tokens=False)
        words, offsets, starts = found.word_ids, found.offsets, {}
        for i, word in enumerate(words):
            # A token without a word is one of the vocabulary's special strings.
            if i == 0 or word is None or word != words[i - 1]:
                starts.setdefault(offsets[i][0], i)
        return len(words), starts

    return run


def _splicable(tokenizer) -> bool:
    """Whether the proof above holds: nothing rewrites the text, and byte-level pieces."""
    kind = type(tokenizer.pre_tokenizer).__name__
    return tokenizer.normalizer is None and kind == "ByteLevel"


_LOADED: dict[str, object] = {}


def _tokenizer(model: bytes, kind: str):
    """One tokenizer per vocabulary in each Python worker, on one thread."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _LOADED[key] = Tokenizer.from_buffer(model)
            _LOADED[key].no_truncation()
            _LOADED[key].no_padding()
        else:
            import sentencepiece

            _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LOADED[key]


def _counter(model: bytes, kind: str, chunk: int, overlap: int) -> Callable[[list[str]], list[int]]:
    tokenizer = _tokenizer(model, kind)
    if kind == ".model":
        return lambda texts: [len(x) for x in tokenizer.encode(texts, num_threads=1)] if texts else []
    whole = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if not _splicable(tokenizer):
        return whole
    margin = 4 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    aligned = _aligned(tokenizer)

    def count(texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        out = [0] * len(texts)
        for i, n in zip(short, whole([texts[i] for i in short])):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > chunk:
                out[i] = count_spliced(t, aligned, margin, chunk, max(overlap, 2 * margin))
        return out

    return count


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row.

    ``model_path`` is a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file. No begin, end or
    other special tokens are added; special strings inside a text count as the library takes
    them by default. Missing and empty texts have none. Vocabularies whose cutting is not
    proven to splice are run on whole texts.
    """
    kind = os.path.splitext(model_path)[1]
    if kind not in (".json", ".model"):
        raise ValueError("model_path must end in .json or .model")
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value, kind, chunk, overlap)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(count(texts), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    read = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = read.mapInArrow(run, f"doc_id {key}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
