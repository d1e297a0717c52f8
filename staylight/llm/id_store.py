"""Token ids in files of separately compressed documents that share one zstandard dictionary.

Short documents compress badly alone; a dictionary trained on serialised id arrays makes up for it, and any one document
can still be read by one seek. A file holds, in ascending order of document ids:

    magic, SHA-256 of the dictionary            header
    one zstandard frame per document            the ids, little-endian unsigned 32-bit
    one fixed-size entry per document           id, whether it is missing, offset, packed bytes, tokens
    entry offset, number of documents, magic    footer

Text is cut before single spaces between words, where the byte-level cutting starts a new piece whatever stands
around; each such unit is encoded by the tokenizer library once and remembered. Units that are a plain word with its
punctuation, whose pieces are known beforehand, go to the library's model at once.

Files go below a folder that all executors share. Their names are new in every attempt, and only names that a
finished task reported are used.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.llm.texts import documents
from staylight.workspace import new_path, written

MAGIC = b"IDSTORE1"
ENTRY = np.dtype([("id", "<i8"), ("missing", "u1"), ("offset", "<u8"), ("packed", "<u8"), ("tokens", "<u8")])
_FOOTER = struct.Struct("<QQ8s")
#: The dictionary: its bytes, the documents it is trained on (at most twice as many are read), and their longest text.
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_CHARS = 64 << 10, 2_000, 4_096
LEVEL = 3
#: Bytes of remembered units, counted as text and ids, in one worker.
REMEMBERED_BYTES = 160 << 20
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20
#: Most tasks that files are dealt over.
MOST_TASKS = 10_000

_SIGNS = b",.;:!?#*$%&"
_CUTTERS = " \n" + _SIGNS.decode()
_LETTER = rb"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: A unit that is one piece: a word or signs, perhaps after a space, or a line break.
_PLAIN = re.compile(rb" ?(?:" + _LETTER + rb")+| ?[" + re.escape(_SIGNS) + rb"]+|\n")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, the others
    in order from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


# --- encoding -------------------------------------------------------------------------
def _kind(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


_IS_SIGN, _IS_LETTER = _kind(_SIGNS), _kind(bytes(b for b in range(128) if chr(b).isalpha()))
_IS_SOLID = _kind(bytes(range(33, 127)))


def unit_starts(view: np.ndarray) -> np.ndarray:
    """A mark at each byte where a byte-level cutting starts a new piece for certain: at a single space or line break between
    characters that are no white space, after such a line break, and at signs that follow a letter.

    Beside ASCII only the letters of Latin-1 (lead byte C3) count as known; around others nothing is cut."""
    latin = np.zeros(len(view), bool)
    latin[1:] = view[:-1] == 0xC3
    letter = _IS_LETTER[view] | (latin & (view != 0x97) & (view != 0xB7))
    solid = _IS_SOLID[view] | latin
    starts = np.zeros(len(view), bool)
    if len(view) < 3:
        return starts
    before, after = solid[:-2], solid[2:] | (view[2:] == 0xC3)
    between = before & after
    starts[1:-1] = between & ((view[1:-1] == 32) | (view[1:-1] == 10))
    starts[2:] |= between & (view[1:-1] == 10)
    starts[1:] |= letter[:-1] & _IS_SIGN[view[1:]]
    return starts


class Encoder:
    """Texts to ids as the tokenizers library gives them, units remembered."""

    def __init__(self, model: bytes, limit: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        kind = self.tokenizer.pre_tokenizer
        # Cutting is exact for byte-level pieces if nothing rewrites or reaches over the text around a space.
        self.cuts = (
            self.tokenizer.normalizer is None
            and type(kind).__name__ == "ByteLevel"
            and not kind.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word for t in added)
            and not any(c in t.content or t.content.isalpha() for t in added for c in _CUTTERS)
        )
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        #: The number of each unit; the ids of all units one after the other, and where each ends.
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.held = array("I"), array("q"), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, unit: bytes, ids: list[int]) -> None:
        self.known[unit] = len(self.ends)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.held += len(unit) + 4 * len(ids) + 180

    def _learn(self, units: list[bytes]) -> None:
        hard, tokenize = [], self.tokenizer.model.tokenize
        for unit in units:
            if _PLAIN.fullmatch(unit) is None:
                hard.append(unit)
            else:
                letters = unit.decode("latin-1").translate(_BYTE_LETTERS)
                self._keep(unit, [t.id for t in tokenize(letters)])
        for start in range(0, len(hard), 4096):
            some = hard[start : start + 4096]
            for unit, ids in zip(some, self._library([u.decode() for u in some])):
                self._keep(unit, ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The serialised ids of each text."""
        if not self.cuts:
            return [np.array(ids, "<u4").tobytes() for ids in self._library(texts)]
        if self.held > self.limit:
            self._forget()
        coded = [t.encode() for t in texts]
        ends = np.cumsum([len(t) for t in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        begins = unit_starts(data)
        begins[0] = begins[ends[ends < len(data)]] = True
        starts = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(starts, len(data)))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([u for u in distinct if u not in self.known])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        # The ids of all units one after the other: each takes its range of what is remembered.
        stops = np.array(self.ends)
        stop = stops[number]
        sizes = stop - np.where(number > 0, stops[number - 1], 0)
        until = np.cumsum(sizes)
        flat = np.array(self.ids, "<u4")[np.arange(until[-1]) + np.repeat(stop - until, sizes)]
        token_ends = np.concatenate([[0], until])[np.searchsorted(starts, ends)]
        cuts = [0, *token_ends.tolist()]
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


_LOADED: dict[str, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One per vocabulary in each Python worker: what it remembers serves later tasks too."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(model)
    return _LOADED[key]


def _slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of bounded text, or one row."""
    lengths = pc.binary_length(batch.column(1).cast(pa.large_binary())).to_pylist()
    start = held = 0
    for i, length in enumerate(lengths):
        if held and held + length > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


# --- the dictionary -------------------------------------------------------------------
def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for arrays like these; where there are too few to train on, the arrays themselves."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def train_dictionary(docs: DataFrame, model: bytes, sample: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from about ``sample`` short documents, chosen by the hash of id and text and encoded in one
    task. It sets how small the files are, never what is read from them."""
    short = docs.filter(F.length("text").between(1, chars))
    share = min(1.0, sample / max(1, short.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    some = short.filter(chosen).limit(2 * sample).select("text").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = _encoder(model), []
        for batch in batches:
            found += encode(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([trained(sorted(found))], pa.binary())})

    rows = some.mapInArrow(run, "dictionary binary").collect()
    return rows[0]["dictionary"] if rows else b""


# --- writing --------------------------------------------------------------------------
def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """One file, written front to back; its entries stay in memory (33 bytes a document)."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.entries = out, []
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=LEVEL, **shared)
        head = MAGIC + hashlib.sha256(dictionary).digest()
        out.write(head)
        self.at, self.tokens = len(head), 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is None, self.at, len(frame), len(ids) // 4))
        self.at += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(_FOOTER.pack(self.at, len(self.entries), MAGIC))
        self.out.close()


@dataclass(frozen=True)
class IdStore:
    """Where the files are: the folder, the dictionary's file, and the stored list of files: ``part`` (their
    order), ``file``, ``documents``, ``tokens``, ``first_id``, ``last_id``."""

    folder: str
    dictionary: str
    files: DataFrame

    def load_dictionary(self) -> bytes:
        system, root = _open(self.folder)
        with system.open_input_stream(f"{root}/{self.dictionary}") as stream:
            return stream.read()


_FILES = "part int, file string, documents long, tokens long, first_id long, last_id long"


def write_ids(docs: DataFrame, model_path: str, end: int | None = 2, folder: str | None = None) -> IdStore:
    """Encode the texts of ``docs`` (doc_id, text) and write them in ascending order of ``doc_id``.

    ``end`` is appended to every document. Missing texts count as empty; rows without an id come first, rows that
    share one are ordered by their texts' hashes; other columns are left behind. An empty table writes no file. Rows
    are dealt by ranges of (id, hash), so one id with very many texts spreads over several files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    model = Path(model_path).read_bytes()
    docs = documents(docs).select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, model)
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    name = f"{hashlib.sha256(dictionary).hexdigest()}.zdict"
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((model, dictionary))
    tail = b"" if end is None else struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, dictionary = shared.value
        encode = file = first = last = None
        for batch in batches:
            for part in _slices(batch):
                if file is None:
                    encode, file = _encoder(model), f"{uuid.uuid4().hex}.ids"
                    system, root = _open(folder)
                    writer = _Writer(system.open_output_stream(f"{root}/{file}", compression=None), dictionary)
                    first = part.column(0)[0].as_py()
                ids = part.column(0).to_pylist()
                for doc_id, coded in zip(ids, encode(part.column(1).to_pylist())):
                    writer.add(doc_id, coded + tail)
                last = ids[-1]
        if file is not None:
            writer.close()
            row = [TaskContext.get().partitionId(), file, len(writer.entries), writer.tokens, first, last]
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], ["part", "file", "documents", "tokens", "first_id", "last_id"]
            )

    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = written(dealt.select("doc_id", "text").mapInArrow(run, _FILES), "id-files")
    return IdStore(folder, name, files)


# --- reading --------------------------------------------------------------------------
class IdFile:
    """One open file: its entries, and documents by place or by id."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        size = file.size()
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not an id file")
        if file.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        file.seek(size - _FOOTER.size)
        at, count, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC or at + count * ENTRY.itemsize + _FOOTER.size != size:
            raise ValueError("the file is not whole")
        file.seek(at)
        self.entries = np.frombuffer(file.read(count * ENTRY.itemsize), ENTRY)
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.unpack = zstandard.ZstdDecompressor(**shared)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["tokens"])]).astype(np.int64)

    def ids(self, place: int) -> bytes:
        entry = self.entries[place]
        self.file.seek(int(entry["offset"]))
        found = self.unpack.decompress(self.file.read(int(entry["packed"])))
        if len(found) != 4 * int(entry["tokens"]):
            raise ValueError("a document does not have the number of tokens its entry says")
        return found

    def places(self, doc_id: int) -> range:
        """Where documents of this id stand; entries without an id come first."""
        skip = int(self.entries["missing"].sum())
        known = self.entries["id"][skip:]
        return range(skip + int(np.searchsorted(known, doc_id, "left")), skip + int(np.searchsorted(known, doc_id, "right")))


def _begun(store: IdStore) -> list[tuple[str, int]]:
    """Files in order, each with the tokens before it: one row per writing task, on the driver."""
    found, before = [], 0
    for row in store.files.orderBy("part").select("file", "tokens").collect():
        found.append((row["file"], before))
        before += row["tokens"]
    return found


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, packed_bytes long"


def read_ids(spark: SparkSession, store: IdStore, ids: bool = False) -> DataFrame:
    """Every document: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32`` (unsigned),
    ``packed_bytes``, and ``ids`` themselves if wanted."""
    begun = _begun(store)
    shared = spark.sparkContext.broadcast(store.load_dictionary())
    folder = store.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with system.open_input_file(f"{root}/{name}") as handle:
                    file = IdFile(handle, shared.value)
                    rows, held = [], 0
                    for place in range(len(file.entries)):
                        found = file.ids(place)
                        rows.append((place, zlib.crc32(found), found if ids else None))
                        held += len(found) if ids else 64
                        if held > 8 << 20:
                            yield _read_batch(file, rows, before, ids)
                            rows, held = [], 0
                    yield _read_batch(file, rows, before, ids)

    files = spark.createDataFrame(begun, "file string, before long").repartition(max(1, min(len(begun), MOST_TASKS)))
    return files.mapInArrow(run, _READ + ", ids binary" * ids)


def _read_batch(file: IdFile, rows: list[tuple], before: int, ids: bool) -> pa.RecordBatch:
    places = np.array([r[0] for r in rows], np.int64)
    some = file.entries[places]
    columns = {
        "doc_id": pa.array(some["id"].astype(np.int64), mask=some["missing"].astype(bool)),
        "start": pa.array(file.starts[places] + before),
        "n_tokens": pa.array(some["tokens"].astype(np.int64)),
        "ids_crc32": pa.array([r[1] for r in rows], pa.int64()),
        "packed_bytes": pa.array(some["packed"].astype(np.int64)),
    }
    if ids:
        columns["ids"] = pa.array([r[2] for r in rows], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def fetch_ids(wanted: DataFrame, store: IdStore) -> DataFrame:
    """``doc_id`` and ``ids`` of the wanted documents (column ``doc_id``), by a seek for each."""
    spark, folder = wanted.sparkSession, store.folder
    files = store.files.filter("last_id is not null").select("file", "part", "first_id", "last_id")
    listed = files.orderBy("part").collect()
    low = np.array([-(1 << 63) if r["first_id"] is None else r["first_id"] for r in listed], np.int64)
    high, names = np.array([r["last_id"] for r in listed], np.int64), [r["file"] for r in listed]
    shared = spark.sparkContext.broadcast((names, low, high, store.load_dictionary()))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high, _ = shared.value
        for batch in batches:
            pairs = [
                (names[k], i)
                for i in batch.column(0).to_pylist()
                for k in range(int(np.searchsorted(high, i, "left")), int(np.searchsorted(low, i, "right")))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["file", "doc_id"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name = file = handle = None
        for batch in batches:
            for n, i in zip(*(c.to_pylist() for c in batch.columns)):
                if n != name:
                    if handle is not None:
                        handle.close()
                    handle = system.open_input_file(f"{root}/{n}")
                    name, file = n, IdFile(handle, shared.value[3])
                found = [file.ids(p) for p in file.places(i)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(found), pa.int64()), pa.array(found, pa.binary())], ["doc_id", "ids"]
                )
        if handle is not None:
            handle.close()

    ids = wanted.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
    placed = ids.mapInArrow(seek, "file string, doc_id long")
    return placed.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(run, "doc_id long, ids binary")
