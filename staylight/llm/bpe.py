"""Byte-level BPE: texts to token ids by a file of ranks, and back.

Texts are cut into pieces, and equal pieces are encoded once. Pieces of similar length stand
as rows in one padded numpy matrix; in each round every row merges its leftmost pair
of the lowest rank, looked up in a hash table of pairs, and closes the gap. Rows
without a pair left to merge leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staylight.llm.texts import documents

#: Fixed value: the published pattern that cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: No pair: larger than any rank.
NONE = np.int64(1 << 40)
#: Cells of one matrix, and bytes beyond which a piece is merged by itself with a heap.
CELLS, LONG_PIECE = 1 << 19, 256
#: Encoded pieces that a worker remembers; then it starts anew.
REMEMBERED = 400_000
#: Characters of text that are encoded together.
GROUP_CHARS = 2_000_000


#: Letters and numbers that Unicode 16 added, which the interpreter's tables may lack.
UNICODE_16_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
UNICODE_16_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


# --- pieces ---------------------------------------------------------------------------
@lru_cache(1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point. The white space of the
    pattern is Unicode's, without the four ASCII separators that Python counts too."""
    kinds = {"L": 1, "N": 2}
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isspace() and not 0x1C <= code <= 0x1F:
            table[code] = 3
        else:
            table[code] = kinds.get(unicodedata.category(char)[0], 0)
    for value, ranges in ((1, UNICODE_16_LETTERS), (2, UNICODE_16_NUMBERS)):
        for first, last in ranges:
            table[first : last + 1] = value
    return table


def pieces(text: str) -> list[str]:
    """The matches of :data:`PATTERN`, found from character classes instead of by a regex.

    A piece begins where the class changes, but: the last white space before something
    else is a piece of its own, and if it is a blank it opens the next piece; and an
    apostrophe that opens a piece takes the ending of a contraction with it.
    """
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind, n = _classes()[codes], len(codes)
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    blank = kind == 3
    last = np.flatnonzero(blank[:-1] & ~blank[1:])
    begin[last] = True
    begin[last + 1] = codes[last] != 32
    quote = np.flatnonzero((codes[:-1] == 39) & begin[:-1])
    if len(quote):
        after = codes[quote + 1]
        then = codes[np.minimum(quote + 2, n - 1)] * (quote + 2 < n)
        size = np.where(np.isin(after, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(after == ord(a)) & (then == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        begin[(quote + 2)[size == 3]] = False
        ends = quote + size
        begin[ends[ends < n]] = True
    at = np.flatnonzero(begin).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], n])]


def _pieces_by(pattern: str):
    if pattern == PATTERN:
        return pieces
    import regex

    return regex.compile(pattern).findall


# --- merging --------------------------------------------------------------------------
class Pairs:
    """Which two ids merge, and into what: an open-addressing hash table in numpy. The id
    of a merged pair is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.bits = max(4, (4 * len(found)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key = np.fromiter(found, np.int64, len(found))
        value = np.fromiter(found.values(), np.int64, len(found))
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, :data:`NONE` where there is none or either id is negative."""
        out = np.full(len(left), NONE, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[open_].astype(np.int64) << 32 | right[open_]
        slot = self._slot(key)
        while len(open_):
            there = self.keys[slot]
            hit = there == key
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            open_, key, slot = open_[more], key[more], (slot[more] + 1) & self.mask
        return out


def merge_matrix(ids: np.ndarray, pairs: Pairs) -> list[np.ndarray]:
    """Merge every row of ``ids`` (padded with -1 on the right) as far as it goes."""
    out: list[np.ndarray | None] = [None] * len(ids)
    rows = np.arange(len(ids))
    width = ids.shape[1]
    if width == 1:
        return [r[r >= 0] for r in ids]
    rank = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
    while len(rows):
        at = rank.argmin(1)  # the first of equals: the leftmost
        best = rank[np.arange(len(rows)), at]
        done = best == NONE
        if done.any():
            for r, row in zip(rows[done], ids[done]):
                out[r] = row[row >= 0]
            live = ~done
            rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
            if not len(rows):
                break
            used = int((ids >= 0).sum(1).max())
            ids, rank = ids[:, :used], rank[:, : used - 1]
        every, width = np.arange(len(rows)), ids.shape[1]
        ids = ids.copy()
        ids[every, at] = best
        # Close the gap: columns after the merged pair move one to the left.
        columns = np.arange(width)
        source = np.minimum(columns + (columns > at[:, None]), width - 1)
        ids = np.take_along_axis(ids, source, 1)
        ids[:, -1] = -1
        rank = np.take_along_axis(rank, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 2), 1)
        rank[:, -1] = NONE
        # Only the two pairs with the new id have another rank now.
        rank[every, np.minimum(at, width - 2)] = pairs.rank(ids[every, at], ids[every, np.minimum(at + 1, width - 1)])
        has_left = np.flatnonzero(at > 0)
        left = at[has_left] - 1
        rank[has_left, left] = pairs.rank(ids[has_left, left], ids[has_left, left + 1])
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The same merges for one long piece, with a heap of pairs: no work that grows with
    the square of its length."""
    n = len(piece)
    end, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    following, alive = list(range(1, n + 1)), [True] * n
    rank = lambda a, b: ranks.get(piece[a : end[b]])
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
    heapq.heapify(heap)
    while heap:
        r, a, b, stop = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and following[a] == b and end[b] == stop and end[a] == b):
            continue
        end[a], alive[b] = stop, False
        following[a] = following[b]
        if following[b] < n:
            previous[following[b]] = a
        for x, y in ((previous[a], a), (a, following[a])):
            if x >= 0 and y < n and (r := rank(x, y)) is not None:
                heapq.heappush(heap, (r, x, y, end[y]))
    return np.array([ranks[piece[i : end[i]]] for i in range(n) if alive[i]], np.int64)


class Encoder:
    """Ranks, pairs and remembered pieces of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 single bytes")
        self.ranks, self.pairs, self.cut = ranks, Pairs(ranks), _pieces_by(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        waiting = []
        for k, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                self.known[new[k]] = np.uint32(whole).tobytes()
            elif len(piece) > LONG_PIECE:
                self.known[new[k]] = merge_long(piece, self.ranks).astype("<u4").tobytes()
            else:
                waiting.append(k)
        waiting.sort(key=lambda k: len(raw[k]))
        start = 0
        while start < len(waiting):
            # Sorted by length: a block is as wide as its last row, and not much wider than its first.
            widest = max(4, len(raw[waiting[start]]) * 5 // 4)
            stop = start
            while stop < len(waiting) and len(raw[waiting[stop]]) <= widest and (stop - start) * widest < CELLS:
                stop += 1
            block = waiting[start:stop]
            sizes = np.array([len(raw[k]) for k in block])
            ids = np.full((len(block), int(sizes[-1])), -1, np.int64)
            ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.byte_ids[
                np.frombuffer(b"".join(raw[k] for k in block), np.uint8)
            ]
            for k, merged in zip(block, merge_matrix(ids, self.pairs)):
                self.known[new[k]] = merged.astype("<u4").tobytes()
            start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.cut(t) for t in texts]
        new = {p for ps in cut for p in ps if p not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {p for ps in cut for p in ps}
        self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, ps)) for ps in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    """One encoder per vocabulary in each Python worker."""
    key = hashlib.sha256(lines).hexdigest(), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(lines), pattern)
    return _ENCODERS[key]


# --- tables ---------------------------------------------------------------------------
def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of each row.

    Missing and empty texts have no tokens. Every row is encoded by itself, so ties and
    repeated rows give equal rows. The rank file (a vocabulary, below 100 MB) is read by the
    driver and goes to the executors as one broadcast.
    """
    lines = Path(ranks_path).read_bytes()
    if len(lines) > 100_000_000:
        raise ValueError("a rank file of over 100 MB is not a vocabulary")
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            start = 0
            for group in _groups(batch.column(1).to_pylist()):
                ids = encoder.encode(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(group)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids"],
                )
                start += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of :func:`encode_documents` with ``decoded``, the bytes that the ids stand for.
    A missing ``ids`` decodes to nothing; an id that the vocabulary lacks is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, PATTERN)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                decoded = [encoder.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"]
                )

    rows = encoded.select("doc_id", "n_tokens", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """:func:`encode_documents` and :func:`decode_documents` in one pass: each task keeps one Python worker with one
    vocabulary, and the decoded bytes come from the ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            start = 0
            for group in _groups(batch.column(1).to_pylist()):
                ids = encoder.encode(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(group)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(map(encoder.decode, ids), pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
                start += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
