"""Fill-in-middle examples, cut at lines that are found through memoized chunks.

A rolling hash cuts a text into chunks at places that its own content names, so equal passages fall into equal
chunks wherever they stand. What a chunk adds to its text is summarised once and remembered: how many lines end
in it and where, and its first and last bytes. A remembered summary is used only for the very same content. The
counts of a text's chunks added up give its number of lines and lead to the chunk in which a cut lies; the bytes at
the edges show whether a marker stands across two chunks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import documents

#: Bytes that the rolling hash sees; a chunk's least, usual and greatest size.
SPAN, LEAST, USUAL, MOST = 32, 128, 512, 4096
#: Bytes of content that one worker remembers.
REMEMBERED_BYTES = 32 << 20
#: Bytes hashed at once.
_SLAB = 1 << 20
_FACTOR = 0x9E3779B1


@dataclass(frozen=True)
class Fim:
    """Markers, the seed of the draws, and percentages: rows transformed, and those of them in spm order."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm: int = 50

    def __post_init__(self):
        marks = self.marks
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different markers are needed")
        for a in marks:
            for b in marks:
                # Else text beside a marker could make it be found too early when an output is taken apart.
                if any(a[i:].startswith(b[: len(a) - i]) for i in range(1, len(a))) or (a != b and a in b):
                    raise ValueError("no marker may begin within another or within itself")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


# --- chunks ---------------------------------------------------------------------------
def _mixed(n: int) -> np.ndarray:
    """A fixed even spread of the numbers below ``n`` over 32 bits."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


_BYTES = _mixed(256)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SPAN`` bytes that end at each place (fewer at the start), by doubling the span."""
    found, width, factor = _BYTES[data], 1, np.uint32(_FACTOR)
    while width < SPAN:
        longer = found.copy()
        longer[width:] += found[:-width] * factor
        found, width = longer, 2 * width
        factor = np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
    return found


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length. No code point is cut apart."""
    view = np.frombuffer(data, np.uint8)
    size, ends, start = len(data), [], 0
    for begin in range(0, size, _SLAB):
        head = max(0, begin - SPAN + 1)
        hashed = _rolling(view[head : begin + _SLAB])[begin - head :]
        named = np.flatnonzero(hashed < (1 << 32) // USUAL) + begin + 1
        named = named[named < size]
        named = named[(view[named] & 0xC0) != 0x80]
        for place in [*named.tolist(), min(size, begin + _SLAB)]:
            while place - start > MOST:
                end = start + MOST
                while data[end] & 0xC0 == 0x80:
                    end -= 1
                ends.append(end)
                start = end
            if place - start >= LEAST and place < begin + len(hashed):
                ends.append(place)
                start = place
    if start < size:
        ends.append(size)
    return ends


@dataclass(frozen=True)
class Chunk:
    """What a chunk adds to its text; ``lines`` are the places just after its line ends."""

    content: bytes
    lines: tuple[int, ...]
    marked: bool
    head: bytes
    tail: bytes


class Chunks:
    """Summaries of chunks by the hash of their content, each used for that content only."""

    def __init__(self, marks: tuple[str, ...], limit: int = REMEMBERED_BYTES):
        self.marks = tuple(m.encode() for m in marks)
        self.edge = max(map(len, self.marks)) - 1
        self.limit, self.held = limit, 0
        self.known: dict[int, Chunk] = {}
        self.hits = 0

    def _summary(self, content: bytes) -> Chunk:
        lines, at = [], content.find(b"\n") + 1
        while at:
            lines.append(at)
            at = content.find(b"\n", at) + 1
        marked = any(m in content for m in self.marks)
        return Chunk(content, tuple(lines), marked, content[: self.edge], content[-self.edge :] if self.edge else b"")

    def get(self, content: bytes) -> Chunk:
        key = xxhash.xxh3_64_intdigest(content)
        found = self.known.get(key)
        if found is not None and found.content == content:
            self.hits += 1
            return found
        made = self._summary(content)
        if found is None:
            self.known[key] = made
            self.held += len(content) + 8 * len(made.lines) + 300
            while self.held > self.limit:
                old = self.known.pop(next(iter(self.known)))
                self.held -= len(old.content) + 8 * len(old.lines) + 300
        return made


class Lines:
    """Lines of a whole text, known through its chunks."""

    def __init__(self, data: bytes, chunks: Chunks):
        self.starts = [0, *cut_places(data)]
        self.parts = [chunks.get(data[a:b]) for a, b in zip(self.starts, self.starts[1:])]
        self.ended = list(accumulate(len(p.lines) for p in self.parts))
        complete = self.ended[-1] if self.ended else 0
        self.size = len(data)
        self.count = complete + (self.size > 0 and not data.endswith(b"\n"))
        self.marked = any(p.marked for p in self.parts) or self._across(chunks)

    def _across(self, chunks: Chunks) -> bool:
        before = b""
        for part in self.parts:
            if before and any(m in before + part.head for m in chunks.marks):
                return True
            before = (before + part.tail)[-chunks.edge :] if chunks.edge else b""
        return False

    def end_of(self, line: int) -> int:
        """The place just after the first ``line`` lines."""
        if line == 0:
            return 0
        if not self.ended or line > self.ended[-1]:
            return self.size
        at = bisect_left(self.ended, line)
        before = self.ended[at - 1] if at else 0
        return self.starts[at] + self.parts[at].lines[line - before - 1]


# --- the transformation ---------------------------------------------------------------
def _draws(seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of ``seed:doc_id``; a missing id counts as no text."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _transformed(text: str, h: tuple[int, int, int, int], fim: Fim, chunks: Chunks) -> tuple:
    data = text.encode()
    lines = Lines(data, chunks)
    n = lines.count
    if not data or lines.marked or h[2] % 100 >= fim.rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = lines.end_of(first), lines.end_of(second)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    spm = h[3] % 100 < fim.spm
    if spm:
        out = "".join((fim.suffix, suffix, fim.prefix, prefix, fim.middle, middle))
    else:
        out = "".join((fim.prefix, prefix, fim.suffix, suffix, fim.middle, middle))
    return n, "spm" if spm else "psm", len(prefix), len(middle), out


_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """``doc_id``, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each row.

    A line ends with its ``\\n`` or with the text. Prefix and middle end after two drawn numbers of lines. ``form``
    is ``plain`` (output is the text, counts are null) where the text is empty or holds a marker, or where the draw
    leaves the row out; else ``spm`` or ``psm``. A missing text counts as empty, a missing id draws like an
    empty one; repeated rows come out alike, other columns are left behind, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(fim.marks)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                draws = zip(*(part.column(i).to_pylist() for i in range(2, 6)))
                rows = [_transformed(t, h, fim, chunks) for t, h in zip(part.column(1).to_pylist(), draws)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).select("doc_id", "text", *_draws(fim.seed)).mapInArrow(run, f"doc_id {key}, {_SCHEMA}")


def restored(output: Column, form: Column, fim: Fim = Fim()) -> Column:
    """The text that an output was made from."""
    second = F.when(form == "spm", fim.prefix).otherwise(fim.suffix)
    at_second = F.instr(output, second)
    at_middle = F.instr(output, F.lit(fim.middle))
    opening = F.when(form == "spm", len(fim.suffix)).otherwise(len(fim.prefix))
    one = F.substring(output, opening + 1, at_second - opening - 1)
    two_start = at_second + F.length(second)
    two = F.substring(output, two_start, at_middle - two_start)
    middle = F.substring(output, at_middle + len(fim.middle), F.length(output))
    built = F.when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return F.when(form == "plain", output).otherwise(built)
