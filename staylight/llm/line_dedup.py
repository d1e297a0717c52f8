"""Repeated lines and runs of words, found through window minima and removed where they come again.

A whole line (between line breaks) of ``Runs.line`` words or more that stands earlier as a whole line is cut.

Every window of ``Runs.words`` words that stands earlier in the corpus (by document id, then
place) is repeated; what such windows cover is cut, to the word, wherever sentences end. Windows are
not compared one by one. The least hash of the ``GRAM``-word pieces of a window stands for it;
neighbouring windows with the same piece are one segment, of about 7 new words on average. Equal
windows have equal pieces, so only segments whose piece comes again in the corpus are
looked at. Segments equal as a whole are settled as a whole; where segments with the same piece
differ, the first of each kind is taken apart into windows. Nothing is sampled: the
result is that of comparing all windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylight.workspace import written

_WORD = re.compile(r"\s*\S+(?:\s+\Z)?|\s+\Z")
#: Words of a piece, and pieces of a window of 20 words.
GRAM, WINDOW = 8, 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


@dataclass(frozen=True)
class Runs:
    """``words``: fewest words of a run that is deleted wherever it begins. ``line``: fewest words of a whole line
    that is deleted though it is shorter."""

    words: int = 20
    line: int = 8


def lines_of(text: str) -> list[str]:
    """Words with the blanks before them; joined they are the text again."""
    return _WORD.findall(text)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * _MIX
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2 ** 64, from 0 to n - 1."""
    out = []
    for base in (_MIX, _BACK):
        factors = np.full(n, base)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


#: What ``str.split`` splits at; the longer ones as numbers, by their bytes.
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_TWO, _THREE = ([int.from_bytes(c.encode()) for c in _BLANKS if len(c.encode()) == n] for n in (2, 3))
#: Kinds of bytes: a blank, what may begin a longer one, what ends a logical line.
_BLANK, _LEAD, _STOP = 1, 2, 4
_KINDS = bytes(
    _BLANK * (chr(c) in _BLANKS and c < 128) + _LEAD * any(c == x.encode()[0] > 127 for x in _BLANKS) + _STOP * (c in b".!?;|\n")
    for c in range(256)
)
#: ``_LOW[n]`` masks the first n bytes of a number of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PAD = b"\n" * 8


def _edges(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in UTF-8 bytes that begin with a line break and end with ``_PAD``."""
    blank = kinds & _BLANK
    lead = np.flatnonzero(kinds & _LEAD)
    if len(lead):
        two = (data[lead].astype(np.int64) << 8) | data[lead + 1]
        three = (two << 8) | data[lead + 2]
        for at, size in ((lead[np.isin(two, _TWO)], 2), (lead[np.isin(three, _THREE)], 3)):
            for k in range(size):
                blank[at + k] = _BLANK
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return turns[::2], turns[1::2]


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time, and of its size."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = stops - starts
    h = _mixed((eights[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _BACK, 2)
    more, done = np.flatnonzero(size > 8), 8
    while len(more) and done < 64:
        left = size[more] - done
        h[more] = _mixed(h[more] * _MIX + (eights[starts[more] + done] & _LOW[np.minimum(left, 8)]), done)
        more, done = more[left > 8], done + 8
    for k in more.tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : stops[k]].data)
    return h


class _Words:
    """Hashes of the words of some texts in a row, and of any stretch of them. Words compare without
    case; folding it makes no white space, so whole texts are folded at once."""

    def __init__(self, texts: list[str | None]):
        folded = [text.casefold().encode() if text else b"" for text in texts]
        joined = b"\n".join([b"", *folded, _PAD])
        data = np.frombuffer(joined, np.uint8)
        starts, stops = _edges(data, np.frombuffer(joined.translate(_KINDS), np.uint8))
        # Where each text ends, and each line.
        ends = np.cumsum([len(text) + 1 for text in folded])
        breaks = np.flatnonzero(data == 10)
        self.counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        #: Words of each line, text after text.
        self.lines = np.diff(np.searchsorted(starts, breaks), prepend=0)
        self.starts = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(folded)), self.counts)
        h = _word_hashes(data, starts, stops)
        up, self.down = _powers(1 << max(10, len(h).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])

    def stretch(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _mixed((self.sums[at + size] - self.sums[at]) * self.down[at], 1)

    def windows(self, n: int) -> np.ndarray:
        """Where whole windows of ``n`` words start, none across two texts."""
        m = len(self.owner) - n + 1
        return np.flatnonzero(self.owner[:m] == self.owner[n - 1 :]) if m > 0 else np.zeros(0, np.int64)


def _whole_lines(words: _Words, runs: Runs) -> tuple[np.ndarray, ...]:
    """Whole lines too short for a window, in the form of :func:`_segments`; each is a piece of its own."""
    starts = np.cumsum(words.lines) - words.lines
    short = (words.lines >= runs.line) & (words.lines < runs.words)
    start, size = starts[short], words.lines[short]
    owner, value = words.owner[start], words.stretch(start, size)
    return owner, start - words.starts[owner], size, _mixed(value, 3), value


def _segments(words: _Words, n: int) -> tuple[np.ndarray, ...]:
    """Text number, place, words, piece and hash of each segment of windows of ``n`` words.

    A segment ends where the place of the least piece (the leftmost of equal ones) changes, so
    no window comes twice within a segment."""
    at = words.windows(n)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    gram = min(GRAM, n)
    best = words.stretch(np.arange(len(words.owner) - gram + 1), gram)
    where = np.arange(len(best))
    have, want = 1, n - gram + 1
    while have < want:
        step = min(have, want - have)
        first = best[:-step] <= best[step:]
        best, where = np.where(first, best[:-step], best[step:]), np.where(first, where[:-step], where[step:])
        have += step
    pieces, where = best[at], where[at]
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (words.owner[at[1:]] != words.owner[at[:-1]])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(at))) + n - 1
    start = at[starts]
    owner = words.owner[start]
    return owner, start - words.starts[owner], size, pieces[starts], words.stretch(start, size)


def fingerprints(text: str, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, number of words and hash of every window of a text."""
    words = _Words([text])
    at = words.windows(runs.words)
    return at, np.full(len(at), runs.words), words.stretch(at, runs.words)


def _parts(batch: pa.RecordBatch, at: int = 1, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` characters of text (column ``at``), whatever the texts' lengths."""
    start = size = 0
    for k, text in enumerate(batch.column(at)):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= most:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


_ROW = {"doc_id": "long", "place": "int", "size": "int", "piece": "long", "print": "long"}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} {_ROW[c]}" for c in names)


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")


def _prints(docs: DataFrame, runs: Runs, names: list[str] = [*_ROW]) -> DataFrame:
    """The segments and whole lines of all texts; ``names`` are the columns to send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                words = _Words(part.column(1).to_pylist())
                found = zip(_segments(words, runs.words), _whole_lines(words, runs))
                owner, place, size, piece, value = (np.concatenate(both) for both in found)
                found = pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)),
                        pa.array(piece.view(np.int64)), pa.array(value.view(np.int64)),
                    ],
                    [*_ROW],
                )
                yield found.select(names)

    return _usable(docs).mapInArrow(run, _schema(names))


def _opened(docs: DataFrame, segments: DataFrame, runs: Runs) -> DataFrame:
    """The windows of ``segments`` (doc_id, place, size, piece), with the segment's piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = runs.words
        for batch in batches:
            for part in _parts(batch):
                words = _Words(part.column(1).to_pylist())
                listed = part.column(2)
                rows, owner = listed.flatten(), np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy())
                place, size, piece = (rows.field(k).to_numpy().astype(np.int64) for k in range(3))
                each = size - n + 1
                # Every window of every segment: the segment's number, then the step within it.
                which = np.repeat(np.arange(len(each)), each)
                at = place[which] + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
                owner = owner[which]
                value = words.stretch(words.starts[owner] + at, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)), pa.array(at.astype(np.int32)),
                        pa.array(np.full(len(at), n, np.int32)), pa.array(piece[which]), pa.array(value.view(np.int64)),
                    ],
                    [*_ROW],
                )

    listed = segments.groupBy("doc_id").agg(F.collect_list(F.struct("place", "size", "piece")).alias("segments"))
    listed = listed.withColumnRenamed("doc_id", "of")
    met = _usable(docs).join(listed, F.col("doc_id") == F.col("of")).select("doc_id", "text", "segments")
    return met.mapInArrow(run, _schema([*_ROW]))


_CONTENT = ["piece", "print", "size"]


def _firsts(rows: DataFrame) -> DataFrame:
    """Each content with its first occurrence and the number of its ``rows``."""
    return rows.groupBy(*_CONTENT).agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("rows"))


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id`` and ``span`` of the ``rows`` that are not the first of their content."""
    met = rows.join(firsts.filter("rows > 1").drop("rows"), _CONTENT)
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))
    span = F.struct(F.col("place").alias("start"), (F.col("place") + F.col("size")).alias("stop")).alias("span")
    return met.filter(~is_first).select("doc_id", span)


def repeated_spans(docs: DataFrame, runs: Runs = Runs()) -> DataFrame:
    """Per document with any, its stretches of words that stand earlier in the corpus: ``doc_id``, ``spans``
    (first word, and the word after the last).

    Ids must be unique. What is counted is written before it is joined, so that joins get both sides
    freshly dealt and Spark can split a hot piece or content. A segment that is not the first
    of its content is repeated in all its windows. Of the others those whose piece has
    several contents may share some windows; there the windows are compared themselves. Lines have only one content
    to a piece. A document's spans are at most twice as many as its words.
    """
    prints = _prints(docs, runs)
    pieces = _prints(docs, runs, ["piece"]).groupBy("piece").agg(F.count("*").alias("c"))
    pieces = written(pieces.filter("c > 1").select("piece"), "repeated-pieces")
    shared = written(prints.join(pieces, "piece", "left_semi"), "shared-segments")
    firsts = written(_firsts(shared), "first-segments")
    several = written(firsts.groupBy("piece").agg(F.count("*").alias("c")).filter("c > 1").select("piece"), "mixed-pieces")
    mixed = firsts.join(several, "piece", "left_semi").select("first.doc_id", "first.place", "size", "piece")
    windows = written(_opened(docs, mixed, runs), "windows")
    first_windows = written(_firsts(windows).filter("rows > 1"), "first-windows")
    spans = _later(shared, firsts).unionByName(_later(windows, first_windows))
    return spans.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def cut_runs(
    texts: list[bytes | None], counts: np.ndarray, spans: np.ndarray, least: int
) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """The texts (UTF-8) without what ``spans`` cover, ``counts`` of them to a text: runs of at least ``least`` words, and
    whole lines, which are shorter. Also the logical lines (they end after a line break or a sentence) that lost words, run by
    run, and the words removed.

    Where a run repeats words just before it that it overlaps (a word or phrase over and over), the first
    ``least`` words of the repetition stay, as they are the first occurrence."""
    joined = b"\n".join([b"", *[text or b"" for text in texts], _PAD])
    data, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    starts, stops = _edges(data, kinds)
    sizes = np.array([len(text or b"") for text in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    behind = np.searchsorted(starts, ends)
    first = np.append(0, behind[:-1])
    spans = spans.reshape(-1, 2).astype(np.int64) + np.repeat(first, counts)[:, None]
    # Words before which no run goes on: the first of each text.
    new = np.zeros(len(starts) + 1, bool)
    new[first] = new[-1] = True
    whole = spans[:, 1] - spans[:, 0] < least
    a, b = _stretches(_covered(spans[~whole], len(starts)), new)
    left = np.maximum(first[np.searchsorted(behind, a, "right")], a - least + 1)
    for k, (x, y, own) in enumerate(zip(starts[left].tolist(), stops[a + least - 1].tolist(), (a - left).tolist())):
        near = joined[x:y].decode().casefold().split()
        if near[own] in near[:own]:
            for d in range(1, own + 1):
                if near[own - d : len(near) - d] == near[own:]:
                    a[k] += least - d
                    break
    gone = np.concatenate([spans[whole], np.stack([a, b], 1)])
    a, b = _stretches(_covered(gone, len(starts)), new)
    of = np.searchsorted(behind, a, "right")
    stop = kinds & _STOP > 0
    runs = np.flatnonzero(stop[1:] & ~stop[:-1]) + 1
    x, y = starts[a], stops[b - 1]
    lines = np.searchsorted(runs, y) - np.searchsorted(runs, x) + (stop[x] & stop[x - 1]) + ~stop[y - 1]
    # Blanks go with the word behind them, those at the end with the last one.
    x, y = np.where(new[a], (ends - sizes)[of], stops[a - 1]), np.where(new[b], ends[of], y)
    kept: dict[int, list[int]] = {}
    for k, from_, to in zip(of.tolist(), x.tolist(), y.tolist()):
        kept.setdefault(k, [int(ends[k] - sizes[k])]).extend((from_, to))
    out = list(texts)
    for k, at in kept.items():
        at.append(int(ends[k]))
        out[k] = b"".join(joined[i:j] for i, j in zip(at[::2], at[1::2]))
    count = lambda each: np.bincount(of, each, len(texts)).astype(np.int64)
    return out, count(lines), count(b - a)


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    return (np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)).cumsum()[:n] > 0


def _stretches(inside: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and word behind the last, of each stretch of words ``inside``; none goes on at a ``new`` text."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | new[1:-1]
    ends[:-1] &= ~inside[1:] | new[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a ``key`` of its own for every row: the id; for later rows of an id, and rows without one, a
    number behind all ids."""
    of_id = F.col("doc_id").cast("long")
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, of_id)
    # A running number is only lasting once it is written.
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-rows")
    number = F.col(key)
    ids = rows.filter(of_id.isNotNull()).groupBy(of_id.alias("of")).agg(F.min(number).alias("first"), F.count("*").alias("n"))
    ids = written(ids, "ids")
    behind = ids.agg(F.coalesce(F.max("of"), F.lit(0)) + 1).first()[0]
    # Rows without an id meet nothing, so they are spread by their number.
    met = rows.select(
        of_id.alias("id"), number.alias("number"), F.coalesce(of_id, F.xxhash64(number)).alias("by"),
        F.struct(*[rows[c] for c in docs.columns]).alias("row"),
    ).join(ids.filter("n > 1"), F.col("by") == F.col("of"), "left")
    odd = F.col("id").isNull() | F.coalesce(F.col("first") != F.col("number"), F.lit(False))
    own = F.when(odd, F.col("number") + behind).otherwise(F.col("id"))
    return written(met.select(*[F.col("row")[c].alias(c) for c in docs.columns], own.alias(key)), "keyed-rows")


def without_repeats(docs: DataFrame, runs: Runs = Runs()) -> DataFrame:
    """``docs`` (all columns) with runs cut out of ``text``, plus ``removed_lines`` and ``removed_words``.

    The first occurrence of anything stays. Missing and empty texts stay as they are. Within one text, later
    repeats of a run go too. Every row is a text of its own: rows without an id, and rows after the first of
    an id, come after all others, in the order in which they are read.
    """
    names = list(docs.columns)
    at = names.index("text")
    key = "_key"
    while key in names:
        key += "_"
    rows = _keyed(docs, key)
    spans = repeated_spans(rows.select(F.col(key).alias("doc_id"), "text"), runs).select(
        F.col("doc_id").alias("_of"), F.col("spans").alias("_found")
    )
    met = rows.join(spans, rows[key] == spans["_of"], "left").select(*[rows[c] for c in names], spans["_found"])
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("removed_lines", T.LongType()), T.StructField("removed_words", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                listed = part.column(len(names))
                flat = listed.flatten()
                spans = np.stack([flat.field(k).to_numpy() for k in range(2)], 1)
                counts = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts, *removed = cut_runs(part.column(at).cast(pa.binary()).to_pylist(), counts, spans, runs.words)
                columns = part.columns[: len(names)]
                columns[at] = pa.array(texts, pa.binary()).cast(part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, removed)], schema.names)

    return met.mapInArrow(run, schema)
