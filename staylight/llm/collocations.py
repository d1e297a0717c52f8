"""Phrases whose words stand together more often than apart, per language, found best first.

A phrase of 2 to ``longest`` words scores by its weakest cut: with ``a`` occurrences of the phrase, ``l`` of what
stands before the cut and ``r`` of what follows, ``floor(2,000,000 a / (l + r))``. All words and pairs are counted.
Longer phrases grow from their prefixes, and a prefix q bounds whatever continues it: a longer phrase has at most
``a(q)`` occurrences and its cut within q has the same ``l``, while ``r`` is at least ``a``, so its score is at most
the least ``2,000,000 a(q) / (l + a(q))``. In each round a threshold per language is taken from the distribution of
the pairs' scores; only prefixes whose bound reaches it are continued, and only phrases that reach it themselves
need their neighbours on both sides for the test of containment. A language is settled once ``keep`` surviving
phrases reach its threshold, or nothing is left below it; the others go on with a lower one.

Frontiers reach the tasks as bitmaps of fixed size over hashes of (language, phrase). A phrase that is let through
by a hash it shares is counted in all places too, so counts are exact, only a few more than needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylight.workspace import written

SCALE = 2_000_000
#: Each bitmap has two to this power of bits: 8 MB.
BITMAP_BITS = 26
#: Bytes of text taken at once.
SLICE_BYTES = 4 << 20
#: The first threshold lets this many times ``keep`` pairs through, each later round as many times more.
FIRST, MORE = 4, 16
#: Parts in which a language is ranked before its best are ranked together.
RANKING_PARTS = 64


@dataclass(frozen=True)
class Mining:
    """Least occurrences, longest phrase, phrases kept per language, and the share of a phrase's occurrences (in
    percent) that a longer one must cover to replace it."""

    least: int = 30
    longest: int = 4
    keep: int = 2_000
    covered: int = 80


# --- words of a slice -----------------------------------------------------------------
def _folded() -> bytes:
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    table[9] = 32
    for b in b".,;:!?\n\x0b\x0c\r":
        table[b] = ord(".")
    return bytes(table)


_FOLDED = _folded()


@dataclass
class Words:
    """All words of some texts: the distinct ones, the number of each word in order, and its piece."""

    distinct: pa.Array
    number: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        view = np.frombuffer(b".".join(texts).translate(_FOLDED), np.uint8)
        stop = view == ord(".")
        word = ~(stop | (view == 32))
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = pa.py_buffer(np.ascontiguousarray(view[word]))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(stop)[starts])

    def windows(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words within one piece start."""
        n = len(self.number) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of ``size`` words that start at these places, and how often each does."""
        key = self.number[at]
        for i in range(1, size):
            if i > 1:  # numbers of phrases instead of products of numbers, which would not fit
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.distinct) + self.number[at + i]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        words = [self.distinct.take(pa.array(self.number[at[first] + i])) for i in range(size)]
        joined = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.large_string()).cast(pa.string()), count


# --- bitmaps --------------------------------------------------------------------------
def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _step(found: np.ndarray, word: np.ndarray) -> np.ndarray:
    found = (found ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return found ^ (found >> np.uint64(29))


def _cell(found: np.ndarray) -> np.ndarray:
    return ((found * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def _phrase_cells(langs: list[str], phrases: list[str]) -> np.ndarray:
    cells = np.zeros(len(phrases), np.int64)
    with np.errstate(over="ignore"):
        for i, (lang, phrase) in enumerate(zip(langs, phrases)):
            words = _word_hash(phrase.encode().split(b" "))
            cells[i] = _cell(reduce(_step, words[:, None], np.array([_seed(lang)])))[0]
    return cells


def bitmap(phrases: DataFrame) -> Broadcast:
    """The cells of ``phrases`` (lang, phrase), built in tasks; at most 2**20 rows of 64 cells reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _phrase_cells(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows, place = np.unique(cells >> 6, return_inverse=True)
            bits = np.zeros(len(rows), np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (cells & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(bits.view(np.int64))], ["place", "bits"])

    parts = phrases.select("lang", "phrase").mapInArrow(run, "place long, bits long")
    table = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    whole[table.column("place").to_numpy()] = table.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(whole.view(np.uint64))


def _marked(whole: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (whole[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) != 0


# --- counting -------------------------------------------------------------------------
@dataclass(frozen=True)
class Wanted:
    """Phrases of ``size`` words to count: all, or those of which all words but the last are in the bitmap
    ``heads`` or all but the first in ``tails``."""

    size: int
    heads: Broadcast | None = None
    tails: Broadcast | None = None

    def places(self, words: Words, seed: np.uint64, hashed: np.ndarray) -> np.ndarray:
        at = words.windows(self.size)
        if self.heads is None and self.tails is None:
            return at
        with np.errstate(over="ignore"):
            n = len(hashed) - self.size + 2
            parts = (hashed[i : i + n] for i in range(self.size - 1))
            cells = _cell(reduce(_step, parts, np.full(max(0, n), seed)))
        keep = np.zeros(len(at), bool)
        if self.heads is not None:
            keep |= _marked(self.heads.value, cells[at])
        if self.tails is not None:
            keep |= _marked(self.tails.value, cells[at + 1])
        return at[keep]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language in runs of bounded size, or one text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        coded = text.encode()
        held.setdefault(lang, []).append(coded)
        size[lang] = size.get(lang, 0) + len(coded)
        if size[lang] > SLICE_BYTES:
            yield lang, held.pop(lang)
            size[lang] = 0
    yield from held.items()


def count_phrases(docs: DataFrame, wanted: list[Wanted], least: int = 1) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f``: exact counts of the wanted phrases of at least ``least`` occurrences, counted
    within slices first. Size 0 holds the number of all words of a language, where single words are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _slices(batch):
                words = Words.of(texts)
                if not len(words.number):
                    continue
                seed, hashed = _seed(lang), None
                if any(w.heads or w.tails for w in wanted):
                    hashed = _word_hash(words.distinct.to_numpy(zero_copy_only=False).tolist())[words.number]
                found = [(w.size, *words.counted(w.places(words, seed, hashed), w.size)) for w in wanted]
                if wanted[0].size == 1:
                    found.append((0, pa.array([""]), np.array([len(words.number)])))
                for size, phrases, count in found:
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrases, pa.array(count.astype(np.int64))],
                        ["lang", "size", "phrase", "f"],
                    )

    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = read.mapInArrow(run, "lang string, size int, phrase string, f long")
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


# --- scores ---------------------------------------------------------------------------
def _part(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (lang, size, phrase, f) of two or more words with ``l``, ``r``, ``score`` of their lowest-scoring cut and
    the ``bound`` of whatever continues them. Phrases of which a part is not in ``counts`` are left out."""
    words = phrases.withColumn("words", F.split("phrase", " "))
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), _part(1, F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    parts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", F.explode(sides).alias("side"))
    parts = parts.select("lang", "size", "phrase", "a", "k", "side.left", "side.part")
    known = counts.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("of"), "f")
    met = parts.join(known, (F.col("lang") == F.col("in_lang")) & (F.col("part") == F.col("of")))
    cut = (
        met.groupBy("lang", "size", "phrase", "a", "k")
        .agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
        .filter("l is not null and r is not null")
        .withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)"))
        .withColumn("bound", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + a)"))
    )
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (
        cut.groupBy("lang", "size", "phrase", "a")
        .agg(lowest, F.min("bound").alias("bound"), F.count("*").alias("cuts"))
        .filter(F.col("cuts") == F.col("size") - 1)
        .select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score", "bound")
    )


def thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """``lang`` and ``least``: the score that ``rank`` pairs of the language reach, 0 where it has no more. Pairs are
    counted per score first: of those there are at most 1,000,001."""
    per = pairs.groupBy("lang", "score").agg(F.count("*").alias("rows"))
    from_top = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = per.withColumn("upto", F.sum("rows").over(from_top)).filter(F.col("upto") >= rank)
    found = reached.groupBy("lang").agg(F.max("score").alias("least"))
    return per.select("lang").distinct().join(found, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def _neighbours(longer: DataFrame) -> DataFrame:
    """For each phrase one word shorter than a counted one, the most occurrences of one that holds it."""
    words = longer.withColumn("words", F.split("phrase", " "))
    n = F.col("size") - 1
    inner = F.explode(F.array(_part(1, n), _part(2, n)))
    return words.select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))


def _last_words(phrases: DataFrame, size: int) -> DataFrame:
    words = phrases.withColumn("words", F.split("phrase", " "))
    return words.select("lang", _part(F.col("size") - size + 1, size).alias("phrase"))


def _round(docs: DataFrame, base: DataFrame, pairs: DataFrame, least: DataFrame, how: Mining) -> DataFrame:
    """All phrases that reach their language's score in ``least`` and survive."""
    reach = lambda found, column: found.join(least, "lang").filter(F.col(column) >= F.col("least")).drop("least")
    counts, level, kept = base, pairs, []
    for size in range(3, how.longest + 1):
        frontier, contenders = reach(level, "bound"), reach(level, "score")
        wanted = [Wanted(size, bitmap(frontier), bitmap(contenders))]
        wanted += [Wanted(s, bitmap(_last_words(frontier, s - 1))) for s in range(3, size)]
        found = written(count_phrases(docs, wanted, how.least), f"phrases-{size}")
        longer = found.filter(F.col("size") == size)
        # A shorter phrase may have been counted before; it has the same count then.
        counts = counts.unionByName(found).dropDuplicates(["lang", "size", "phrase"])
        kept.append(_survivors(contenders, longer, how))
        level = written(scored(longer, counts), f"scored-{size}")
    kept.append(reach(level, "score"))
    columns = ("lang", "size", "phrase", "a", "l", "r", "score")
    return reduce(DataFrame.unionByName, [k.select(*columns) for k in kept])


def _survivors(contenders: DataFrame, longer: DataFrame, how: Mining) -> DataFrame:
    met = contenders.join(_neighbours(longer), ["lang", "phrase"], "left")
    covered = F.expr(f"cast(within as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {how.covered}")
    return met.filter(F.col("within").isNull() | ~covered)


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each language with their ``rank``, taken in parts first, so that no task ranks a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKING_PARTS))
    first = Window.partitionBy("lang", "part").orderBy(*order)
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= keep)
    whole = Window.partitionBy("lang").orderBy(*order)
    return some.drop("part").withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= keep)


def mine_collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of each language.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line breaks into pieces, and these at blanks and tabs into
    words. Phrases inside a longer one that covers ``covered`` percent of their occurrences are dropped. Ties go by
    ``a``, then by the phrase in UTF-8 order. A missing text counts as empty, a missing language as ``und``; repeated
    rows count as often as they stand there; other columns do not matter. A table without phrases gives no row.
    """
    if not 3 <= how.longest:
        raise ValueError("phrases of at least three words must be allowed")
    docs = docs.select("lang", "text")
    base = written(count_phrases(docs, [Wanted(1), Wanted(2)], how.least), "words-and-pairs")
    totals = base.filter("size = 0").select("lang", F.col("f").alias("n"))
    pairs = written(scored(base.filter("size = 2"), base), "scored-2")
    rank, open_pairs, done = FIRST * how.keep, pairs, []
    while open_pairs.take(1):
        least = written(thresholds(open_pairs, rank), "thresholds")
        found = written(_round(docs, base, open_pairs, least, how), "survivors")
        enough = found.groupBy("lang").agg(F.count("*").alias("rows"))
        state = least.join(enough, "lang", "left").withColumn("settled", F.expr(f"least = 0 or rows >= {how.keep}"))
        state = written(state.select("lang", F.coalesce("settled", F.lit(False)).alias("settled")), "settled")
        done.append(found.join(state.filter("settled"), "lang", "left_semi"))
        open_pairs = open_pairs.join(state.filter("not settled"), "lang", "left_semi")
        rank *= MORE
    if not done:
        done = [pairs.select("lang", "size", "phrase", "a", "l", "r", "score")]
    best = _best(reduce(DataFrame.unionByName, done), how.keep)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
