"""Benchmark passages in documents, within an edit budget.

A test item with budget k is cut into k + 1 pieces. At most k edits leave one piece whole,
so a passage within the budget holds some piece exactly (pigeonhole). Pieces are sought
with one automaton; around each hit the item is verified with Myers' bit-parallel edit
distance, so nothing within the budget is missed and nothing beyond it reported. Short items
have no budget: they are sought as they are, as whole words.

Texts are compared in lower case, with runs of ASCII punctuation and white space as one
blank, and distances are counted in UTF-8 bytes of that form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylight.llm.texts import plain_text
from staylight.workspace import written

_BLANKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: The place of a piece that is a whole short item.
_WHOLE = -1


@dataclass(frozen=True)
class Matching:
    """``budget``: bytes of an item per edit allowed. ``least``: an item with fewer bytes
    is found only as whole words without an edit. ``block_bytes``: most item text that one
    automaton holds and one broadcast carries; more items take further passes."""

    budget: int = 32
    least: int = 24
    block_bytes: int = 16 << 20


def plain(text: str) -> str:
    """The compared form; each character of the result is one byte of it."""
    return b" ".join(text.lower().encode().translate(_BLANKS).split()).decode("latin-1")


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of even length, each with its place."""
    ends = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def best_match(item: str, window: str, masks: dict[str, int] | None = None) -> int:
    """The least edit distance of ``item`` to any part of ``window`` (Myers, bit-parallel)."""
    masks = masks if masks is not None else match_masks(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = m
    for char in window:
        eq = masks.get(char, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if distance < best:
            best = distance
    return best


def match_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, char in enumerate(item):
        masks[char] = masks.get(char, 0) | 1 << k
    return masks


class Finder:
    """An automaton of the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], matching: Matching):
        self.items, self.matching = items, matching
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            if len(item) < matching.least:
                places.setdefault(f" {item} ", []).append((number, _WHOLE))
                continue
            for at, piece in cut(item, len(item) // matching.budget):
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """Items within their budget in ``text`` (already plain), as (item id, distance): the least
        distance around any hit."""
        if not len(self.automaton):
            return []
        best: dict[int, int] = {}
        tried: set[tuple[int, str]] = set()
        # Blanks around the text let short items stand at its edges; places count without the first one.
        for end, (length, where) in self.automaton.iter(f" {text} "):
            end -= 1
            for number, at in where:
                if best.get(number) == 0:
                    continue
                if at == _WHOLE:
                    best[number] = 0
                    continue
                item = self.items[number][1]
                edits = len(item) // self.matching.budget
                begin = end + 1 - length - at
                window = text[max(0, begin - edits) : begin + len(item) + edits]
                if (number, window) in tried:
                    continue
                if item in window:
                    best[number] = 0
                    continue
                tried.add((number, window))
                if number not in self.masks:
                    self.masks[number] = match_masks(item)
                distance = best_match(item, window, self.masks[number])
                if distance <= edits:
                    best[number] = min(distance, best.get(number, distance))
        return sorted((self.items[n][0], d) for n, d in best.items())


def _blocks(benchmark: DataFrame, matching: Matching) -> Iterator[list[tuple[int, str]]]:
    """Items by blocks of bounded size; equal texts of one item count once."""
    block, size = [], 0
    rows = benchmark.select("item_id", plain_text().alias("text")).filter("item_id is not null").distinct()
    for row in rows.toLocalIterator():
        item = plain(row["text"])
        if not item:
            continue
        if block and size + len(item) > matching.block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    yield block


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))


def with_hits(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """``docs`` (all columns) with ``_hits``: the items found in each whole text, each with its distance.

    Missing and empty texts have none; every row is searched by itself. ``benchmark`` has item_id and
    text; items without an id, and those without a letter or digit, are not
    sought. Items go in blocks of bounded size, each a pass over the documents; a pass is
    written before the next begins, and almost always there is one.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_hits", HITS)])
    at = docs.columns.index("text")
    found, first = docs, True
    for block in _blocks(benchmark, matching):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, matching)
            for batch in batches:
                hits = [finder.find(plain(t.as_py() or "")) for t in batch.column(at)]
                new = [[{"item_id": i, "distance": d} for i, d in h] for h in hits]
                columns = list(batch.columns)
                if not first:
                    new = [old + more for old, more in zip(columns.pop().to_pylist(), new)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(new, _HITS)], schema.names)

        found = (found if first else written(found, "decontamination-pass")).mapInArrow(run, schema)
        first = False
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_items``, ``item_ids`` and ``distances`` (by item id), ``kept``
    (no item found)."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, matching)
    hits = F.sort_array("_hits")
    return found.select(
        "doc_id",
        F.size("_hits").cast("long").alias("n_items"),
        F.transform(hits, lambda h: h["item_id"]).alias("item_ids"),
        F.transform(hits, lambda h: h["distance"]).alias("distances"),
        (F.size("_hits") == 0).alias("kept"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    return with_hits(docs, benchmark, matching).filter(F.size("_hits") == 0).drop("_hits")
