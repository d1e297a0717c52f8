"""Near-duplicate documents: one-permutation hashing, bands, star-shaped candidate edges.

Equal shingle sets become one node first, so copies cost nothing further on. One hash of
each shingle gives bin and value; empty bins are filled by optimal densification (each tries
bins in an order of its own until one is filled), so small sets agree in as many bins as
their similarity says. Bands of bins are buckets. In a bucket only the node that shares
most is compared with the others, on full sets. Where that leaves a bucket with more than one
component, its members meet once more in an exact similarity join: shingles in a common order, rarest first, and
prefix, length and positional filters. So no link between members is lost, and sets that are alike but not
alike enough, which differ in their rare shingles, are hardly ever paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylight.llm.graph import components
from staylight.llm.texts import documents
from staylight.workspace import written

_EMPTY = np.uint64(2**64 - 1)
#: Orders of bins are tried this far before the next filled bin is taken; no order of fewer bins misses all.
_TRIES = 8192


@dataclass(frozen=True)
class Hashing:
    """``words``: per shingle. ``bands`` x ``rows``: bins; a pair at the limit of 0.8 shares no bucket with
    probability (1 - 0.8 ** rows) ** bands, 4e-7. ``percent``: least similarity."""

    words: int = 5
    bands: int = 28
    rows: int = 4
    percent: int = 80


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words; a text with fewer is one run. Words end at
    ASCII white space, and only A-Z are lower-cased, which is what bytes do."""
    found = text.encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    size = min(words, n)
    s = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    return np.unique(_mixed(s))


@lru_cache(4)
def _orders(bins: int) -> np.ndarray:
    """Row t, column i: the bin that empty bin i tries at step t."""
    numbers = np.arange(_TRIES * bins, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (_mixed(_mixed(numbers)) % np.uint64(bins)).astype(np.int32).reshape(_TRIES, bins)


def signature(found: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin: the least hash in it, or that of the bin its densification leads to."""
    v = _mixed(found + np.uint64(0x632BE59BD9B4E019))
    out = np.full(bins, _EMPTY)
    np.minimum.at(out, (v % np.uint64(bins)).astype(np.int64), v // np.uint64(bins))
    filled = out != _EMPTY
    empty, orders, step, span = np.flatnonzero(~filled), _orders(bins), 0, 16
    while len(empty) and step < _TRIES:
        tried = orders[step : step + span, empty]
        hits = filled[tried]
        first, found_any = hits.argmax(0), hits.any(0)
        out[empty[found_any]] = out[tried[first, np.arange(len(empty))][found_any]]
        empty, step, span = empty[~found_any], step + span, 256
    if len(empty):
        places = np.flatnonzero(filled)
        out[empty] = out[places[np.searchsorted(places, empty) % len(places)]]
    return out


def buckets_of(found: np.ndarray, hashing: Hashing) -> np.ndarray:
    """One number per band; the band goes into it, so equal numbers mean the same band."""
    values = signature(found, hashing.bands * hashing.rows).reshape(hashing.bands, hashing.rows)
    key = np.arange(1, hashing.bands + 1, dtype=np.uint64)
    for k in range(hashing.rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


# --- tables ---------------------------------------------------------------------------
def signed(docs: DataFrame, hashing: Hashing) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_id`` (a 128-bit hash of the whole set, null for none), ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, numbers = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), hashing.words)
                sizes.append(len(found))
                names.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                numbers.append(buckets_of(found, hashing) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(numbers, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_id", "buckets"],
            )

    rows = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, buckets array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """``node`` and ``grams``: full shingle sets of the documents named in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [shingles(t.as_py(), hashing.words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "grams"]
                )

    rows = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = rows.join(nodes, rows["doc_id"] == nodes["node"], "left_semi")
    return wanted.mapInArrow(run, "node long, grams array<long>").filter(F.size("grams") > 0)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) and whether they are ``linked``, from the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    counted = pairs.join(right, "b").join(left, "a").select(
        "a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b") - common).alias("either")
    )
    return counted.groupBy("a", "b").agg(
        F.max(F.col("common") * 100 >= F.col("either") * percent).alias("linked")
    )


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _starred(nodes: DataFrame) -> DataFrame:
    """Members of buckets of two or more: ``bucket``, ``node``, ``n`` (members), ``weight``, ``centre``.

    A node's weight is the number of rows in its buckets: what lies in the middle of a group
    shares most buckets with most others, so the heaviest member is the centre.
    """
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    # Written, like every grouped side below, so that joins get both sides freshly dealt and can split hot keys.
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    shared = written(rows.join(sizes, "bucket").select("bucket", "node", "n"), "shared-buckets")
    weights = written(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    weighted = written(shared.join(weights, "node").select("bucket", "node", "n", "weight"), "weighted")
    heaviest = F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre")
    centres = written(weighted.groupBy("bucket").agg(heaviest), "first-centres")
    return written(weighted.join(centres, "bucket"), "bucket-members")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node`` and ``component`` of the members of buckets that hold several components."""
    found = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = written(found.select("bucket", "node", "component"), "labelled-members")
    mixed = found.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return found.join(written(mixed.select("bucket"), "mixed-buckets"), "bucket", "left_semi").select("node", "component").distinct()


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``gram``, ``node``, ``component``, ``size``, ``pos``, ``first``: the rarest shingles of each set in the order of their
    frequency, as many as one of them must be shared with any partner that is not larger. ``first`` marks those of
    which one must be shared with a partner that is not smaller. Shingles of one component only are left out."""
    size = F.size("grams").alias("size")
    grams = sets.join(nodes, "node").select("node", "component", size, F.explode("grams").alias("gram"))
    grams = written(grams, "open-shingles")
    counted = grams.groupBy("gram").agg(
        F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    met = grams.join(written(counted, "shingle-counts"), "gram")
    order = Window.partitionBy("node", "size").orderBy("c", "gram")
    placed = met.withColumn("pos", F.row_number().over(order)).filter("lo <> hi")
    share, both = f"(size * {percent} + 99) div 100", f"(size * {2 * percent} + {99 + percent}) div {100 + percent}"
    kept = placed.filter(f"pos <= size - {share} + 1").withColumn("first", F.expr(f"pos <= size - {both} + 1"))
    return kept.select("gram", "node", "component", "size", "pos", "first")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` from different components, among them all that are linked.

    Of two sets the smaller one must share one of its ``first`` shingles, the larger one any of its prefix. What two
    sets can have in common from a shared shingle on is bounded by what follows it in each."""
    prefixes = written(_prefixes(nodes, sets, percent), "prefixes")
    small = prefixes.filter("first").select("gram", *(F.col(c).alias(f"s_{c}") for c in ("node", "component", "size", "pos")))
    large = prefixes.select("gram", "node", "component", "size", "pos")
    needed = f"((size + s_size) * {percent} + {99 + percent}) div {100 + percent}"
    return (
        small.join(large, "gram")
        .filter("component <> s_component and (s_size < size or (s_size = size and s_node < node))")
        .filter(f"s_size * 100 >= size * {percent} and 1 + least(size - pos, s_size - s_pos) >= {needed}")
        .select(*_pair("node", "s_node"))
        .distinct()
    )


def links(docs: DataFrame, nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """Components of ``nodes`` (node, buckets): ``node``, ``component`` for every node with a link.

    The centre of each bucket is compared with the rest. Then members of buckets that still hold several
    components are joined exactly, and what is linked joins the components.
    """
    members = _starred(nodes)
    stars = members.filter("node <> centre").select(*_pair("centre", "node")).distinct()
    sets = written(_sets(docs, members.select("node").distinct(), hashing), "shingle-sets")
    compared = written(_compared(stars, sets, hashing.percent), "compared")
    labels = written(components(compared.filter("linked").select("a", "b")), "components")
    # In a bucket of two its only pair has been compared.
    left = written(_open(members.filter("n > 2"), labels), "open-nodes")
    if left.isEmpty():
        return labels
    open_sets = written(sets.join(left.select("node").distinct(), "node", "left_semi"), "open-sets")
    pairs = written(_prefix_pairs(left, open_sets, hashing.percent).join(compared, ["a", "b"], "left_anti"), "pairs")
    more = written(_compared(pairs, open_sets, hashing.percent).filter("linked"), "compared")
    if more.isEmpty():
        return labels
    # Labels stand for all links so far; new links join them.
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return written(components(known.unionByName(more.select("a", "b"))), "components")


def near_duplicates(docs: DataFrame, hashing: Hashing = Hashing()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    reachable over links, its own without any) and ``kept`` (whether that is its own).

    Two texts are linked if their sets of distinct shingles have at least ``percent`` similarity
    (common over either). Texts without words have no shingles and no links. Repeated rows
    share one component. Rows that share an id but not the text are each linked by their
    own text. A row without an id has no component and is kept.
    """
    found = written(signed(docs, hashing), "signatures")
    usable = found.filter("set_id is not null and doc_id is not null")
    classes = written(usable.groupBy("set_id").agg(F.min("doc_id").alias("node")), "classes")
    met = usable.join(classes, "set_id")
    nodes = written(met.filter("doc_id = node").select("node", "buckets"), "nodes")
    labels = links(docs, nodes, hashing)
    with_class = found.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    return with_class.join(labels, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "node", "doc_id"))).alias("kept"),
    )


def representatives(docs: DataFrame, hashing: Hashing = Hashing()) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the smallest id, rows without an id last.

    Rows are numbered first and compared one by one, so rows that share an id, or have none, stand for
    themselves: a clean text does not go because a near copy has its id, and a repeated row leaves once.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), hashing)
    groups = written(found.select(F.col("doc_id").alias(row), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return rows.join(written(first.select(row), "representatives"), row, "left_semi").drop(row)
