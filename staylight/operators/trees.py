"""All forests, or all boosted models, of a repeated cross-validation, grown together over shared scans.

Every row knows its fold in each repeat, and the bin of each of its numbers for each (repeat, held-out fold). One scan
counts the outcomes per tree, node, feature and bin for many fits at once; the driver chooses the splits and broadcasts
them. So a level of all trees takes one scan (forests: of one repeat), however many fits there are. The trees are those of
Spark ML's estimators, whose parameters they take: the same bins, impurities, limits, pruning, losses and votes. Only
the random draws are others: they follow from a row's number, the seed, the fit and the tree, so neither the layout of the
table nor a repeated task changes them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.operators.models import CATEGORIES, NUMBERS
from staylight.workspace import Journal

#: Fixed values, as in Spark ML: rows whose numbers a fit's bins are taken from.
SAMPLE = 10_000
#: Rows worked on at once, rows that are worth a task, and trees whose sums travel in one row.
SLICE, ROWS_PER_TASK, TREES_PER_ROW = 16_384, 2_000, 50
#: Boosting rounds between two tables of margins.
ROUNDS_PER_TABLE = 8
#: Parts in which the sums of many tasks are added up before they meet, and the deepest trees.
SUM_PARTS, DEEPEST = 64, 8
#: Positive rows are counted in the upper half of a number, all rows in the lower one.
UPPER = 32


# --- rows -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Binned:
    """Training rows as scans read them: ``table`` has ``_row``, ``_y``, ``_f`` (a byte per repeat: the fold) and ``_x`` (a
    byte per category slot, then a byte per fit and number: the bin)."""

    table: DataFrame
    folds: int
    repeats: int
    slots: int
    numbers: int
    bins: int
    #: fits x numbers x (bins - 1), padded with infinity.
    cuts: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return self.folds, self.repeats, self.slots, self.numbers


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Where to split a sample into at most ``bins`` bins: between all its values, or nearest to even shares."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    below = np.cumsum(counts)[:-1]
    targets = np.arange(1, bins) * (len(values) / bins)
    after = np.clip(np.searchsorted(below, targets), 1, len(below) - 1)
    nearest = np.where(targets - below[after - 1] <= below[after] - targets, after - 1, after)
    return middles[np.unique(nearest)]


def _bytes(values: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int64) * flat.shape[1]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]
    ).cast(pa.binary())


def _rows_of(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """The reverse of :func:`_bytes`."""
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(values, np.uint8)[ends[0] : ends[1]].reshape(len(column), -1).view(kind)


def binned(
    encoded: DataFrame, label: str, row: str, folds: int, repeats: int, bins: int, journal: Journal, *keep: str
) -> Binned:
    """Cut the numbers of every row into the bins of each fit, which come from rows the fit trains on only."""
    arrays = encoded.select(
        F.col(row).alias("_row"), F.col(label).cast("double").alias("_y"),
        vector_to_array(CATEGORIES).alias("_c"), vector_to_array(NUMBERS).alias("_n"),
        F.array(*(F.col(f"fold_{r}").cast("int") for r in range(repeats))).alias("_f"), *keep,
    )
    slots, m, rows = arrays.agg(F.max(F.size("_c")), F.max(F.size("_n")), F.count("*")).first()
    if not rows:
        raise ValueError("there are no training rows")
    # About SAMPLE of the rows that each fit trains on.
    share = min(1.0, SAMPLE * folds / max(1, folds - 1) / rows)
    some = arrays if share == 1 else arrays.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = some.select("_n", "_f").toArrow()
    x = np.array(found["_n"].to_pylist(), float).reshape(-1, m)
    fold = np.array(found["_f"].to_pylist(), int).reshape(-1, repeats)
    cuts = np.full((folds * repeats, m, bins - 1), np.inf)
    for i in range(folds * repeats):
        mine = x[fold[:, i // folds] != i % folds]
        for j in range(m):
            points = cut_points(mine[:, j], bins)
            cuts[i, j, : len(points)] = points
    shared = encoded.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            wide = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            values, out = wide(3), np.empty((n, slots + len(cuts) * m), np.uint8)
            out[:, :slots] = wide(2)
            for i in range(len(cuts)):
                for j in range(m):
                    # A value on a cut lies below it.
                    out[:, slots + i * m + j] = np.searchsorted(cuts[i, j], values[:, j], side="left")
            y = pa.array(batch.column(1).to_numpy().astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), y, _bytes(wide(4).astype(np.uint8)), _bytes(out), *batch.columns[5:]],
                ["_row", "_y", "_f", "_x", *batch.schema.names[5:]],
            )

    cores = encoded.sparkSession.sparkContext.defaultParallelism
    tasks = min(cores, math.ceil(rows / ROWS_PER_TASK))
    if arrays.rdd.getNumPartitions() < tasks:
        arrays = arrays.repartition(tasks, "_row")
    kinds = ", ".join(f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"_row long, _y tinyint, _f binary, _x binary, {kinds}"
    table = journal.table(f"binned-{bins}", lambda: arrays.mapInArrow(run, schema))
    return Binned(table, folds, repeats, slots, m, bins, cuts)


class _Block:
    """Some rows of a batch: features as columns."""

    def __init__(self, batch: pa.RecordBatch, shape: tuple[int, int, int, int]):
        self.folds, self.repeats, self.slots, self.numbers = shape
        at = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        self.n = batch.num_rows
        self.row = at["_row"].to_numpy().astype(np.uint64)
        self.y = at["_y"].to_numpy().astype(np.int64)
        self.fold = _rows_of(at["_f"])
        self.x = np.ascontiguousarray(_rows_of(at["_x"]).T)
        self.flat = self.x.ravel()
        self.margin = np.ascontiguousarray(_rows_of(at["_m"], np.float64).T) if "_m" in at else None

    def start(self, fit: int, feature: np.ndarray) -> np.ndarray:
        """Where in ``flat`` the bins of a feature begin: a category slot, or a number in the bins of this fit."""
        return np.where(feature < self.slots, feature, feature + fit * self.numbers) * self.n

    def leaf(self, fit: int, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """The node on a level, counted from the left, that rows ``at`` come to in a tree."""
        node, start = np.zeros(len(at), np.int64), self.start(fit, feature)
        for level in range(levels):
            here = node + ((1 << level) - 1)
            node = 2 * node + (self.flat[start[here] + at] > cut[here])
        return node

    def trained_on(self, fit: int) -> np.ndarray:
        return np.flatnonzero(self.fold[:, fit // self.folds] != fit % self.folds)

    def held_out(self, fit: int) -> np.ndarray:
        return np.flatnonzero(self.fold[:, fit // self.folds] == fit % self.folds)


def _blocks(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int, int]) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    """Blocks of at most SLICE rows, and the rows they are made of."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            if n + part.num_rows > SLICE:
                whole, held, n = pa.concat_batches(held), [], 0
                yield whole, _Block(whole, shape)
            held.append(part)
            n += part.num_rows
    if held:
        whole = pa.concat_batches(held)
        yield whole, _Block(whole, shape)


# --- draws ----------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of 64 depends on every bit of ``x`` (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*of: object) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=8).digest(), "little"))


def _bag(mixed: np.ndarray, key: np.uint64, rate: float, with_replacement: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the drawn rows and how often each is drawn."""
    drawn = _mixed(mixed ^ key)
    top = float(1 << 64)
    if not with_replacement:
        inside = np.flatnonzero(drawn <= np.uint64(min(int(rate * top), (1 << 64) - 1)))
        return inside, np.ones(len(inside), np.int64)
    chance = below = math.exp(-rate)
    inside = np.flatnonzero(drawn >= np.uint64(int(below * top)))
    drawn, times = drawn[inside], np.ones(len(inside), np.int64)
    for k in range(1, 64):
        chance *= rate / k
        below += chance
        if below >= 1 - 2.0**-53:
            break
        more = drawn >= np.uint64(int(below * top))
        if not more.any():
            break
        times += more
    return inside, times


# --- trees ----------------------------------------------------------------------------
@dataclass
class Trees:
    """Whole binary trees: ``feature`` and ``cut`` (... x nodes, the root first, then level by level) and ``value`` (... x leaves).
    A row goes right where its bin is over the cut; below a node without a split all go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, shape: tuple[int, ...], depth: int) -> Trees:
        nodes = (1 << depth) - 1
        return cls(np.zeros((*shape, nodes), np.int64), np.full((*shape, nodes), 255, np.uint8), np.zeros((*shape, nodes + 1)))


def _summed(
    table: DataFrame, shape: tuple[int, int, int, int], keys: int, size: int, kind: type,
    add: Callable[[_Block, np.ndarray], None],
) -> np.ndarray:
    """``add`` called on all blocks of a task with its own (keys x size) totals; the totals of all tasks added up, always in
    the same order. As many numbers as one task holds reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((keys, size), kind), False
        for _, block in _blocks(batches, shape):
            add(block, total)
            seen = True
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(keys)), pa.array(np.full(keys, part)), _bytes(total)], ["key", "part", "sums"]
            )

    schema = "key long, part long, sums binary"

    def whole(held: pa.Table) -> pa.Table:
        total = np.zeros(size, kind)
        for at in np.argsort(held.column("part").to_numpy()):
            total += np.frombuffer(held.column("sums")[int(at)].as_py(), kind)
        return pa.table({"key": held.column("key")[:1], "part": held.column("part")[:1], "sums": [total.tobytes()]})

    sums = table.mapInArrow(run, schema)
    if table.rdd.getNumPartitions() > SUM_PARTS:
        sums = sums.groupBy("key", F.pmod("part", F.lit(SUM_PARTS))).applyInArrow(whole, schema)
    found = np.zeros((keys, size), kind)
    for r in sums.groupBy("key").applyInArrow(whole, schema).collect():
        found[r["key"]] = np.frombuffer(r["sums"], kind)
    return found


# --- forests --------------------------------------------------------------------------
def _tried(strategy: str, features: int) -> int:
    """How many features a node tries."""
    return {"all": features, "sqrt": math.ceil(math.sqrt(features))}[strategy]


def can_grow(estimator: object, balanced: bool) -> bool:
    """Whether the trees of an estimator can be grown here: those with parameters as our candidates have them."""
    if isinstance(estimator, RandomForestClassifier):
        known = estimator.getFeatureSubsetStrategy() in ("all", "sqrt") and estimator.getImpurity() == "gini"
    elif isinstance(estimator, GBTClassifier):
        known = estimator.getFeatureSubsetStrategy() == "all" and estimator.getImpurity() == "variance" and not balanced
    else:
        return False
    plain = estimator.getMinInfoGain() == 0 and estimator.getMinWeightFractionPerNode() == 0
    return known and plain and 1 <= estimator.getMaxDepth() <= DEEPEST and estimator.getMaxBins() <= 256


def grow_forests(rows: Binned, forest: RandomForestClassifier, repeat: int, weight: np.ndarray, seed: int) -> Trees:
    """The forests of all folds of a repeat (folds x trees). ``weight``: folds x 2, of either outcome."""
    spark = rows.table.sparkSession
    folds, bins, d = rows.folds, rows.bins, rows.slots + rows.numbers
    count, depth, least = forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()
    rate, replaced = forest.getSubsamplingRate(), forest.getBootstrap()
    some = _tried(forest.getFeatureSubsetStrategy(), d)
    per_fold = math.ceil(count / TREES_PER_ROW)
    trees = Trees.empty((folds, count), depth)
    keys = np.array([[_key(seed, "bag", repeat, k, t) for t in range(count)] for k in range(folds)])
    grown = _Grown(depth)
    for level in range(depth):
        nodes = 1 << level
        order = np.random.default_rng([seed, repeat, level]).random((folds, count, nodes, d))
        tried = np.sort(np.argsort(order, axis=-1)[..., :some], axis=-1)
        shared, cells = spark.sparkContext.broadcast((trees, tried, keys)), nodes * some * bins

        def add(block: _Block, total: np.ndarray) -> None:
            trees, tried, keys = shared.value
            view, mixed = total.reshape(folds, -1, cells), _mixed(block.row)
            place = np.ascontiguousarray((np.arange(nodes * some) * bins).reshape(nodes, some).T)
            for k in range(folds):
                fit = repeat * folds + k
                mine = block.trained_on(fit)
                own, once = mixed[mine], 1.0 + (block.y[mine] << UPPER)
                for t in range(count):
                    bag, times = _bag(own, keys[k, t], rate, replaced)
                    at = mine[bag]
                    node = block.leaf(fit, at, trees.feature[k, t], trees.cut[k, t], level)
                    # tried x rows: long inner loops.
                    found = np.take(block.start(fit, tried[k, t]).T, node, axis=1)
                    found += at
                    cell = np.take(place, node, axis=1)
                    cell += block.flat[found]
                    view[k, t] += np.bincount(cell.ravel(), np.tile(times * once[bag], some), cells).astype(np.int64)

        found = _summed(rows.table, rows.shape, folds * per_fold, TREES_PER_ROW * cells, np.int64, add)
        shared.unpersist()
        found = found.reshape(folds, -1, nodes, some, bins)[:, :count]
        low, yes = found & ((1 << UPPER) - 1), found >> UPPER
        w0, w1 = (weight[:, c].reshape(folds, 1, 1, 1, 1) for c in (0, 1))
        n, p = np.cumsum(low, axis=-1), np.cumsum(yes, axis=-1)
        left, left_yes, all_n, all_yes = n[..., :-1], p[..., :-1], n[..., -1:], p[..., -1:]

        def gini(n: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = yes * w1, (n - yes) * w0
            whole = a + b
            share = a / np.where(whole > 0, whole, 1.0)
            return whole, 1.0 - share * share - (1.0 - share) * (1.0 - share)

        whole, impurity = gini(all_n, all_yes)
        (wl, il), (wr, ir) = gini(left, left_yes), gini(all_n - left, all_yes - left_yes)
        gain = impurity - (wl * il + wr * ir) / np.where(whole > 0, whole, 1.0)
        gain = np.where((left >= least) & (all_n - left >= least), gain, 0.0).reshape(folds, count, nodes, -1)
        best = gain.argmax(axis=-1)
        splits = grown.split(gain.max(axis=-1) > 0)
        at = 2**level - 1
        which = np.take_along_axis(tried, (best // (bins - 1))[..., None], -1)[..., 0]
        trees.feature[..., at : at + nodes] = np.where(splits, which, 0)
        trees.cut[..., at : at + nodes] = np.where(splits, best % (bins - 1), 255)
        pick = lambda a: np.take_along_axis(np.broadcast_to(a, left.shape).reshape(gain.shape), best[..., None], -1)[..., 0]
        sides = [(pick(left), pick(left_yes)), (pick(all_n - left), pick(all_yes - left_yes))]
        if level == 0:
            grown.add(all_n[..., 0, 0], all_yes[..., 0, 0])
        grown.add(*(np.stack([sides[0][c], sides[1][c]], axis=-1).reshape(folds, count, 2 * nodes) for c in (0, 1)))
    w0, w1 = (weight[:, c].reshape(folds, 1, 1) for c in (0, 1))
    shares, says = [], []
    for n, yes in grown.stats:
        a, b = yes * w1, (n - yes) * w0
        shares.append(a / np.where(a + b > 0, a + b, 1.0))
        says.append(a > b)
    trees.value[:] = grown.values(shares, says)
    return trees


def forest_scores(rows: Binned, trees: Trees, repeat: int, row: str, *keep: str) -> DataFrame:
    """``row``, ``keep`` and ``probability``: every row's share of votes by the forest that has not seen it, in one scan."""
    shared, shape = rows.table.sparkSession.sparkContext.broadcast(trees), rows.shape
    folds, count = trees.value.shape[:2]
    depth = trees.value.shape[-1].bit_length() - 1

    def scores(block: _Block) -> np.ndarray:
        trees, votes = shared.value, np.zeros(block.n)
        for k in range(folds):
            fit = repeat * folds + k
            at = block.held_out(fit)
            for t in range(count):
                votes[at] += trees.value[k, t][block.leaf(fit, at, trees.feature[k, t], trees.cut[k, t], depth)]
        return votes / count

    return _scored(rows.table, shape, scores, row, *keep)


def _scored(table: DataFrame, shape: tuple, scores: Callable[[_Block], np.ndarray], row: str, *keep: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, shape):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("_row", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores(block))], [row, *keep, "probability"])

    return table.mapInArrow(run, f"`{row}` long, {kinds}, probability double")


class _Grown:
    """What the nodes of all trees hold, level by level."""

    def __init__(self, depth: int):
        self.depth, self.stats, self.splits = depth, [], []

    def add(self, n: np.ndarray, total: np.ndarray) -> None:
        self.stats.append((n, total))

    def split(self, wanted: np.ndarray) -> np.ndarray:
        """Nodes of the next level that are split: not below one that is not."""
        if self.splits:
            wanted = wanted & np.repeat(self.splits[-1], 2, axis=-1)
        self.splits.append(wanted)
        return wanted

    def values(self, of: list[np.ndarray], says: list[np.ndarray] | None = None) -> np.ndarray:
        """Per place on the last level the value of the leaf there. Sibling leaves that say the same become one."""
        leaf = [~s for s in self.splits] + [np.ones(of[-1].shape, bool)]
        for level in reversed(range(self.depth)) if says is not None else ():
            one, two = leaf[level + 1][..., ::2], leaf[level + 1][..., 1::2]
            leaf[level] = leaf[level] | (one & two & (says[level + 1][..., ::2] == says[level + 1][..., 1::2]))
        value, done = of[0], leaf[0]
        for level in range(1, self.depth + 1):
            value, done = np.repeat(value, 2, axis=-1), np.repeat(done, 2, axis=-1)
            value = np.where(done, value, of[level])
            done = done | leaf[level]
        return value


# --- boosted models -------------------------------------------------------------------
def grow_boosted(rows: Binned, boosting: GBTClassifier, seed: int, journal: Journal, step: str) -> Trees:
    """The boosted models of all fits (fits x rounds); values hold their weights. Finished rounds are steps of the journal."""
    spark, depth = rows.table.sparkSession, boosting.getMaxDepth()
    fits, rounds = rows.folds * rows.repeats, boosting.getMaxIter()
    trees = Trees.empty((fits, rounds), depth)
    kinds = "fit int, round int, feature array<long>, cut array<int>, value array<double>"
    for first in range(0, rounds, ROUNDS_PER_TABLE):
        some = range(first, min(rounds, first + ROUNDS_PER_TABLE))

        def grown() -> DataFrame:
            state = _with_margins(rows, trees, first).persist(StorageLevel.MEMORY_AND_DISK)
            for m in some:
                _grow_round(state, rows, boosting, trees, first, m, seed)
            state.unpersist()
            return spark.createDataFrame([
                (i, m, trees.feature[i, m].tolist(), trees.cut[i, m].tolist(), trees.value[i, m].tolist())
                for i in range(fits) for m in some
            ], kinds)

        for r in journal.table(f"{step}/rounds={first:05d}", grown).collect():
            at = r["fit"], r["round"]
            trees.feature[at], trees.cut[at], trees.value[at] = r["feature"], r["cut"], r["value"]
    return trees


def _with_margins(rows: Binned, trees: Trees, rounds: int) -> DataFrame:
    """The rows with ``_m``: the margin that the first rounds of each fit give a row."""
    shape, depth = rows.shape, trees.value.shape[-1].bit_length() - 1
    known = Trees(trees.feature[:, :rounds].copy(), trees.cut[:, :rounds].copy(), trees.value[:, :rounds].copy())
    shared = rows.table.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, shape):
            margin = np.zeros((shape[0] * shape[1], block.n))
            for fit in range(len(margin)):
                at = block.trained_on(fit)
                margin[fit, at] = _margin(block, fit, at, shared.value, range(rounds), depth)
            at = [batch.schema.get_field_index(c) for c in ("_row", "_y", "_f", "_x")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in at), _bytes(margin.T)], ["_row", "_y", "_f", "_x", "_m"]
            )

    return rows.table.mapInArrow(run, "_row long, _y tinyint, _f binary, _x binary, _m binary")


def _margin(block: _Block, fit: int, at: np.ndarray, trees: Trees, rounds: range, depth: int) -> np.ndarray:
    total = np.zeros(len(at))
    for m in rounds:
        total += trees.value[fit, m][block.leaf(fit, at, trees.feature[fit, m], trees.cut[fit, m], depth)]
    return total


def _grow_round(
    state: DataFrame, rows: Binned, boosting: GBTClassifier, trees: Trees, first: int, m: int, seed: int
) -> None:
    """Grow the tree of round ``m`` in all fits; ``state`` has the margins of the rounds before ``first``."""
    spark, fits, bins = state.sparkSession, rows.folds * rows.repeats, rows.bins
    slots, numbers = rows.slots, rows.numbers
    depth, least, share = boosting.getMaxDepth(), boosting.getMinInstancesPerNode(), boosting.getSubsamplingRate()
    keys = np.array([_key(seed, "part", i, m) for i in range(fits)])
    grown = _Grown(depth)
    for level in range(depth):
        nodes, wide = 1 << level, 1 + slots
        recent = Trees(*(a[:, first : m + 1].copy() for a in (trees.feature, trees.cut, trees.value)))
        shared, size = spark.sparkContext.broadcast(recent), nodes * (wide + numbers * bins) * 2

        def add(block: _Block, total: np.ndarray) -> None:
            recent, mixed = shared.value, _mixed(block.row)
            sign = 2.0 * block.y - 1.0
            part = np.zeros((fits, nodes, 2, block.n))
            tail = total[:, nodes * wide * 2 :].reshape(fits, numbers * nodes * bins, 2)
            place = (np.arange(numbers) * nodes * bins)[:, None]
            for i in range(fits):
                mine = block.trained_on(i)
                at = mine[_bag(mixed[mine], keys[i], share, False)[0]]
                if m == 0:
                    left = sign[at]
                else:
                    margin = block.margin[i, at] + _margin(block, i, at, recent, range(m - first), depth)
                    # Minus the gradient of the loss 2 log(1 + exp(-2 y F)).
                    left = 4.0 * sign[at] / (1.0 + np.exp(2.0 * sign[at] * margin))
                node = block.leaf(i, at, recent.feature[i, m - first], recent.cut[i, m - first], level)
                part[i, node, 0, at], part[i, node, 1, at] = left, 1.0
                cell = np.take(block.x[slots + i * numbers : slots + (i + 1) * numbers], at, axis=1).astype(np.int64)
                cell += place
                cell += node * bins
                cell = cell.ravel()
                tail[i, :, 0] += np.bincount(cell, np.tile(left, numbers), len(tail[i]))
                tail[i, :, 1] += np.bincount(cell, minlength=len(tail[i]))
            z = np.vstack([np.ones((1, block.n)), block.x[:slots]])
            sums = (z @ part.reshape(-1, block.n).T).reshape(wide, fits, nodes * 2)
            total[:, : nodes * wide * 2] += sums.transpose(1, 0, 2).reshape(fits, -1)

        found = _summed(state, rows.shape, fits, size, np.float64, add)
        shared.unpersist()
        head = found[:, : nodes * wide * 2].reshape(fits, wide, nodes, 2).transpose(0, 2, 1, 3)
        tail = found[:, nodes * wide * 2 :].reshape(fits, numbers, nodes, bins, 2).transpose(0, 2, 1, 3, 4)
        whole = head[:, :, :1]
        below = np.cumsum(tail, axis=3)[..., :-1, :].reshape(fits, nodes, -1, 2)
        left = np.concatenate([whole - head[:, :, 1:], below], axis=2)  # fits x nodes x cuts x (sum, rows)
        right = whole - left
        score = lambda a: a[..., 0] ** 2 / np.maximum(a[..., 1], 1.0)
        gain = (score(left) + score(right) - score(whole)) / np.maximum(whole[..., 1], 1.0)
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, 0.0)
        best = gain.argmax(axis=-1)
        # Sums of doubles: what is lost in their last digits is no gain.
        splits = grown.split(gain.max(axis=-1) > 1e-13)
        number = np.maximum(best - slots, 0)
        at = 2**level - 1
        which = np.where(best < slots, best, slots + number // (bins - 1))
        trees.feature[:, m, at : at + nodes] = np.where(splits, which, 0)
        trees.cut[:, m, at : at + nodes] = np.where(splits, np.where(best < slots, 0, number % (bins - 1)), 255)
        pick = lambda a: np.take_along_axis(a, best[..., None, None], 2)[:, :, 0]
        if level == 0:
            grown.add(whole[:, :, 0, 1], whole[:, :, 0, 0])
        sides = np.stack([pick(left), pick(right)], axis=2).reshape(fits, 2 * nodes, 2)
        grown.add(sides[..., 1], sides[..., 0])
    rate = 1.0 if m == 0 else boosting.getStepSize()
    trees.value[:, m] = rate * grown.values([total / np.maximum(n, 1.0) for n, total in grown.stats])


def boosted_scores(rows: Binned, trees: Trees, row: str, *keep: str) -> DataFrame:
    """``keep`` and ``probability``: the mean over the repeats of each row's score by the model that has not seen it, in one
    scan."""
    shared = rows.table.sparkSession.sparkContext.broadcast(trees)
    repeats, fits, rounds = rows.repeats, rows.folds * rows.repeats, trees.value.shape[1]
    depth = trees.value.shape[-1].bit_length() - 1

    def scores(block: _Block) -> np.ndarray:
        total = np.zeros(block.n)
        for fit in range(fits):
            at = block.held_out(fit)
            total[at] += 1.0 / (1.0 + np.exp(-2.0 * _margin(block, fit, at, shared.value, range(rounds), depth)))
        return total / repeats

    return _scored(rows.table, rows.shape, scores, row, *keep).drop(row)
