"""All logistic fits of a repeated cross-validation, solved together by Newton steps over shared scans.

Every row knows its fold in each repeat. One scan adds up, for every (repeat, held-out fold) at once, the gradient
and the Hessian of the rows that fit trains on; the driver solves one small system per fit and broadcasts the new
weights. About ten scans settle all fits, however many there are. Each fit has its own scaling (mean and
population deviation of its training rows) and its own class weights, and solves the same problem as
:func:`staylight.operators.models.fit_stages` does with the logistic candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.operators.models import CATEGORIES, NUMBERS

#: Fixed value: weight of the loss against half the squared weights.
INVERSE_PENALTY = 0.5
#: Newton steps at most, and the decrement (relative to the objective) at which a fit is settled.
MOST_STEPS, SETTLED = 50, 1e-14
#: Features up to which the Hessians of all fits fit easily into a task (50 fits: 0.1 GB).
WIDEST = 500
#: Parts in which the tasks' sums are added up before they meet.
SUM_PARTS = 64


@dataclass(frozen=True)
class FoldFits:
    """One fit per (repeat, held-out fold), on raw features: ``weights`` (features x fits) and ``intercepts``;
    numbers are taken less ``centre``. ``rows`` and ``positives`` are those trained on."""

    folds: int
    repeats: int
    centre: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    rows: np.ndarray
    positives: np.ndarray

    def names(self) -> list[tuple[int, int]]:
        return [(r, k) for r in range(self.repeats) for k in range(self.folds)]


def _arrays(encoded: DataFrame, label: str, repeats: int, *keep: str) -> DataFrame:
    """What a scan reads: categories and numbers as arrays, the outcome, the row's folds."""
    return encoded.select(
        vector_to_array(CATEGORIES).alias("c"), vector_to_array(NUMBERS).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.array(*(F.col(f"fold_{r}").cast("int") for r in range(repeats))).alias("f"), *keep,
    )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _block(batch: pa.RecordBatch, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with a leading one, outcomes, and folds (rows x repeats)."""
    n = batch.num_rows
    z = np.hstack([np.ones((n, 1)), _matrix(batch.column(0), n), _matrix(batch.column(1), n) - centre])
    return z, batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), n)


def _sums(arrays: DataFrame, fits: int, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """``add`` called on all batches of a task with its own (fits x size) totals; the totals of all tasks added up.
    As many numbers as one task holds reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((fits, size)), False
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
                seen = True
        if seen:
            part = TaskContext.get().partitionId() % SUM_PARTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(fits)), pa.array(np.full(fits, part)), pa.array(list(total))], ["fit", "part", "sums"]
            )

    def add_up(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return table.slice(0, 1).set_column(2, "sums", pa.array([sums], pa.list_(pa.float64())))

    kinds = "fit long, part long, sums array<double>"
    parts = arrays.mapInArrow(run, kinds).groupBy("fit", "part").applyInArrow(add_up, kinds)
    whole = parts.groupBy("fit").applyInArrow(add_up, kinds)
    found = np.zeros((fits, size))
    for row in whole.collect():
        found[row["fit"]] = row["sums"]
    return found


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * margin))


def _moments(arrays: DataFrame, centre: np.ndarray, folds: int, repeats: int, m: int) -> np.ndarray:
    """Per (repeat, fold), over the rows it trains on: rows, positives, sums and square sums of the numbers."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        z, y, fold = _block(batch, centre)
        x = z[:, z.shape[1] - m :]
        values = np.hstack([np.ones((len(y), 1)), y[:, None], x, x * x])
        for r in range(repeats):
            for k in range(folds):
                total[r * folds + k] += values[fold[:, r] == k].sum(axis=0)

    held = _sums(arrays, folds * repeats, 2 + 2 * m, add).reshape(repeats, folds, -1)
    return (held.sum(axis=1, keepdims=True) - held).reshape(folds * repeats, -1)


def fit_folds(encoded: DataFrame, label: str, folds: int, repeats: int) -> FoldFits:
    """Solve all fits. ``encoded`` has the vectors of :func:`~staylight.operators.models.fit_encoder`, ``label`` and
    ``fold_0 ..``; it is read once per step, so it should be a stored table."""
    arrays = _arrays(encoded, label, repeats)
    wide, m = arrays.agg(F.max(F.size("c")), F.max(F.size("x"))).first()
    if wide is None:
        raise ValueError("there are no training rows")
    centre = np.array(arrays.agg(*(F.avg(F.col("x")[i]) for i in range(m))).first(), float) if m else np.zeros(0)
    fits = folds * repeats
    d = 1 + wide + m
    if d > WIDEST:
        raise ValueError(f"{d} features are too many for shared scans")
    moments = _moments(arrays, centre, folds, repeats, m)
    rows, yes = moments[:, 0], moments[:, 1]
    if not ((yes > 0) & (yes < rows)).all():
        raise ValueError("training rows need both outcomes")
    mean = moments[:, 2 : 2 + m] / rows[:, None]
    deviation = np.sqrt(np.maximum(moments[:, 2 + m :] / rows[:, None] - mean * mean, 0.0))
    # A constant column becomes zero.
    scale = np.where(deviation > 1e-9 * (1 + np.abs(centre)), 1 / np.where(deviation > 0, deviation, 1.0), 0.0)
    # Scaled features are this matrix times the raw ones; the leading one carries the means.
    to_scaled = np.zeros((fits, d, d))
    to_scaled[:, range(1 + wide), range(1 + wide)] = 1.0
    numbers = np.arange(1 + wide, d)
    to_scaled[:, numbers, numbers] = scale
    to_scaled[:, numbers, 0] = -mean * scale
    weight = np.stack([rows / (2 * (rows - yes)), rows / (2 * yes)], axis=1)
    penalty = np.diag([0.0] + [1.0] * (d - 1))

    def objective_parts(raw: np.ndarray, open_fits: np.ndarray) -> np.ndarray:
        shared = encoded.sparkSession.sparkContext.broadcast((raw, weight, open_fits, centre))

        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            raw, weight, open_fits, centre = shared.value
            z, y, fold = _block(batch, centre)
            outcome = y.astype(int)
            for i in open_fits:
                mine = fold[:, i // folds] != i % folds
                zi, yi, wi = z[mine], y[mine], weight[i][outcome[mine]]
                margin = zi @ raw[i]
                p = _sigmoid(margin)
                total[i, 0] += (wi * (np.logaddexp(0.0, margin) - yi * margin)).sum()
                total[i, 1 : 1 + d] += zi.T @ (wi * (p - yi))
                total[i, 1 + d :] += (zi.T @ (zi * (wi * p * (1 - p))[:, None])).ravel()

        found = _sums(arrays, fits, 1 + d + d * d, add)
        shared.unpersist()
        return found

    beta, accepted = np.zeros((fits, d)), np.zeros((fits, d))
    best = np.full(fits, np.inf)
    open_fits = np.arange(fits)
    for _ in range(MOST_STEPS):
        raw = np.einsum("fij,fi->fj", to_scaled, beta)
        found = objective_parts(raw, open_fits)
        left = []
        for i in open_fits:
            value = INVERSE_PENALTY * found[i, 0] + 0.5 * (beta[i, 1:] ** 2).sum()
            if value > best[i] * (1 + 1e-12):  # overshot: half of the step
                beta[i] = (accepted[i] + beta[i]) / 2
                left.append(i)
                continue
            accepted[i], best[i] = beta[i], value
            gradient = INVERSE_PENALTY * to_scaled[i] @ found[i, 1 : 1 + d] + penalty @ beta[i]
            curved = INVERSE_PENALTY * to_scaled[i] @ found[i, 1 + d :].reshape(d, d) @ to_scaled[i].T + penalty
            step = np.linalg.solve(curved, gradient)
            beta[i] = beta[i] - step
            if gradient @ step > SETTLED * (1 + value):
                left.append(i)
        open_fits = np.array(left, int)
        if not len(open_fits):
            break
    else:
        raise RuntimeError(f"{len(open_fits)} fits did not settle in {MOST_STEPS} steps")
    raw = np.einsum("fij,fi->fj", to_scaled, beta)
    return FoldFits(folds, repeats, centre, raw[:, 1:].T.copy(), raw[:, 0].copy(), rows, yes)


def held_out_scores(encoded: DataFrame, label: str, fits: FoldFits, *keep: str) -> DataFrame:
    """``keep`` and ``probability``: the mean over the repeats of each row's score by the fit that has not seen it,
    in one scan."""
    shared = encoded.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z, _, fold = _block(batch, fits.centre)
            p = _sigmoid(z[:, 1:] @ fits.weights + fits.intercepts)
            mine = np.arange(fits.repeats) * fits.folds + fold
            mean = np.take_along_axis(p, mine, axis=1).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(mean)], [*batch.schema.names[4:], "probability"])

    arrays = _arrays(encoded, label, fits.repeats, *keep)
    kinds = ", ".join(f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in keep)
    return arrays.mapInArrow(run, f"{kinds}, probability double")


def training_balance(encoded: DataFrame, label: str, fits: FoldFits) -> DataFrame:
    """``repeat``, ``fold``, ``rows``, ``positives``, ``balance`` of every fit. The intercept is not penalised, so over the
    rows a fit trains on the weighted scores sum to half the rows: the balance is 1."""
    shared = encoded.sparkSession.sparkContext.broadcast(fits)
    count = fits.folds * fits.repeats

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        fits = shared.value
        z, y, fold = _block(batch, fits.centre)
        for i in range(count):
            mine, n, yes = fold[:, i // fits.folds] != i % fits.folds, fits.rows[i], fits.positives[i]
            p = _sigmoid(z[mine, 1:] @ fits.weights[:, i] + fits.intercepts[i])
            total[i] += len(p), y[mine].sum(), (np.where(y[mine] == 1, n / (2 * yes), n / (2 * (n - yes))) * p).sum()

    sums = _sums(_arrays(encoded, label, fits.repeats), count, 3, add)
    rows = [(r, k, int(n), int(yes), float(s / (n / 2))) for (r, k), (n, yes, s) in zip(fits.names(), sums)]
    return encoded.sparkSession.createDataFrame(rows, "repeat int, fold int, rows long, positives long, balance double")
