"""Train every candidate, keep the best, describe it."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylight.operators import curves as C
from staylight.operators import newton, trees
from staylight.operators.clean import with_target
from staylight.operators.features import model_frame
from staylight.operators.importance import REPEATS, feature_importance, top_features
from staylight.operators.models import (
    CATEGORIES,
    NUMBERS,
    Candidate,
    as_pipeline,
    candidates,
    fit_encoder,
    fit_stages,
)
from staylight.operators.ordering import stratified_folds
from staylight.operators.scoring import FittedScorer
from staylight.operators.typical import typical_entity
from staylight.spec import PanelSpec
from staylight.workspace import Journal, new_path, written

LABEL = "label"


@dataclass(frozen=True)
class TrainSettings:
    """Fixed values by default: folds, repeats, seed and model sizes of a full run."""

    folds: int = 5
    repeats: int = 10
    seed: int = 42
    trees: int = 300
    boosting_rounds: int = 120
    importance_repeats: int = REPEATS
    #: Model fits submitted at the same time; each one is itself a distributed job, of Spark ML. Without a number
    #: trees are grown together where they can be, and :func:`fits_at_once` decides for the other fits.
    parallel_fits: int | None = None
    #: ``in_sample`` measures importance on the training rows, ``held_out`` on one fold
    #: that a separate fit has not seen.
    importance_rows: str = "in_sample"


@dataclass
class Trained:
    """The outcome of :func:`train`: small tables, the fitted pipeline and its facts."""

    model: PipelineModel
    spec: PanelSpec
    threshold: float
    typical: dict[str, object]
    card: DataFrame
    leaderboard: DataFrame
    curve_points: DataFrame
    confusion: DataFrame
    importance: DataFrame
    out_of_fold: DataFrame
    label: str
    trained_at: str = ""
    columns: list[str] = field(default_factory=list)

    @property
    def scorer(self) -> FittedScorer:
        return FittedScorer(self.label, self.model)


#: Tells training rows apart, whatever their ids.
ROW = "_training_row"


def training_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """id, label and the model columns of a cleaned panel."""
    return model_frame(with_target(df, spec, LABEL), spec, spec.entity_id, LABEL)


def with_folds(frame: DataFrame, spec: PanelSpec, settings: TrainSettings) -> DataFrame:
    """Add ``fold_0 .. fold_{repeats-1}``, so each fit only filters one stored table.

    ``frame`` has :data:`ROW`, which tells rows with equal or missing ids apart."""
    placed = stratified_folds(
        frame, spec.entity_id, LABEL, settings.folds, settings.repeats, settings.seed, ROW
    )
    wide = placed.groupBy(ROW).agg(
        *(
            F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"fold_{r}")
            for r in range(settings.repeats)
        )
    )
    return frame.join(wide, ROW)


def numbered(frame: DataFrame) -> DataFrame:
    """``frame`` with :data:`ROW`. A stage: a running id is only lasting once it is written."""
    return written(frame.withColumn(ROW, F.monotonically_increasing_id()), "training-rows")


def _training_totals(encoded: DataFrame, settings: TrainSettings) -> dict[tuple[int, int], tuple[int, float]]:
    """Rows and positive rows that each (repeat, fold) trains on, from one aggregate: all rows
    less the fold's own. As many figures as folds reach the driver."""
    folds = F.array(*(F.col(f"fold_{r}") for r in range(settings.repeats)))
    held = encoded.select(LABEL, F.posexplode(folds).alias("repeat", "fold")).groupBy("repeat", "fold")
    found = {
        (r["repeat"], r["fold"]): (r["n"], r["yes"])
        for r in held.agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("double")).alias("yes")).collect()
    }
    rows = {r: [sum(v[k] for (a, _), v in found.items() if a == r) for k in (0, 1)] for r in range(settings.repeats)}
    return {(r, f): (rows[r][0] - n, rows[r][1] - yes) for (r, f), (n, yes) in found.items()}


#: Fits submitted together at least, and tasks offered to each core where a table has few partitions.
FEWEST_FITS, TASKS_PER_CORE = 4, 2


def fits_at_once(encoded: DataFrame, settings: TrainSettings) -> int:
    """How many fits are submitted together. A fit is a long row of jobs with a task per partition of ``encoded``: on a
    small table its jobs leave most cores idle, so more fits run side by side; on a large one they fill the cluster."""
    if settings.parallel_fits is not None:
        return settings.parallel_fits
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    return max(FEWEST_FITS, TASKS_PER_CORE * cores // max(1, encoded.rdd.getNumPartitions()))


def out_of_fold(
    encoded: DataFrame, spec: PanelSpec, competitors: list[Candidate], settings: TrainSettings,
    journal: Journal | None = None,
) -> dict[str, DataFrame]:
    """Per candidate ``id, label, probability``: the mean held-out score of every row over the repeats.

    Fits of a candidate that allows it are solved together (:mod:`staylight.operators.newton`,
    :mod:`staylight.operators.trees`), unless there are too many features for that. The others share one pool, so slow ones
    overlap with quick ones. The held-out scores of each fit, of a repeat's forests, and some rounds of all boosted
    models are steps of the journal, so a lost executor, a repeated task or a run that starts again never refits them.
    """
    spark = encoded.sparkSession
    journal = journal or Journal(spark, new_path(spark, "training"), settings)
    fits_in = _width(encoded) <= newton.WIDEST
    solved = [c for c in competitors if c.shared_scans and fits_in]
    sketch = {c.key: c.estimator(1, settings.seed) for c in competitors}
    together = fits_in and settings.parallel_fits is None
    grown = [c for c in competitors if c not in solved and together and trees.can_grow(sketch[c.key], c.balanced)]
    alone = [c for c in competitors if c not in solved and c not in grown]
    folds = [(r, k) for r in range(settings.repeats) for k in range(settings.folds)]

    def shared() -> DataFrame:
        fits = newton.fit_folds(encoded, LABEL, settings.folds, settings.repeats)
        return newton.held_out_scores(encoded, LABEL, fits, spec.entity_id, LABEL)

    found = {c.key: journal.table(f"out-of-fold/{c.key}", shared) for c in solved}
    step = lambda c, r, k: f"fits/{c.key}/repeat={r}/fold={k}"
    # The slowest kinds of fit first.
    jobs = [(c, r, k) for c in reversed(alone) for r, k in folds if not journal.done(step(c, r, k))]
    totals = _training_totals(encoded, settings) if jobs or grown else {}

    def one(job: tuple[Candidate, int, int]) -> None:
        candidate, repeat, fold = job
        mine = F.col(f"fold_{repeat}")

        def scores() -> DataFrame:
            fitted = fit_stages(
                encoded.filter(mine != fold), spec, LABEL, candidate, settings.seed + repeat,
                totals.get((repeat, fold)),
            )
            # Only the pipeline stages are needed here; the rows are already encoded.
            held = FittedScorer(candidate.label, fitted).score(encoded.filter(mine == fold))
            return held.select(ROW, spec.entity_id, LABEL, "probability")

        journal.table(step(*job), scores)

    with ThreadPoolExecutor(fits_at_once(encoded, settings)) as pool:
        list(pool.map(one, jobs))

    def means(candidate: Candidate, steps: list[str]) -> DataFrame:
        every = spark.read.option("basePath", journal.path(f"fits/{candidate.key}"))
        grouped = every.parquet(*(journal.path(s) for s in steps)).groupBy(ROW).agg(
            F.max(spec.entity_id).alias(spec.entity_id), F.max(LABEL).alias(LABEL),
            F.avg("probability").alias("probability"),
        )
        return grouped.drop(ROW)

    def forests(candidate: Candidate) -> DataFrame:
        estimator, steps = sketch[candidate.key], [f"fits/{candidate.key}/repeat={r}" for r in range(settings.repeats)]
        rows = _binned(encoded, spec, settings, estimator.getMaxBins(), journal)
        for r, name in enumerate(steps):

            def votes(r: int = r) -> DataFrame:
                # Of no and of yes, as in :func:`fit_stages`.
                n, yes = np.array([totals[r, k] for k in range(settings.folds)], float).T
                weight = np.stack([n / (2 * (n - yes)), n / (2 * yes)], axis=1) if candidate.balanced else np.ones((len(n), 2))
                forests = trees.grow_forests(rows, estimator, r, weight, settings.seed)
                return trees.forest_scores(rows, forests, r, ROW, spec.entity_id, LABEL)

            journal.table(name, votes)
        return means(candidate, steps)

    def boosted(candidate: Candidate) -> DataFrame:
        estimator = sketch[candidate.key]
        rows = _binned(encoded, spec, settings, estimator.getMaxBins(), journal)
        models = trees.grow_boosted(rows, estimator, settings.seed, journal, f"fits/{candidate.key}")
        return trees.boosted_scores(rows, models, ROW, spec.entity_id, LABEL)

    if grown and not all(0 < yes < n for n, yes in totals.values()):
        raise ValueError("training rows need both outcomes")
    for c in grown:
        kind = forests if isinstance(sketch[c.key], RandomForestClassifier) else boosted
        found[c.key] = journal.table(f"out-of-fold/{c.key}", lambda c=c, kind=kind: kind(c))
    for c in alone:
        found[c.key] = journal.table(f"out-of-fold/{c.key}", lambda c=c: means(c, [step(c, r, k) for r, k in folds]))
    return {c.key: found[c.key] for c in competitors}


def _binned(encoded: DataFrame, spec: PanelSpec, settings: TrainSettings, bins: int, journal: Journal) -> trees.Binned:
    return trees.binned(encoded, LABEL, ROW, settings.folds, settings.repeats, bins, journal, spec.entity_id, LABEL)


def _width(encoded: DataFrame) -> int:
    sizes = (F.max(F.size(vector_to_array(c))) for c in (CATEGORIES, NUMBERS))
    return 1 + sum(n or 0 for n in encoded.agg(*sizes).first())


def evaluate(scores: DataFrame, candidate: Candidate) -> dict:
    """The leaderboard row of one candidate."""
    curve = C.cumulative_counts(scores, LABEL, "probability")
    tuned = C.best_threshold(curve).first()
    block = C.score_block(scores, LABEL, "probability", tuned["threshold"], curve).first()
    return {
        "key": candidate.key,
        "label": candidate.label,
        "rationale": candidate.rationale,
        "threshold": tuned["threshold"],
        "raw_threshold": tuned["raw_threshold"],
        **block.asDict(),
    }


LEADERBOARD_TYPE = (
    "position int, key string, label string, rationale string, threshold double, "
    "raw_threshold double, accuracy double, precision double, recall double, f1 double, "
    "roc_auc double, pr_auc double, brier double"
)


def leaderboard_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Best ROC-AUC first; candidate order decides ties. One row per candidate."""
    ranked = sorted(rows, key=lambda r: -(r["roc_auc"] or 0.0))
    names = [part.split()[0] for part in LEADERBOARD_TYPE.split(", ")][1:]
    data = [(i + 1, *(row[n] for n in names)) for i, row in enumerate(ranked)]
    return spark.createDataFrame(data, LEADERBOARD_TYPE)


def curve_table(scores: DataFrame, probability: str = "probability") -> DataFrame:
    """``curve, point, x, y`` of the thinned ROC and precision-recall curves."""
    curve = C.cumulative_counts(scores, LABEL, probability)
    roc = C.thinned(C.roc_points(curve)).select(F.lit("roc").alias("curve"), "*")
    pr = C.thinned(C.pr_points(curve)).select(F.lit("pr").alias("curve"), "*")
    return roc.unionByName(pr)


def _importance_model(encoded, encoder, spec, winner, settings, final):
    if settings.importance_rows == "in_sample":
        return encoded, final
    if settings.importance_rows != "held_out":
        raise ValueError("importance_rows must be in_sample or held_out")
    fitted = fit_stages(encoded.filter("fold_0 != 0"), spec, LABEL, winner, settings.seed)
    return encoded.filter("fold_0 = 0"), as_pipeline(encoder, fitted)


def train(
    df: DataFrame, spec: PanelSpec, settings: TrainSettings = TrainSettings(),
    competitors: list[Candidate] | None = None, folder: str | None = None,
) -> Trained:
    """Compare the candidates on out-of-fold scores, refit the winner on every row.

    ``folder``: where the steps of the run are kept. A run that starts again with the same folder, settings, candidates
    and model columns takes finished steps from there, the training rows included; so each input
    needs a folder of its own. Without one the steps go to a fresh folder.
    """
    started = time.perf_counter()
    spark = df.sparkSession
    competitors = competitors or candidates(settings.trees, settings.boosting_rounds)
    work = folder or new_path(spark, "training")
    journal = Journal(spark, work, (settings, [c.key for c in competitors], spec.entity_id, spec.target, spec.model_columns))

    frame = journal.table("rows", lambda: training_rows(df, spec).withColumn(ROW, F.monotonically_increasing_id()))
    encoder = fit_encoder(frame, spec)
    # Read by every fit, so written once: the fits' many small jobs then carry a plan that
    # only reads a table, and a lost executor costs no more than reading it again.
    encoded = journal.table("encoded", lambda: with_folds(encoder.transform(frame), spec, settings))

    scores = out_of_fold(encoded, spec, competitors, settings, journal)
    board = [evaluate(scores[c.key], c) for c in competitors]
    best = max(board, key=lambda row: row["roc_auc"] or 0.0)  # the first one on ties
    winner = next(c for c in competitors if c.key == best["key"])
    oof, threshold = scores[winner.key], best["threshold"]

    final = as_pipeline(encoder, fit_stages(encoded, spec, LABEL, winner, settings.seed))
    totals = encoded.agg(F.count("*").alias("rows"), F.avg(LABEL).alias("rate")).first()
    seconds = round(time.perf_counter() - started, 1)
    rows, model = _importance_model(encoded, encoder, spec, winner, settings, final)
    measured = feature_importance(
        rows.select(spec.entity_id, LABEL, *spec.model_columns), spec, LABEL,
        FittedScorer(winner.label, model), settings.importance_repeats, settings.seed,
    )
    importance = spark.createDataFrame(
        top_features(measured).collect(), "feature string, importance double, std double"
    ).withColumn("rows", F.lit(settings.importance_rows))
    typical = typical_entity(encoded, spec)

    trained_at = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    fits = len(competitors) * settings.folds * settings.repeats
    card = spark.createDataFrame(
        [
            {
                "generated_at": trained_at,
                "training_seconds": seconds,
                "rows_total": totals["rows"],
                "attrition_rate": round(totals["rate"], 4),
                # The wording of the strategy and of the reason below.
                "strategy": f"{settings.repeats}x repeated {settings.folds}-fold "
                "stratified cross-validation",
                "models_fitted": fits + 1 + (settings.importance_rows == "held_out"),
                "employees_scored": totals["rows"],
                "selected_key": best["key"],
                "selected_model": best["label"],
                "selection_reason": f"Best cross-validated ROC-AUC ({best['roc_auc']:.4f}) of "
                f"{len(board)} candidates.",
                "decision_threshold": threshold,
                "raw_threshold": best["raw_threshold"],
                **{
                    k: best[k]
                    for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")
                },
            }
        ],
        "generated_at string, training_seconds double, rows_total long, attrition_rate double, "
        "strategy string, models_fitted int, employees_scored long, selected_key string, "
        "selected_model string, selection_reason string, decision_threshold double, "
        "raw_threshold double, accuracy double, precision double, recall double, f1 double, "
        "roc_auc double, pr_auc double, brier double",
    )
    return Trained(
        model=final,
        spec=spec,
        threshold=threshold,
        typical=typical,
        card=card,
        leaderboard=leaderboard_table(spark, board),
        curve_points=curve_table(oof),
        confusion=C.confusion(oof, LABEL, "probability", threshold),
        importance=importance,
        out_of_fold=oof,
        label=winner.label,
        trained_at=trained_at,
        columns=list(spec.model_columns),
    )
