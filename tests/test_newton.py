import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.operators import models as M
from staylight.operators import newton
from staylight.operators.scoring import FittedScorer
from staylight.plans import training as TR
from staylight.plans.training import LABEL, TrainSettings, numbered, out_of_fold, train, training_rows, with_folds
from staylight.workspace import Journal, new_path, written

SETTINGS = TrainSettings(folds=3, repeats=2, trees=3, boosting_rounds=2, importance_repeats=1)


@pytest.fixture(scope="module")
def encoded(hr):
    frame = numbered(training_rows(hr, HR).withColumn("DistanceFromHome", F.lit(3.0)))
    return written(with_folds(M.fit_encoder(frame, HR).transform(frame), HR, SETTINGS), "encoded")


@pytest.fixture(scope="module")
def fits(encoded):
    return newton.fit_folds(encoded, LABEL, 3, 2)


def test_every_fit_is_at_the_optimum_of_its_own_rows(encoded, fits):
    rows = encoded.select(
        vector_to_array(M.CATEGORIES).alias("c"), vector_to_array(M.NUMBERS).alias("x"), LABEL, "fold_0", "fold_1"
    ).collect()
    c, x = np.array([r.c for r in rows]), np.array([r.x for r in rows])
    y, fold = np.array([r[LABEL] for r in rows], float), np.array([[r.fold_0, r.fold_1] for r in rows])
    for i, (repeat, k) in enumerate(fits.names()):
        mine = fold[:, repeat] != k
        sd = x[mine].std(axis=0)
        scaled = np.where(sd > 0, (x - x[mine].mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
        n, yes = mine.sum(), y[mine].sum()
        assert (fits.rows[i], fits.positives[i]) == (n, yes)
        weight = np.where(y == 1, n / (2 * yes), n / (2 * (n - yes)))
        raw, wide = fits.weights[:, i], c.shape[1]
        margin = c @ raw[:wide] + (x - fits.centre) @ raw[wide:] + fits.intercepts[i]
        miss = (weight * (1 / (1 + np.exp(-margin)) - y))[mine]
        own = np.concatenate([raw[:wide], raw[wide:] * sd])
        gradient = 0.5 * np.hstack([c, scaled])[mine].T @ miss + own
        assert np.abs(gradient).max() < 1e-7 and abs(miss.sum()) < 1e-7


def test_scores_equal_those_of_single_fits(encoded, fits):
    logistic = M.candidates()[0]
    found = {}
    for repeat, k in fits.names():
        fold = F.col(f"fold_{repeat}")
        fitted = M.fit_stages(encoded.filter(fold != k), HR, LABEL, logistic)
        for r in FittedScorer("x", fitted).score(encoded.filter(fold == k)).select(TR.ROW, "probability").collect():
            found.setdefault(r[0], []).append(r[1])
    shared = newton.held_out_scores(encoded, LABEL, fits, TR.ROW).collect()
    assert len(shared) == 80
    for r in shared:
        assert r["probability"] == pytest.approx(np.mean(found[r[TR.ROW]]), abs=1e-3)


def test_balance_of_all_fits(encoded, fits):
    rows = newton.training_balance(encoded, LABEL, fits).collect()
    assert len(rows) == 6 and all(abs(r.balance - 1) < 1e-9 for r in rows)


def test_one_outcome_or_no_rows_cannot_be_solved(encoded):
    with pytest.raises(ValueError, match="both outcomes"):
        newton.fit_folds(encoded.filter("label = 1"), LABEL, 3, 2)
    with pytest.raises(ValueError, match="no training rows"):
        newton.fit_folds(encoded.limit(0), LABEL, 3, 2)


def test_too_many_features_go_to_single_fits(encoded, monkeypatch):
    monkeypatch.setattr(newton, "WIDEST", 5)
    with pytest.raises(ValueError, match="too many"):
        newton.fit_folds(encoded, LABEL, 3, 2)
    small = TrainSettings(folds=2, repeats=1)
    frame = encoded.drop("fold_0", "fold_1")
    two = written(with_folds(frame, HR, small), "two-folds")
    assert out_of_fold(two, HR, M.candidates()[:1], small)["logistic_regression"].count() == 80


def test_a_broken_off_run_goes_on_where_it_stopped(spark, hr, monkeypatch):
    folder, fitted, real = new_path(spark, "journal"), [], TR.fit_stages

    def counted(*args, **kwargs):
        if stop and len(fitted) == 4:
            raise RuntimeError("lost")
        fitted.append(args[3].key)
        return real(*args, **kwargs)

    monkeypatch.setattr(TR, "fit_stages", counted)
    one_by_one = TrainSettings(folds=3, repeats=1, trees=3, boosting_rounds=2, importance_repeats=1, parallel_fits=1)
    stop = True
    with pytest.raises(RuntimeError, match="lost"):
        train(hr, HR, one_by_one, folder=folder)
    assert len(fitted) == 4
    stop = False
    first = train(hr, HR, one_by_one, folder=folder)
    assert len(fitted) == 7  # 2 x 3 folds of the trees, none twice, and the winner on all rows
    again = train(hr, HR, one_by_one, folder=folder)
    assert len(fitted) == 8
    key = lambda t: sorted(map(tuple, t.out_of_fold.collect()))
    assert key(first) == key(again)


def test_a_step_that_was_not_committed_is_written_anew(spark):
    folder = new_path(spark, "journal")
    journal = Journal(spark, folder, ("a", 1))
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(journal.path("step"))
    assert not journal.done("step")
    assert journal.table("step", lambda: spark.range(5)).count() == 5 and journal.done("step")
    assert journal.table("step", lambda: spark.range(9)).count() == 5
    assert not Journal(spark, folder, ("a", 2)).done("step")
