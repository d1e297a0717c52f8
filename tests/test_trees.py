from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.operators import models as M
from staylight.operators import trees as T
from staylight.operators.clean import clean
from staylight.plans.training import LABEL, ROW, TrainSettings, numbered, out_of_fold, training_rows, with_folds
from staylight.workspace import Journal, new_path, written
from tests.conftest import people

SETTINGS = TrainSettings(folds=3, repeats=2, trees=6, boosting_rounds=4)
#: A number of fits at once: each is Spark ML's own.
SEPARATE = replace(SETTINGS, parallel_fits=4)


@pytest.fixture(scope="module")
def encoded(spark):
    """Few distinct numbers, so that every value lies between two cuts, in Spark ML's models as well."""
    rows = training_rows(clean(spark.createDataFrame(people(240)), HR), HR)
    rows = rows.withColumns({c: F.pmod(F.floor(F.col(c) * 7), F.lit(12)).cast("double") for c in HR.model_numerics})
    frame = numbered(rows)
    return written(with_folds(M.fit_encoder(frame, HR).transform(frame), HR, SETTINGS), "encoded")


def scores(encoded, estimator, balanced, settings=SETTINGS, journal=None):
    candidate = M.Candidate("tried", "Tried", "", estimator, balanced)
    found = out_of_fold(encoded, HR, [candidate], settings, journal)["tried"]
    return {r.EmployeeID: r.probability for r in found.collect()}


def boosting(share=1.0):
    return lambda rows, seed: GBTClassifier(
        maxIter=4, stepSize=0.3, maxDepth=2, minInstancesPerNode=4, subsamplingRate=share, seed=seed
    )


def forest(trees=1, bootstrap=False, features="all"):
    return lambda rows, seed: RandomForestClassifier(
        numTrees=trees, maxDepth=4, minInstancesPerNode=3, featureSubsetStrategy=features, bootstrap=bootstrap,
        weightCol=M.WEIGHT, seed=seed,
    )


@pytest.mark.parametrize("estimator, balanced", [(boosting(), False), (forest(), True)])
def test_without_draws_the_trees_are_those_of_spark_ml(encoded, estimator, balanced):
    here, there = (scores(encoded, estimator, balanced, s) for s in (SETTINGS, SEPARATE))
    assert len(here) == 240 and set(here) == set(there)
    # In a forest's deep nodes two features may gain the same but for the last digit, and either may be taken.
    assert sum(abs(here[k] - there[k]) < 1e-9 for k in here) >= (220 if balanced else 240)


def test_a_forest_with_draws_scores_as_spark_ml_does(encoded):
    estimator = forest(60, True, "sqrt")
    here, there = (scores(encoded, estimator, True, s) for s in (SETTINGS, SEPARATE))
    a, b = (np.array([x[k] for k in sorted(here)]) for x in (here, there))
    assert np.corrcoef(a, b)[0, 1] > 0.9 and abs(a.mean() - b.mean()) < 0.02 and abs(a.std() / b.std() - 1) < 0.2


def test_the_layout_of_the_rows_changes_no_tree(encoded):
    for estimator, balanced in ((boosting(0.9), False), (forest(6, True, "sqrt"), True)):
        here, there = scores(encoded, estimator, balanced), scores(encoded.repartition(5), estimator, balanced)
        assert max(abs(here[k] - there[k]) for k in here) < 1e-9


def test_trees_take_few_jobs(spark, encoded):
    """A level of all fits takes one scan, not a row of jobs for each fit."""
    for c in M.candidates(SETTINGS.trees, SETTINGS.boosting_rounds)[1:]:
        spark.sparkContext.setJobGroup(f"few-{c.key}", c.key)
        out_of_fold(encoded, HR, [c], SETTINGS)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{c.key}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) < 60, (c.key, len(jobs))


def test_finished_rounds_are_taken_from_the_journal(spark, encoded, monkeypatch):
    journal = Journal(spark, new_path(spark, "trees"), "one run")
    first = scores(encoded, boosting(0.9), False, journal=journal)
    monkeypatch.setattr(T, "_grow_round", None)
    monkeypatch.setattr(Journal, "done", lambda self, name, done=Journal.done: "out-of-fold" not in name and done(self, name))
    assert scores(encoded, boosting(0.9), False, journal=journal) == first


def test_one_outcome_is_refused(encoded):
    only = encoded.withColumn(LABEL, F.lit(1))
    for estimator, balanced in ((boosting(), False), (forest(), True)):
        with pytest.raises(ValueError, match="both outcomes"):
            scores(only, estimator, balanced)


def test_cut_points():
    assert T.cut_points(np.array([1.0, 1.0, 2.0, 4.0]), 32).tolist() == [1.5, 3.0]
    assert T.cut_points(np.array([5.0, 5.0]), 32).tolist() == []
    values = np.random.default_rng(3).normal(size=10_000)
    cuts = T.cut_points(values, 32)
    shares = np.bincount(np.searchsorted(cuts, values), minlength=32) / len(values)
    assert len(cuts) == 31 and abs(shares - 1 / 32).max() < 1e-3
    heavy = T.cut_points(np.concatenate([np.zeros(9_000), np.arange(1, 1_001)]), 32)
    assert heavy[0] == 0.5 and len(heavy) <= 31


def test_rows_travel_as_bytes():
    x = np.arange(24, dtype=np.float64).reshape(6, 4)
    column = pa.chunked_array([T._bytes(x)]).chunk(0).slice(2, 3)
    assert (T._rows_of(column, np.float64) == x[2:5]).all()


def test_a_bag_draws_as_a_poisson_distribution_does():
    mixed = T._mixed(np.arange(200_000, dtype=np.uint64))
    at, times = T._bag(mixed, T._key("bag"), 1.0, True)
    assert abs(times.sum() / 200_000 - 1) < 0.01 and abs(len(at) / 200_000 - (1 - np.exp(-1))) < 0.005
    at, times = T._bag(mixed, T._key("part"), 0.9, False)
    assert abs(len(at) / 200_000 - 0.9) < 0.005 and set(times) == {1}
    assert len(T._bag(mixed, T._key("all"), 1.0, False)[0]) == 200_000


def test_every_row_is_scored_by_trees_that_have_not_seen_it(encoded):
    """Labels of held-out rows do not change their own scores."""
    def turned(k):
        return encoded.withColumn(LABEL, F.when(F.col(ROW) == F.lit(k), 1 - F.col(LABEL)).otherwise(F.col(LABEL)))

    row = encoded.orderBy("EmployeeID").first()
    for estimator in (boosting(0.9), forest(6, True, "sqrt")):
        a, b = scores(encoded, estimator, False), scores(turned(row[ROW]), estimator, False)
        assert a[row.EmployeeID] == pytest.approx(b[row.EmployeeID], abs=1e-12) and a != b
