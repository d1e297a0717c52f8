import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.operators import explain as E
from staylight.operators import models as M
from staylight.operators import scoring as S
from staylight.operators.importance import feature_importance, shuffled_auc, top_features
from staylight.plans.training import LABEL, TrainSettings, fits_at_once, numbered, train, training_rows, with_folds
from staylight.scorecards import HR_SCORECARD
from staylight.sources.store import load_model, metric_tables, read_tables, save_model, write_tables
from tests.conftest import AT_RISK, person

SMALL = TrainSettings(folds=2, repeats=1, trees=5, boosting_rounds=3, importance_repeats=2)


@pytest.fixture(scope="module")
def trained(hr):
    return train(hr, HR, SMALL)


@pytest.fixture(scope="module")
def rows(hr):
    return training_rows(hr, HR).persist()


def test_one_hot_leaves_unseen_values_empty(spark, rows):
    encoder = M.fit_encoder(rows.filter("JobLevel <> 'Mid'"), HR)
    hot = encoder.transform(rows).select("JobLevel", vector_to_array("JobLevel__hot").alias("v")).distinct()
    found = {r.JobLevel: r.v for r in hot.collect()}
    assert found.pop("Mid") == [0.0] * 4
    assert sorted(found.values()) == sorted(np.eye(4).tolist())


def test_scaling_uses_the_population_deviation(rows):
    constant = rows.withColumn("DistanceFromHome", F.lit(3.0))
    encoded = M.fit_encoder(constant, HR).transform(constant)
    scaler, correction = M.fit_scaler(encoded, 80)
    scaled = correction.transform(scaler.transform(encoded)).select(vector_to_array("scaled").alias("x"))
    x = np.array([r.x for r in scaled.collect()])
    raw = np.array([[float(r[c]) for c in HR.model_numerics] for r in constant.collect()])
    sd = raw.std(axis=0)
    want = (raw - raw.mean(axis=0)) / np.where(sd < 1e-9, 1, sd)
    assert np.allclose(np.sort(x, axis=0), np.sort(want, axis=0), atol=1e-9)
    figures = {c: (m, d) for c, m, d in M.scaling_figures(scaler, correction, HR)}
    assert figures["Age"] == pytest.approx((raw[:, 0].mean(), sd[0]))


def test_logistic_solves_the_penalised_weighted_problem(rows):
    encoder = M.fit_encoder(rows, HR)
    encoded = encoder.transform(rows)
    fitted = M.fit_stages(encoded, HR, LABEL, M.candidates()[0])
    *prepare, model = fitted.stages
    ready = M.FittedStages(tuple(prepare)).transform(encoded)
    data = ready.select(vector_to_array("features").alias("x"), LABEL).collect()
    x, y = np.array([r.x for r in data]), np.array([r[LABEL] for r in data], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = model.coefficients.toArray(), model.intercept
    miss = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    # Gradient of 0.5 * sum(weight * loss) + 0.5 * |w|^2 at the solution.
    assert np.abs(0.5 * x.T @ miss + w).max() < 2e-3
    assert abs(miss.sum()) < 2e-3


def test_one_outcome_cannot_be_trained(rows):
    only = M.fit_encoder(rows, HR).transform(rows.filter("label = 1"))
    with pytest.raises(ValueError, match="both outcomes"):
        M.fit_stages(only, HR, LABEL, M.candidates()[0])


def test_models_score_after_something_was_observed(spark, rows):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    encoded = M.fit_encoder(rows, HR).transform(rows)
    for candidate in M.candidates(trees=3, boosting_rounds=2):
        fitted = M.fit_stages(encoded, HR, LABEL, candidate)
        assert S.FittedScorer(candidate.label, fitted).score(encoded).filter("probability between 0 and 1").count() == 80


def test_every_row_is_held_out_once_per_repeat(rows):
    settings = TrainSettings(folds=4, repeats=2)
    folds = with_folds(numbered(rows), HR, settings)
    assert folds.count() == 80
    # Equal and missing ids: every row still has a fold of its own.
    shared = rows.withColumn("EmployeeID", F.when(F.col("EmployeeID") < "EMP-0040", "EMP-1").when(F.col("EmployeeID") < "EMP-0075", F.col("EmployeeID")))
    assert with_folds(numbered(shared), HR, settings).filter("fold_0 is not null and fold_1 is not null").count() == 80
    assert {r.fold_0 for r in folds.select("fold_0").collect()} == {0, 1, 2, 3}


def test_small_tables_are_fitted_side_by_side(rows):
    one, many = rows.coalesce(1), rows.repartition(64)
    assert fits_at_once(one, TrainSettings()) == 8  # local[4]
    assert fits_at_once(many, TrainSettings()) == 4
    assert fits_at_once(one, TrainSettings(parallel_fits=1)) == 1


def test_training_result(trained):
    card = trained.card.first()
    board = trained.leaderboard.orderBy("position").collect()
    assert len(board) == 3 and card.models_fitted == 3 * 2 + 1
    assert board[0].key == card.selected_key
    assert board[0].roc_auc == max(r.roc_auc for r in board) == card.roc_auc
    assert sum(trained.confusion.first()) == card.rows_total == 80
    assert 0.15 <= trained.threshold <= 0.85
    for r in board:
        for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier"):
            assert 0 <= r[k] <= 1
    curves = trained.curve_points.groupBy("curve").count().collect()
    assert {r.curve for r in curves} == {"roc", "pr"} and all(r["count"] <= 60 for r in curves)
    important = {r.feature for r in trained.importance.collect()}
    assert important <= set(HR.model_columns) and len(important) <= 12
    oof = trained.out_of_fold
    assert oof.count() == oof.select("EmployeeID").distinct().count() == 80


def test_model_survives_saving(spark, trained, hr, tmp_path):
    save_model(trained, str(tmp_path / "m"))
    kept = load_model(spark, str(tmp_path / "m"), HR)
    assert kept.threshold == trained.threshold and kept.typical == trained.typical
    a = sorted((r.EmployeeID, r.probability) for r in S.score(hr, HR, trained.scorer).collect())
    b = sorted((r.EmployeeID, r.probability) for r in S.score(hr, HR, kept.scorer).collect())
    assert a == b
    write_tables(metric_tables(trained), str(tmp_path / "t"))
    assert read_tables(spark, str(tmp_path / "t"), "leaderboard")["leaderboard"].count() == 3


def test_a_fitted_model_explains_too(spark, trained):
    df = spark.createDataFrame([person(1, **AT_RISK), person(2, JobRole="Astronaut")])
    rows = {r.EmployeeID: r for r in E.explained(df, HR, trained.scorer, trained.typical, trained.threshold).collect()}
    assert len(rows) == 2 and 0 <= rows["EMP-0002"].probability <= 1
    row = rows["EMP-0001"]
    alone = S.score(df, HR, trained.scorer).filter("EmployeeID = 'EMP-0001'").first().probability
    assert row.probability == pytest.approx(alone, abs=5.1e-5)
    for a in row.actions:
        value = float(a.to) if a.kind == "pay" else a.to
        changed = spark.createDataFrame([person(1, **{**AT_RISK, a.field: value})])
        assert S.score(changed, HR, trained.scorer).first().probability == pytest.approx(a.new_probability, abs=5.1e-5)


def test_importance_finds_what_the_score_uses(rows):
    card = S.Scorecard("one", 0.0, {"OverTime": {"Yes": 3.0, "No": -3.0}})
    target = rows.withColumn(LABEL, (F.col("OverTime") == "Yes").cast("int"))
    found = feature_importance(target, HR, LABEL, card, repeats=5)
    best = top_features(found).collect()
    assert [r.feature for r in best] == ["OverTime"] and best[0].importance > 0.3
    assert found.count() == len(HR.model_columns)


def test_importance_passes_no_table_through_the_driver(rows):
    class Seen:
        label = "seen"

        def score(self, frame):
            frame.collect()  # the plan is final once it has run
            self.plan = frame._jdf.queryExecution().executedPlan().toString()
            return HR_SCORECARD.score(frame)

    scorer = Seen()
    shuffled_auc(rows, HR, LABEL, scorer, repeats=3)
    assert "SortMergeJoin" in scorer.plan and "Broadcast" not in scorer.plan


def test_importance_against_brute_force(rows):
    """The same permutation, applied by hand to one column."""
    from hashlib import md5

    scored = feature_importance(rows, HR, LABEL, HR_SCORECARD, repeats=1, seed=5)
    got = {r.feature: r.importance for r in scored.collect()}
    data = [r.asDict() for r in rows.collect()]

    def order(*salts):
        return sorted(data, key=lambda r: md5(":".join([r["EmployeeID"], *salts]).encode()).hexdigest())

    def auc(p, y):
        pos, neg = p[y == 1], p[y == 0]
        return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))

    def scores(table):
        z = np.full(len(table), HR_SCORECARD.intercept)
        for c, points in HR_SCORECARD.points.items():
            z += [points.get(r[c], 0.0) for r in table]
        for c, (m, s, w) in HR_SCORECARD.slopes.items():
            z += [(r[c] - m) / s * w for r in table]
        return np.round(1 / (1 + np.exp(-z)), 6)

    y = np.array([r[LABEL] for r in order("5")])
    base = auc(scores(order("5")), y)
    for c in ("OverTime", "Age", "PromotionGap", "Department"):
        mixed = [{**r, c: d[c]} for r, d in zip(order("5"), order("5", "swap", "0"))]
        assert got[c] == pytest.approx(base - auc(scores(mixed), y), abs=1.1e-5)
