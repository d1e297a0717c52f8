"""A few registered queries beside their SQL; ``python -m checks.compare`` runs all."""

import os

import pytest

import __spark_entry__ as registered
from checks import oracles
from checks import queries as library
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_every_query_without_sql_is_a_fitted_model():
    without = set(library.queries()) - set(oracles.oracle_sql())
    assert without == {
        "m4a_logistic_scores", "m4b_forest_scores", "m4c_boosting_scores", "m5_out_of_fold",
        "m6_model_card", "t6_leaderboard", "m11_fitted_explained", "s6_metric_tables",
        "s7_reloaded_model",
    }
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize(
    "name", ["account_panel", "a3_breakdowns", "a3_document_breakdowns", "f12_headlines",
             "p6_violations", "w4_thinned_roc", "m10_actions"]
)
def test_query_equals_sql(spark, name):
    result = compare(spark, FOLDER, registered.queries()[name], registered.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_one_scan_serves_all_breakdowns(spark):
    plan = registered.queries()["a3_breakdowns"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1 and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_cut_queries_are_registered_with_full_sizes_too(spark, monkeypatch):
    found = registered.queries()
    cut = {
        "m4b_forest_scores", "m4c_boosting_scores", "m5_out_of_fold", "m5_held_out_rows", "m6_model_card", "t6_leaderboard",
        "s6_metric_tables", "s6_metric_card", "s7_reloaded_model", "s7_same_scores", "m11_fitted_explained",
        "m11_fitted_invariants", "m7_permutation_importance", "t7_top_features", "w6_stratified_folds",
    }
    assert {f"{name}_full" for name in cut} <= set(found)
    folds = found["w6_stratified_folds_full"](spark, FOLDER)
    assert folds.count() == 10 * library.panel(spark, FOLDER).count()

    class Stop(Exception):
        pass

    def taken(*args, **_):
        raise Stop(args[-1])

    monkeypatch.setattr(library.TR, "train", taken)
    monkeypatch.setattr(library, "feature_importance", lambda *args: taken(args[-2]))
    monkeypatch.setattr(library.M, "candidates", lambda *args: taken(args))
    sizes = {"m4b_forest_scores": (300, 120), "m4c_boosting_scores": (300, 120)}
    sizes |= dict.fromkeys(("m7_permutation_importance", "t7_top_features"), 30)
    for name in cut - {"w6_stratified_folds"}:
        with pytest.raises(Stop) as stopped:
            found[f"{name}_full"](spark, FOLDER)
        assert stopped.value.args[0] == sizes.get(name, library.TR.TrainSettings()), name
