import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.functions.derived import RISK_BANDS
from staylight.operators import explain as E
from staylight.operators import scoring as S
from staylight.operators import typical as T
from staylight.operators.features import engineer
from staylight.operators.typical import medians, modes, typical_entity, typical_table
from staylight.scorecards import HR_SCORECARD
from tests.conftest import AT_RISK, MIDWAY, SETTLED, person


def by_hand(record: dict) -> float:
    """The scorecard in plain Python."""
    row = dict(record)
    here, total = row["YearsAtCompany"], row["TotalWorkingYears"]
    row["PromotionGap"] = round(min(max(row["YearsSinceLastPromotion"] / here if here else row["YearsSinceLastPromotion"], 0), 5), 3)
    row["CareerShare"] = here / total if total else 1
    row["TenureBand"] = "Under 2 years" if here < 2 else "2-5 years" if here < 5 else "5-10 years" if here < 10 else "10+ years"
    z = HR_SCORECARD.intercept
    z += sum(table.get(row[c], 0.0) for c, table in HR_SCORECARD.points.items())
    z += sum((row[c] - m) / s * w for c, (m, s, w) in HR_SCORECARD.slopes.items())
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def typical(hr):
    return typical_entity(engineer(hr, HR), HR)


@pytest.fixture(scope="module")
def trio(spark):
    return spark.createDataFrame([person(1, **AT_RISK), person(2, **SETTLED), person(3, **MIDWAY)])


def test_scores(trio):
    got = {r.EmployeeID: r.probability for r in S.score(trio, HR, HR_SCORECARD).collect()}
    for i, record in enumerate((AT_RISK, SETTLED, MIDWAY)):
        assert got[f"EMP-{i + 1:04d}"] == pytest.approx(by_hand(record))
    assert got["EMP-0002"] < got["EMP-0001"]


def test_unknown_category_still_scores(spark):
    df = spark.createDataFrame([person(1, JobRole="Astronaut", JobLevel="Overlord")])
    assert 0 < S.score(df, HR, HR_SCORECARD).first().probability < 1


def test_protected_column_changes_nothing(spark):
    df = spark.createDataFrame([person(1, Gender="Female"), person(2, Gender="Male")])
    a, b = (r.probability for r in S.score(df, HR, HR_SCORECARD).collect())
    assert a == b


def test_drivers_against_brute_force(trio, typical):
    rows = E.drivers(trio, HR, HR_SCORECARD, typical).orderBy("EmployeeID", "position").collect()
    for i, record in enumerate((AT_RISK, SETTLED, MIDWAY)):
        base, want = by_hand(record), []
        for c in HR.contract:
            same = record[c] == typical[c]
            if not same:
                want.append((c, base - by_hand({**record, c: typical[c]})))
        want.sort(key=lambda d: (-abs(round(d[1], 4)), d[0]))
        got = [r for r in rows if r.EmployeeID == f"EMP-{i + 1:04d}"]
        assert [r.field for r in got] == [c for c, _ in want[:6]]
        assert np.allclose([r.impact for r in got], [d for _, d in want[:6]], atol=5.1e-5)
        assert [r.position for r in got] == [1, 2, 3, 4, 5, 6]
        assert all((r.direction == "increases") == (r.impact > 0) for r in got if r.impact)


def test_actions_against_brute_force(trio):
    rows = E.actions(trio, HR, HR_SCORECARD).orderBy("EmployeeID", "position").collect()
    for i, record in enumerate((AT_RISK, SETTLED, MIDWAY)):
        base, best = by_hand(record), {}
        tries = [
            (c, v) for c, ladder in HR.ladders.items() for v in ladder[ladder.index(record[c]) + 1:]
        ]
        tries += [("MonthlyIncome", round(record["MonthlyIncome"] * (1 + r), -2)) for r in (0.1, 0.2)]
        for c, v in tries:
            less = base - by_hand({**record, c: v})
            if less > 0.01 and (c not in best or less > best[c][0]):
                best[c] = (less, str(float(v)) if c == "MonthlyIncome" else v)
        want = sorted(best.items(), key=lambda kv: (-round(kv[1][0], 4), kv[0]))[:4]
        got = [r for r in rows if r.EmployeeID == f"EMP-{i + 1:04d}"]
        assert [(r.field, r.to) for r in got] == [(c, v) for c, (_, v) in want]
        assert np.allclose([r.reduction for r in got], [x for _, (x, _) in want], atol=5.1e-5)


def test_actions_only_ever_improve(hr):
    off_limits = {"Gender", "Age", "MaritalStatus", "Department", "JobRole", "PerformanceRating"}
    for r in E.actions(hr, HR, HR_SCORECARD).collect():
        assert r.field not in off_limits and r.recommendation
        if r.kind == "action":
            ladder = HR.ladders[r.field]
            assert ladder.index(r.to) > ladder.index(r["from"])
        else:
            assert float(r.to) > float(r["from"]) and r.display in r.recommendation
        assert r.reduction > 0


def test_equal_numbers_are_not_drivers(spark, typical):
    df = spark.createDataFrame([person(1, Age=int(typical["Age"]))])
    if typical["Age"] == int(typical["Age"]):
        rows = E.variants(df, HR, typical, ("driver",)).collect()
        assert "Age" not in {r.field for r in rows}


def test_number_of_what_ifs_is_bounded(hr, typical):
    most = E.variants(hr, HR, typical).groupBy("EmployeeID").count().agg(F.max("count")).first()[0]
    assert most <= 47


def test_explained(trio, typical):
    rows = {r.EmployeeID: r for r in E.explained(trio, HR, HR_SCORECARD, typical, 0.5).collect()}
    row = rows["EMP-0001"]
    p = by_hand(AT_RISK)
    assert row.probability == pytest.approx(p, abs=5.1e-5)
    assert row.percent == pytest.approx(100 * p, abs=0.051)
    assert row.will_leave == (p >= 0.5) and row.model == "HR scorecard"
    assert row.cost_at_risk == round(AT_RISK["MonthlyIncome"] * 6 * p)
    assert row.engineered.TenureBand == "Under 2 years"
    assert [d.position for d in row.drivers] == [1, 2, 3, 4, 5, 6]
    assert [a.position for a in row.actions] == [1, 2, 3]  # only three gain enough
    singles = [r.asDict() for r in E.drivers(trio, HR, HR_SCORECARD, typical).collect()]
    listed = [{"EmployeeID": k, **d.asDict()} for k, r in rows.items() for d in r.drivers]
    key = lambda d: (d["EmployeeID"], d["position"])
    assert sorted(singles, key=key) == sorted(listed, key=key)


def test_nobody_without_what_ifs_is_lost(spark):
    top = {c: ladder[-1] for c, ladder in HR.ladders.items()}
    df = spark.createDataFrame([person(1, **top, MonthlyIncome=0)])
    row = E.explained(df, HR, HR_SCORECARD, {}, 0.5).first()
    assert row.drivers == [] and row.actions == []


def test_band_table_equals_the_expression(spark, hr):
    bands = spark.createDataFrame(list(RISK_BANDS), "low double, high double, band string, advice string")
    scored = S.score(hr, HR, HR_SCORECARD)
    one = sorted((r.EmployeeID, r.risk_band) for r in S.with_decision(scored, HR, 0.5).collect())
    two = sorted((r.EmployeeID, r.risk_band) for r in S.banded(scored, bands).collect())
    assert one == two


def test_ranked_batch_and_summary(hr):
    scored = S.score(hr, HR, HR_SCORECARD)
    ranked = S.ranked_batch(scored, HR, 0.5, F.lit(1)).collect()
    values = [r.probability for r in ranked]
    assert values == sorted(values, reverse=True) and len(values) == 80
    assert ranked[0].asDict().keys() == {
        "row", "EmployeeID", "JobRole", "Department", "YearsAtCompany", "MonthlyIncome",
        "probability", "percent", "risk_band", "will_leave",
    }
    total = S.batch_summary(scored, HR, 0.5).first()
    assert total["count"] == 80 and total.flagged == S.flagged(scored, 0.5).count()
    exact = sum(r.MonthlyIncome * 6 * r.probability for r in scored.collect())
    assert total.cost_at_risk == pytest.approx(exact, abs=1)
    empty = S.batch_summary(scored.filter("false"), HR, 0.5).first()
    assert (empty["count"], empty.flagged, empty.flagged_share, empty.cost_at_risk) == (0, 0, 0.0, 0)


def test_medians_by_narrowing(spark):
    rng = np.random.default_rng(3)
    spread = np.concatenate([rng.lognormal(0, 3, 4000), [1e12], np.full(900, 2.5)])
    middle = np.concatenate([np.zeros(500), np.full(500, 1e9)])
    table = [(float(v), float(middle[i]) if i < 1000 else None, 4.0) for i, v in enumerate(spread)]
    df = spark.createDataFrame(table, "a double, b double, c double")
    want = {"a": float(np.median(spread)), "b": 5e8, "c": 4.0}
    assert medians(df, ["a", "b", "c"]) == pytest.approx(want)
    assert medians(df.filter("false"), ["a"]) == {"a": None}


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", "z"), ("b", "z"), ("a", None)], "x string, y string")
    assert {r.field: r.value for r in modes(df, ["x", "y"]).collect()} == {"x": "a", "y": "z"}


def test_typical_table(hr, typical):
    rows = {r.field: r for r in typical_table(engineer(hr, HR), HR).collect()}
    assert list(typical) == list(HR.model_columns)
    assert rows["Age"].number == typical["Age"] and rows["OverTime"].text == typical["OverTime"]


def test_rows_with_equal_or_missing_ids_are_explained_one_by_one(spark, hr):
    from staylight.scorecards import HR_SCORECARD

    settled, risky = person(1), person(1, **AT_RISK)
    rows = [settled, risky, {**settled, "EmployeeID": None}, {**risky, "EmployeeID": None}, settled]
    schema = hr.schema
    df = spark.createDataFrame([[float(r[f.name]) if f.dataType.simpleString() == "double" else r[f.name] for f in schema] for r in rows], schema)
    full = E.explained(df, HR, HR_SCORECARD, {}, 0.5).collect()
    assert len(full) == 5
    by = sorted((str(r.EmployeeID), r.will_leave) for r in full)
    assert by == sorted([("EMP-0001", False), ("EMP-0001", False), ("EMP-0001", True), ("None", False), ("None", True)])


def test_targets_that_share_a_bracket_are_counted_once(spark, monkeypatch):
    numbers = [float(i * i) for i in range(10)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    counted, struct = [], F.struct
    monkeypatch.setattr(T.F, "struct", lambda *parts: counted.append(1) or struct(*parts))
    found = T._narrowed(df, {("x", 4): (0.0, 81.0, 0, 10), ("x", 5): (0.0, 81.0, 0, 10)})
    assert len(counted) == 1
    assert found == {("x", 4): (16.0, 16.0, 4, 1), ("x", 5): (25.0, 25.0, 5, 1)}
