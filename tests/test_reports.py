from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.operators import breakdowns as B
from staylight.operators.features import engineer
from staylight.operators.headlines import headlines
from staylight.plans.analysis import HR_HISTOGRAMS, insight_tables, write_analysis
from staylight.sources.store import read_tables
from tests.conftest import people, person


@pytest.fixture(scope="module")
def enriched(hr):
    return engineer(hr, HR)


@pytest.fixture(scope="module")
def rates(enriched):
    return B.breakdowns(enriched, HR)


def test_kpis(enriched):
    kpi = B.kpis(enriched, HR).first()
    rows = people(80)
    gone = [r for r in rows if r["Attrition"] == "Yes"]
    assert (kpi.employees, kpi.left, kpi.stayed) == (80, len(gone), 80 - len(gone))
    assert kpi.attrition_rate == round(len(gone) / 80, 4)
    assert kpi.monthly_salary_lost == sum(r["MonthlyIncome"] for r in gone)
    assert kpi.replacement_cost == 6 * kpi.monthly_salary_lost
    assert kpi.avg_age_left == pytest.approx(sum(r["Age"] for r in gone) / len(gone), abs=0.05)


def test_every_breakdown_covers_everyone(rates):
    totals = defaultdict(int)
    for row in rates.collect():
        totals[row.attribute] += row.total
        assert row.left + row.stayed == row.total and 0 <= row.attrition_rate <= 1
        assert row.monitor_only == (row.attribute == "Gender")
    assert set(totals) == set(HR.breakdowns) and set(totals.values()) == {80}


def test_counts_and_order(rates):
    want = Counter(r["OverTime"] for r in people(80))
    rows = rates.filter("attribute = 'OverTime'").orderBy("position").collect()
    assert [(r.category, r.total) for r in rows] == [("No", want["No"]), ("Yes", want["Yes"])]
    roles = rates.filter("attribute = 'JobRole'").orderBy("position").collect()
    exact = [r.left / r.total for r in roles]
    assert exact == sorted(exact, reverse=True)


def test_unknown_and_missing_categories_are_not_dropped(spark):
    rows = [person(1, JobLevel="Entry"), person(2, JobLevel="Zeta"), person(3, JobLevel="Alpha"),
            person(4, JobLevel=None), person(5, JobLevel="Executive")]
    df = engineer(spark.createDataFrame(rows), HR)
    found = B.breakdowns(df, HR, ["JobLevel"]).orderBy("position").collect()
    assert [r.category for r in found] == ["Entry", "Executive", "(missing)", "Alpha", "Zeta"]


def test_histogram_extends_to_the_top_and_skips_empty_bins(spark):
    rows = [person(i, YearsAtCompany=y) for i, y in enumerate((0, 4, 5, 19, 20, 26, 40))]
    df = spark.createDataFrame(rows)
    bins = B.histogram(df, HR, "YearsAtCompany", (0, 5, 10, 15, 20), "{low}-{high}y").orderBy("low")
    assert [(r.label, r.total) for r in bins.collect()] == [
        ("0-5y", 2), ("5-10y", 1), ("15-20y", 1), ("20-25y", 1), ("25-30y", 1), ("40-45y", 1)
    ]
    ages = spark.createDataFrame([person(1, Age=17), person(2, Age=18), person(3, Age=54)])
    bins = B.histogram(ages, HR, "Age", (18, 27, 36, 45, 54)).orderBy("low").collect()
    assert [(r.label, r.total) for r in bins] == [("18-27", 1), ("54-63", 1)]
    with pytest.raises(ValueError):
        B.histogram(ages, HR, "Age", (18, 18))


def test_segments_leave_protected_columns_out(enriched, rates):
    found = B.risk_segments(rates, B.overall_rate(enriched, HR), HR).orderBy("position").collect()
    assert len(found) == 8 and not any("Gender" in r.segment for r in found)
    assert all(r.employees >= 8 for r in found)
    values = [r.attrition_rate for r in found]
    assert values == sorted(values, reverse=True)
    base = B.kpis(enriched, HR).first()
    for r in found:
        assert r.lift == pytest.approx(r.attrition_rate / (base.left / base.employees), abs=0.0051)


def test_headlines_only_claim_what_holds(spark, enriched):
    rows = [person(i, OverTime="Yes", Attrition="Yes", MonthlyIncome=50000) for i in range(3)]
    rows += [person(10 + i, OverTime="No", MonthlyIncome=125000) for i in range(5)]
    df = engineer(spark.createDataFrame(rows), HR)
    found = {r.title: r.detail for r in headlines(df, HR).collect()}
    assert set(found) == {
        "Overtime is the clearest warning sign there is",
        "The people leaving are the ones paid least",
        "What this costs",
    }
    assert found["Overtime is the clearest warning sign there is"].startswith("100% of people regularly working overtime left, against 0% of")
    assert "₹50,000 a month on average; those who stayed earned ₹1,25,000 - a gap of ₹75,000" in found["The people leaving are the ones paid least"]
    assert "The 3 people who left were earning ₹1,50,000 a month" in found["What this costs"]
    assert "roughly ₹9,00,000 to rebuild" in found["What this costs"]
    for row in headlines(enriched, HR).collect():
        assert row.detail.endswith(".") and "$" not in row.detail


def test_headlines_without_any_rows(spark, enriched):
    empty = enriched.filter(F.lit(False))
    assert [r.title for r in headlines(empty, HR).collect()] == ["What this costs"]


def test_roster_is_ordered(hr):
    rows = B.roster(hr, HR).collect()
    keys = [(r.YearsAtCompany, r.EmployeeID) for r in rows]
    assert len(rows) == 80 and keys == sorted(keys)


def test_analysis_is_written(spark, hr, tmp_path):
    names = write_analysis(hr, HR, str(tmp_path), HR_HISTOGRAMS)
    assert set(names) == {"kpis", "breakdowns", "risk_segments", "headlines", "roster",
                          "tenure_histogram", "age_histogram"}
    stored = read_tables(spark, str(tmp_path), *names)
    assert stored["kpis"].first().employees == 80
    fresh = insight_tables(hr, HR)["breakdowns"]
    assert sorted(stored["breakdowns"].collect()) == sorted(fresh.collect())
