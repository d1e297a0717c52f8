import pytest
from pyspark.sql import functions as F

from staylight.bindings import ACCOUNTS, HR
from staylight.operators import clean as K
from staylight.operators.features import model_frame
from staylight.operators.quality import quality_checks
from staylight.sources.files import file_order, load_clean, read_delimited
from staylight.spec import PanelSpec
from tests.conftest import person


def test_messy_row_is_tidied(spark):
    messy = spark.createDataFrame(
        [(" EMP-1 ", "  Sales  ", "Yes", "  50000 ")],
        "EmployeeID string, Department string, Attrition string, MonthlyIncome string",
    )
    row = K.clean(messy, HR).first()
    assert (row.EmployeeID, row.Department, row.MonthlyIncome) == ("EMP-1", "Sales", 50000.0)


@pytest.mark.parametrize(
    "text,expected",
    [("12", 12.0), (" 1.5e3 ", 1500.0), ("abc", 0.0), (None, 0.0), ("", 0.0), ("12d", 0.0),
     ("Infinity", 0.0), ("NaN", 0.0), ("1e999", 0.0), ("-4", -4.0), (".5", 0.5), ("7.", 7.0),
     (" 8 ", 8.0)],
)
def test_numbers_from_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "Age string")
    assert K.coerce_numerics(df, HR).first().Age == expected


def test_numbers_that_are_not_finite_become_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (3.0,)], "Age double")
    assert [r.Age for r in K.coerce_numerics(df, HR).collect()] == [0.0, 0.0, 0.0, 3.0]


def test_first_duplicate_stays(spark):
    df = spark.createDataFrame(
        [("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only"), ("a", 2, None)],
        "EmployeeID string, seq int, Department string",
    )
    kept = {r.EmployeeID: r.Department for r in K.clean(df, HR, "seq").collect()}
    assert kept == {"a": "first", "b": "only"}


def test_a_null_in_the_first_duplicate_is_kept(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x")], "EmployeeID string, seq int, Department string")
    assert K.clean(df, HR, "seq").collect()[0].Department is None


def test_first_duplicate_by_place_in_the_file(spark, tmp_path):
    lines = ["EmployeeID,Department"] + [f"EMP-{i % 50},d{i}" for i in range(500)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    kept = load_clean(spark, str(tmp_path), HR).collect()
    assert {r.EmployeeID: r.Department for r in kept} == {f"EMP-{i}": f"d{i}" for i in range(50)}


def test_none_is_a_value_and_only_empty_cells_are_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('EmployeeID,StockOptionLevel,Department\n1,None,\n2,NA,""\n')
    rows = read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert [r.StockOptionLevel for r in rows] == ["None", "NA"]
    assert [r.Department for r in rows] == [None, None]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_delimited(spark, str(tmp_path / "nowhere.csv"))


def test_target_in_any_case(spark):
    df = spark.createDataFrame([("Yes",), ("YES",), ("no",), (None,)], "Attrition string")
    assert [r.label for r in K.with_target(df, HR).collect()] == [1, 1, 0, 0]


def test_protected_columns_never_reach_the_model(hr):
    features = K.drop_unmodelled(hr, HR).columns
    assert not {"EmployeeID", "Attrition", "Gender"} & set(features)
    assert model_frame(hr, HR).columns == list(HR.model_columns)
    with pytest.raises(ValueError, match="Gender"):
        K.assert_modelled_columns(["Age", "Gender"], HR)


def test_a_spec_may_not_use_a_protected_column():
    with pytest.raises(ValueError, match="region"):
        PanelSpec(
            name="x", entity_id="id", target="t", monitor_only=("region",),
            categoricals={"region": ()}, numerics=(), income="n",
        )


def test_validation_rules(spark):
    cases = [
        ({}, set()),
        ({"JobLevel": "Overlord"}, {("JobLevel", "unknown category")}),
        ({"Age": "9"}, {("Age", "below minimum")}),
        ({"MonthlyIncome": -1.0}, {("MonthlyIncome", "below minimum")}),
        ({"Age": "30.5"}, {("Age", "not a whole number")}),
        ({"Age": "x"}, {("Age", "not a number")}),
        ({"Age": None}, {("Age", "missing")}),
        ({"DistanceFromHome": 201}, {("DistanceFromHome", "above maximum")}),
        ({"MonthlyIncome": float("nan")}, {("MonthlyIncome", "not a number")}),
    ]
    plain = {"Age": "44", "MonthlyIncome": 280000.0}
    rows = [person(i, **{**plain, **flaw}) for i, (flaw, _) in enumerate(cases)]
    found = K.violation_rows(spark.createDataFrame(rows), HR).collect()
    for i, (_, expected) in enumerate(cases):
        assert {(r.field, r.rule) for r in found if r.EmployeeID == f"EMP-{i:04d}"} == expected


def test_rejected_rows_keep_every_violation(spark):
    rows = [person(1), person(2, JobLevel="Overlord", Age=9)]
    valid, rejected = K.split_valid(spark.createDataFrame(rows), HR)
    assert [r.EmployeeID for r in valid.collect()] == ["EMP-0001"]
    assert len(rejected.first().violations) == 2
    nulls = spark.createDataFrame([(None,)], "lang string").select(
        F.lit(1).alias("doc_id"), "lang", F.lit("s").alias("source"), F.lit(3).alias("n_chars")
    )
    from staylight.bindings import DOCUMENTS

    assert [r.rule for r in K.violation_rows(nulls, DOCUMENTS).collect()] == ["missing"]


def test_defaults_fill_absent_columns_only(spark):
    sparse = spark.createDataFrame([(1,)], "YearsAtCompany int")
    row = K.apply_defaults(sparse, HR).first()
    assert (row.YearsAtCompany, row.Age, row.JobRole) == (1, 30, "Research Scientist")


def test_contract_names_every_missing_column(spark):
    bad = spark.createDataFrame([("EMP-1", 30)], "EmployeeID string, Age int")
    with pytest.raises(ValueError, match="missing required columns: Department, JobRole.*YearsSinceLastPromotion"):
        K.require_columns(bad, HR)


def test_form_projection_keeps_the_id_as_join_key(hr):
    from staylight.operators.features import engineer

    columns = K.form_projection(engineer(hr, HR), HR).columns
    assert set(columns) == {"EmployeeID", *HR.contract}


def test_rows_without_id_get_a_reference(spark):
    df = spark.createDataFrame([("E1", 1), (None, 2), ("", 3)], "EmployeeID string, n int")
    ids = [r.EmployeeID for r in K.with_row_reference(df, HR, F.col("n")).collect()]
    assert ids == ["E1", "row-2", "row-3"]
    assert K.with_row_reference(df.select("n"), HR, F.col("n")).first().EmployeeID == "row-1"


def test_quality_checks(spark, hr):
    assert all(r.passed for r in quality_checks(hr, HR).collect())
    twice = hr.unionByName(hr.limit(3))
    failed = {r.check: r.observed for r in quality_checks(twice, HR).collect() if not r.passed}
    assert failed == {"ids are unique": 3}
    assert ACCOUNTS.entity_id not in ACCOUNTS.model_columns


def test_file_order_needs_no_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EmployeeID,Department\n1,a\n1,b\n")
    raw = read_delimited(spark, str(tmp_path / "a.csv")).withColumn("o", file_order())
    assert K.clean(raw, HR, "o").columns == ["EmployeeID", "Department"]
