import datetime as dt
import os
import time
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.bindings import HR
from staylight.operators import scoring as S
from staylight.operators.clean import contract_columns
from staylight.plans.batch import score_batch
from staylight.scorecards import HR_SCORECARD
from staylight.sources import commits, files, log
from staylight.streaming import scoring as ST
from staylight.workspace import shared_folder, written
from tests.conftest import AT_RISK, person

DAY = dt.datetime(2024, 5, 1, 9, 30, 15, 999)


def entries(df, when=DAY, source="batch"):
    return log.log_rows(S.score(df, HR, HR_SCORECARD), HR, 0.5, source, when)


def test_log_row(spark):
    df = spark.createDataFrame([person(1, **AT_RISK, EmployeeID="x" * 80), person(2, EmployeeID="")])
    long, blank = entries(df).orderBy(F.desc(F.length("payload"))).collect()
    assert long.employee_ref == "x" * 64 and blank.employee_ref is None
    assert long.created_at == dt.datetime(2024, 5, 1, 9, 30, 15) and long.source == "batch"
    assert long.will_leave == int(long.probability >= 0.5) and long.years_here == 1
    assert '"OverTime":"Yes"' in long.payload and "Gender" not in long.payload


def test_append_summary_recent_clear(spark, hr, tmp_path):
    path = str(tmp_path / "log")
    for day in range(3):
        log.append(entries(hr, DAY + dt.timedelta(days=day), "csv"), path)
    stored = log.read_log(spark, path)
    total = log.summary(stored).first()
    rows = stored.collect()
    assert total.total == 240 and total.flagged == sum(r.will_leave for r in rows)
    assert total.salary_at_risk == pytest.approx(sum(r.salary * r.probability for r in rows), abs=1)
    newest = log.recent_from(spark, path, 100).collect()
    assert [tuple(r) for r in newest] == [tuple(r) for r in log.recent(stored, 100).collect()]
    assert {r.created_at.day for r in newest} == {3, 2} and len(newest) == 100
    assert log.recent(stored, 999).count() == 200 and log.recent(stored, 0).count() == 1
    assert log.clear(spark, path) == 240
    empty = log.summary(log.read_log(spark, path)).first()
    assert tuple(empty) == (0, 0, 0.0, 0)
    assert log.recent_from(spark, path).count() == 0
    log.append(entries(hr), path)
    assert log.read_log(spark, path).count() == 80


def test_a_run_replaces_itself_and_later_runs_are_newer(spark, hr, tmp_path):
    path = str(tmp_path / "log")
    log.append(entries(hr.limit(10)), path, "a")
    log.append(entries(hr.limit(10)), path, "a")
    log.append(entries(hr.limit(3), source="csv"), path, "b")
    assert log.read_log(spark, path).count() == 13
    assert [r.source for r in log.recent_from(spark, path, 5).collect()] == ["csv"] * 3 + ["batch"] * 2


def test_batches_and_streams_share_a_log(spark, hr, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    people = contract_columns(hr, HR)
    people.limit(30).withColumn("Age", F.when(F.col("EmployeeID") == "EMP-0003", 7.0).otherwise(F.col("Age"))).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def stream():
        entities = ST.read_entities(spark, source, schema)
        ST.score_stream(entities, HR, HR_SCORECARD, 0.5, path, state, F.lit(DAY)).awaitTermination()

    log.append(entries(hr), path)
    stream()
    log.append(entries(hr), path)
    stream()
    assert log.read_log(spark, path).count() == 80 + 29 + 80
    rejected = log.read_rejected(spark, path).collect()
    assert [(r.EmployeeID, r.violations[0].field) for r in rejected] == [("EMP-0003", "Age")]
    assert log.clear(spark, path) == 189
    stream()
    assert log.read_log(spark, path).count() == 0
    people.limit(5).write.mode("append").parquet(source)
    stream()
    log.append(entries(hr), path)
    assert log.read_log(spark, path).count() == 85


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\none,two\n")
    (folder / "b.csv").write_text("y,x\none,two\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_delimited(spark, str(folder)).collect()


def test_quoted_cells_read_alike_in_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('x,y\n"say ""hi"", now",1\n')
    batch = files.read_delimited(spark, str(folder))
    stream = ST.read_entities(spark, str(folder), batch.schema, "csv")
    query = stream.writeStream.format("memory").queryName("quoted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("quoted").collect() == batch.collect() and batch.first().x == 'say "hi", now'


def test_a_batch_from_file_to_report(spark, hr, tmp_path):
    folder, log_path = tmp_path / "up", str(tmp_path / "log")
    people = contract_columns(hr, HR).orderBy("EmployeeID").repartitionByRange(3, "EmployeeID")
    people.withColumns(
        {
            "JobLevel": F.when(F.col("EmployeeID") == "EMP-0004", "Overlord").otherwise(F.col("JobLevel")),
            "EmployeeID": F.when(F.col("EmployeeID") != "EMP-0009", F.col("EmployeeID")),
        }
    ).write.option("header", True).csv(str(folder))
    done = score_batch(spark, str(folder), HR, HR_SCORECARD, 0.5, log_path, str(tmp_path / "out"), DAY)
    ranked = done.ranked.collect()
    assert len(ranked) == 79 and [r.probability for r in ranked] == sorted((r.probability for r in ranked), reverse=True)
    number = {r.EmployeeID: r.row for r in ranked}
    assert number.pop("row-10") == 10
    assert all(int(k[4:]) + 1 == n for k, n in number.items())
    assert [(r.row, r.violations[0].value) for r in done.rejected.collect()] == [(5, "Overlord")]
    assert done.summary.first()["count"] == 79 == log.read_log(spark, log_path).count()
    assert files.read_delimited(spark, str(tmp_path / "out")).count() == 79


def test_a_file_without_an_id_column(spark, hr, tmp_path):
    path = str(tmp_path / "bare")
    contract_columns(hr, HR).drop("EmployeeID").limit(4).coalesce(1).write.option("header", True).csv(path)
    scored, _ = files.score_file(spark, path, HR, HR_SCORECARD)
    assert {r.EmployeeID for r in scored.collect()} == {f"row-{n}" for n in range(1, 5)}
    files.export_ranked(scored.drop("EmployeeID"), HR, 0.5, str(tmp_path / "out"))
    assert files.read_delimited(spark, str(tmp_path / "out")).count() == 4


def test_recent_reads_only_the_last_days(spark, hr, tmp_path):
    path = str(tmp_path / "log")
    for day in range(3):
        log.append(entries(hr, DAY + dt.timedelta(days=day)), path)
    plan = log.recent_from(spark, path, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-05-03" in plan


def test_file_and_table_score_alike(spark, hr, tmp_path):
    """Text ``None`` must not turn into a missing value on the file path."""
    path = str(tmp_path / "team")
    hr.write.option("header", True).csv(path)
    from_file = {r.EmployeeID: r.probability for r in files.score_file(spark, path, HR, HR_SCORECARD)[0].collect()}
    direct = {r.EmployeeID: r.probability for r in S.score(hr, HR, HR_SCORECARD).collect()}
    assert from_file == direct


def test_file_without_contract_is_refused(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("EmployeeID,Age\nEMP-1,30\n")
    with pytest.raises(ValueError, match="missing required columns"):
        files.score_file(spark, str(tmp_path / "bad.csv"), HR, HR_SCORECARD)


def test_export_is_ranked_with_nine_columns(spark, hr, tmp_path):
    path = str(tmp_path / "out")
    files.export_ranked(S.score(hr, HR, HR_SCORECARD), HR, 0.5, path)
    lines = []
    for name in sorted(f for f in os.listdir(path) if f.endswith(".csv")):
        text = (tmp_path / "out" / name).read_text().splitlines()
        assert text[0] == "EmployeeID,JobRole,Department,YearsAtCompany,MonthlyIncome,probability,percent,risk_band,will_leave"
        lines += text[1:]
    values = [float(line.split(",")[5]) for line in lines]
    assert len(values) == 80 and values == sorted(values, reverse=True)


def test_stale_outputs(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    (data / "a.csv").write_text("x\n1\n")
    assert files.outputs_are_stale(spark, str(data), str(out))
    out.mkdir()
    (out / "r").write_text("done")
    assert not files.outputs_are_stale(spark, str(data), str(out))
    later = time.time() + 60
    os.utime(data / "a.csv", (later, later))
    assert files.outputs_are_stale(spark, str(data), str(out))
    assert not files.outputs_are_stale(spark, str(tmp_path / "gone"), str(out))


def test_stale_by_fingerprint(spark, tmp_path):
    data, out, record = tmp_path / "data", tmp_path / "out", str(tmp_path / "record")
    data.mkdir(), out.mkdir()
    for name in "ab":
        (data / f"{name}.csv").write_text("x\n1\n")
    (out / "r").write_text("done")
    stale = lambda: files.outputs_are_stale(spark, str(data), str(out), record=record)
    assert stale()
    files.record_input(spark, str(data), record)
    assert not stale()
    # Put back with an older time: no output is older than it, yet it is another file.
    os.utime(data / "a.csv", (1_000_000, 1_000_000))
    assert stale() and not files.outputs_are_stale(spark, str(data), str(out))
    files.record_input(spark, str(data), record)
    (data / "b.csv").rename(tmp_path / "b.csv")
    assert stale()
    assert not files.outputs_are_stale(spark, str(tmp_path / "gone"), str(out), record=record)


def test_load_clean_formats(spark, hr, tmp_path):
    path = str(tmp_path / "p")
    hr.unionByName(hr.withColumn("Attrition", F.lit("Yes"))).withColumn(
        "seq", F.monotonically_increasing_id()
    ).write.parquet(path)
    assert files.load_clean(spark, path, HR, "parquet", "seq").count() == 80
    with pytest.raises(ValueError):
        files.load_clean(spark, path, HR, "table")
    with pytest.raises(ValueError):
        files.load_clean(spark, path, HR, "xml")


def test_stream_equals_batch(spark, hr, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    people = contract_columns(hr, HR)
    people.limit(50).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def arrive():
        entities = ST.read_entities(spark, source, schema, files_per_batch=1)
        rows, rejected = ST.scored_stream(entities, HR, HR_SCORECARD, 0.5, F.lit(DAY))
        ST.append_stream(rows, sink, state).awaitTermination()
        assert rejected.isStreaming

    arrive()
    first = log.read_log(spark, sink).count()
    rest = people.join(spark.read.parquet(source).select("EmployeeID"), "EmployeeID", "left_anti")
    rest.unionByName(rest.limit(1).withColumn("JobLevel", F.lit("Overlord"))).write.mode("append").parquet(source)
    arrive()
    streamed = log.read_log(spark, sink)
    assert first == 50 and streamed.count() == 80
    keep = ["employee_ref", "probability", "risk_band", "will_leave", "salary", "years_here", "job_role", "payload"]
    assert sorted(streamed.select(keep).collect()) == sorted(entries(people).select(keep).collect())

    totals = ST.running_summary(spark, sink).collect()
    assert totals == log.summary(streamed).collect()
    # A micro-batch that runs again replaces its own part of the totals.
    batch = streamed.filter("run = 'stream-000000000000'")
    log.append(written(batch.drop("run"), "again"), sink, "stream-000000000000")
    assert ST.running_summary(spark, sink).collect() == totals and log.read_log(spark, sink).count() == 80


def test_a_stream_commits_scored_and_rejected_rows_together(spark, hr, tmp_path, monkeypatch):
    source, sink, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    people = contract_columns(hr, HR).limit(40).withColumn("Age", F.when(F.col("EmployeeID") < "EMP-0003", 7.0).otherwise(F.col("Age")))
    people.coalesce(1).write.parquet(source)
    bad = people.filter("Age = 7.0").count()
    schema = spark.read.parquet(source).schema

    def stream():
        entities = ST.read_entities(spark, source, schema, files_per_batch=1)
        ST.score_stream(entities, HR, HR_SCORECARD, 0.5, sink, state, F.lit(DAY)).awaitTermination()

    def lost(*args):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(log, "publish", lost)
        with pytest.raises(Exception, match="lost before"):
            stream()
    # Both tables were written, neither is seen.
    assert log.read_log(spark, sink).count() == 0 and log.read_rejected(spark, sink) is None
    stream()
    stream()
    assert bad > 0 and log.read_log(spark, sink).count() == 40 - bad
    rejected = log.read_rejected(spark, sink).collect()
    assert len(rejected) == bad and {r.violations[0].field for r in rejected} == {"Age"}
    assert {r.run for r in rejected} == {"stream-000000000000"}


def test_two_writers_and_a_lost_one_leave_whole_runs(spark, hr, tmp_path):
    path = str(tmp_path / "log")
    days = lambda n, source: reduce(DataFrame.unionByName, (entries(hr.limit(n), DAY + dt.timedelta(days=d), source) for d in range(3)))

    def write(job):
        log.append(days(*job), path, job[1])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, [(5, "a"), (7, "b"), (5, "c"), (7, "d")]))
    # A writer that is lost while it writes leaves files of some days, and no entry.
    days(9, "lost").filter("score_date < '2024-05-03'").withColumn("run", F.lit("lost")).write.partitionBy("score_date").parquet(f"{path}/data/attempt=lost")
    found = {(r.run, r.score_date, r["count"]) for r in log.read_log(spark, path).groupBy("run", "score_date").count().collect()}
    assert {(run, n) for run, _, n in found} == {("a", 5), ("b", 7), ("c", 5), ("d", 7)} and len(found) == 12
    assert commits.live(spark, path).select("number").distinct().count() == 4
    reader = log.read_log(spark, path)
    assert log.clear(spark, path) == 72
    assert reader.count() == 72 and log.read_log(spark, path).count() == 0
    assert log.stored_summary(spark, path).collect() == log.summary(log.read_log(spark, path)).collect()


def test_an_entry_is_created_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert [commits.publish(spark, path, {"op": "append", "run": r}) for r in "ab"] == [1, 2]
    assert not commits._create(spark, f"{path}/commits/000000000002.json", {"token": "x", "op": "clear"})
    # The empty file of a lost writer takes a number and says nothing.
    (tmp_path / "log" / "commits" / "000000000003.json").touch()
    assert commits.publish(spark, path, {"op": "append", "run": "b", "rows": 4}) == 4
    assert sorted((r.run, r.number) for r in commits.live(spark, path).collect()) == [("a", 1), ("b", 4)]


def test_stream_fills_defaults(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    spark.createDataFrame([("E1", 1)], "EmployeeID string, YearsAtCompany int").write.parquet(source)
    entities = ST.read_entities(spark, source, spark.read.parquet(source).schema)
    rows, _ = ST.scored_stream(entities, HR, HR_SCORECARD, 0.5)
    ST.append_stream(rows, sink, state).awaitTermination()
    row = log.read_log(spark, sink).first()
    assert (row.source, row.years_here, row.salary) == ("stream", 1, 60000.0)


def test_workspace_is_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(3).toDF("x")
    assert written(df, "t").schema["x"].dataType == df.schema["x"].dataType
