import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import values
from meterlake.operators import ingest
from meterlake.schema import BULK, STANDARD_COLUMNS, TASK
from meterlake.sources import history, log_files
from meterlake.sources.organizations import organizations
from meterlake.sources.sinks import export_batch, write_summary_report

RUN_DATE = dt.date(2024, 7, 1)
NOW = dt.datetime(2024, 7, 1, 8)

FILES = {
    "task_usage_standard.csv": """ taskid ,Task Name,task object name,tasktype,TaskRunID,Project Name,Folder Name,OrgID,Environement,Cores Used,Start Time,End Time,Status,Metered Value,Audit Time,OBM Task Time(s)
1,load a,o1,T,r1,P,F,1001,Env - X,2,2024-06-05 10:11,2024-06-05 10:21:30,Success,10,2024-06-06,5
2,load b,,T,r2,,F,1001,Env,2,05/06/2024 10:00,01/13/2024,Failed,12abc,2024-06-06,5
,,,,,,,,,,,,,,,
3,load c,o3,T,r3,P,F,1001,Env,2,10:11:12,2024-06-09 01:02:03,Success, 12 ,05/06/2024,5
4,"load ""d"", x",o4,T,r4,P,F,1001,Env,2,NaT,,Success,nan,,5
""",
    "org_ami.csv": """Job Name,Agent Name,Volume (GBs),Job Start Time (UTC),Job End Time (UTC),Metering Date (UTC),Task Name
j1,ag,10,2024-06-05 10:00:00,2024-06-05 11:00:00,2024-06-05,sync
j2,ag,5,2024-06-05 10:00:00,,2024-06-06,sync
j3,ag,5,2024-06-05 10:00:00,,,sync
""",
    "legacy_bytes.csv": """Date,Utilization(Bytes),Task ID,End Time
2024-06-05,1073741824,t1,
05/06/2024,2147483648,t2,2024-06-07 12:00:00
,3221225472,t3,
""",
    "both_massingest.csv": "Job Name,Volume (GBs),Project Name\nj9,1,P\n",
    "both.csv": "Job Name,Volume (GBs),Project Name\nj8,1,P\n",
    "neither_massingest.csv": "Task Run ID,Status\nr7,Done\n",
    "neither.csv": "Task Run ID,Status\nr6,Done\n",
    "two_environment_headers.csv": "Task ID,Metered Value,Environment,Runtime Environment\n5,1,,second\n6,1,first,second\n",
    "broken.csv": "Task ID,Metered Value\n1,2\n3,4,5,6\n",
    "empty.csv": "",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    for name, text in FILES.items():
        (path / name).write_text(text)
    return path


def read(spark, folder, *names, **options):
    return log_files.ingest_files(spark, [str(folder / n) for n in names], RUN_DATE, **options)


def test_standard_file(spark, folder):
    df, errors = read(spark, folder, "task_usage_standard.csv", orgs={"task_usage_standard.csv": "North Mass Ingestion"})
    assert [(e.file_path.rsplit("/", 1)[1], *e[1:]) for e in errors.collect()] == [("task_usage_standard.csv", "Metered Value: no date or number", 1)]
    got = values(df.orderBy("task_id"), "task_id", "task_name", "task_object_name", "project_name", "org", "log_type", "environment",
                 "start_time", "end_time", "metered_value", "ipus", "cost", "run_date", "org_id")
    day, t = RUN_DATE, dt.datetime
    assert got == [
        ("1", "load a", "o1", "P", "North", TASK, "Env - X", t(2024, 6, 5, 10, 11), t(2024, 6, 5, 10, 21, 30), 10.0, 1.6, 57.664, day, "1001"),
        ("2", "load b", None, None, "North", TASK, "Env", t(2024, 6, 5, 10), t(2024, 1, 13), None, 0.0, 0.0, day, "1001"),
        ("3", "load c", "o3", "P", "North", TASK, "Env", t(2024, 6, 5, 10, 11, 12), t(2024, 6, 9, 1, 2, 3), 12.0, 1.92, 69.1968, day, "1001"),
        ("4", 'load "d", x', "o4", "P", "North", TASK, "Env", None, None, None, 0.0, 0.0, day, "1001"),
    ]


def test_bulk_file(spark, folder):
    df, _ = read(spark, folder, "org_ami.csv", orgs={"org_ami.csv": "North"})
    end = dt.datetime(2024, 6, 6, 23, 59, 59)
    assert values(df.orderBy("task_id"), "task_id", "task_run_id", "task_type", "org", "log_type", "end_time", "status", "ipus") == [
        ("j1", "j1", "sync", "North Mass Ingestion", BULK, dt.datetime(2024, 6, 5, 11), "Completed", 1.0),
        ("j2", "j2", "sync", "North Mass Ingestion", BULK, end, "Running", 0.5),
        ("j3", "j3", "sync", "North Mass Ingestion", BULK, None, "Running", 0.5),
    ]


def test_legacy_bulk_file(spark, folder):
    df, _ = read(spark, folder, "legacy_bytes.csv")
    assert values(df.orderBy("task_id"), "task_id", "task_run_id", "start_time", "end_time", "status", "metered_value", "org") == [
        ("t1", "t1", dt.datetime(2024, 6, 5), dt.datetime(2024, 6, 5, 23, 59, 59), "Completed", 1.0, "Unknown Mass Ingestion"),
        ("t2", "t2", None, dt.datetime(2024, 6, 7, 12), "Completed", 2.0, "Unknown Mass Ingestion"),
        ("t3", "t3", None, None, "Running", 3.0, "Unknown Mass Ingestion"),
    ]


@pytest.mark.parametrize("name, kind", [
    ("both_massingest.csv", BULK), ("both.csv", BULK), ("neither_massingest.csv", BULK), ("neither.csv", TASK),
    ("task_usage_standard.csv", TASK), ("org_ami.csv", BULK), ("legacy_bytes.csv", BULK), ("empty.csv", TASK), ("gone_mi.csv", BULK),
])
def test_log_type(spark, folder, name, kind):
    assert log_files.peek_log_type(spark, str(folder / name)) == kind


@pytest.mark.parametrize("headers, name, kind", [
    (["Volume (GBs)", "Agent Name"], None, BULK),
    (["Agent Name", "Metered Value", "Task Run ID"], None, BULK),
    (["Task ID", "Metered Value"], "x_massingest.csv", TASK),
    (["Task ID", "Metered Value", "Job Name"], "x.csv", TASK),
    (["Utilization (Bytes)", "date"], "x.csv", BULK),
    (["Utilization (Bytes)"], "mi.csv", TASK),
    (["anything"], "some/dir/orgmi.csv", BULK),
])
def test_detect_log_type(headers, name, kind):
    assert ingest.detect_log_type(headers, name) == kind


@pytest.mark.parametrize("assigned, kind, org", [
    ("A", BULK, "A Mass Ingestion"), ("A Mass Ingestion", BULK, "A Mass Ingestion"), ("A Mass Ingestion", TASK, "A"),
    (None, TASK, "Unknown"), (None, BULK, "Unknown Mass Ingestion"), ("A", TASK, "A"),
])
def test_file_org(assigned, kind, org):
    assert ingest.file_org(assigned, kind) == org


def test_unread_cells_are_counted_for_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Task ID,Start Time,End Time,Metered Value,Cores Used\n1,soon,2024-13-45,x,\n2,10:11,later,1e3,NaN\n3,\"Wed, 03 Jan 2024 10:00:00\",3rd Jan 2024,1,two\n4,January 3 2024 5pm,None,,\n")
    (tmp_path / "b_mi.csv").write_text("Date,Utilization (Bytes),Task ID,End Time\n2024-06-05,many,t1,\nsomeday,5,t2,\n")
    df, errors = read(spark, tmp_path, "a.csv", "b_mi.csv")
    got = sorted((e.file_path.rsplit("/", 1)[1], e.error.split(":")[0], e.cells) for e in errors.collect())
    assert got == [
        ("a.csv", "Cores Used", 1), ("a.csv", "End Time", 2), ("a.csv", "Metered Value", 1), ("a.csv", "Start Time", 1),
        ("b_mi.csv", "Date", 1), ("b_mi.csv", "Utilization (Bytes)", 1),
    ]
    times = values(df.where("task_id in ('3', '4')").orderBy("task_id"), "start_time", "end_time")
    assert times == [(dt.datetime(2024, 1, 3, 10), dt.datetime(2024, 1, 3)), (dt.datetime(2024, 1, 3, 17), None)]


def test_files_are_joined_without_a_shuffle_of_the_rows(spark, folder):
    df, errors = read(spark, folder, "both.csv", "broken.csv", "neither.csv", orgs={"both.csv": "North"})
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert values(df.orderBy("task_run_id"), "task_run_id", "org") == [("j8", "North Mass Ingestion"), ("r6", "Unknown")]
    assert [(e.file_path.rsplit("/", 1)[1], *e[1:]) for e in errors.collect()] == [("broken.csv", log_files.SURPLUS_ERROR, None)]


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"file{i}.csv").write_text(f"Task ID,Metered Value\n{i},1\n" if i % 2 else f"Task ID,Metered Value,Status\n{i},1,Done\n")
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for n in (20, 300):
        spark.sparkContext.setJobGroup(f"ingest{n}", "")
        df, errors = read(spark, tmp_path, *[f"file{i}.csv" for i in range(n)], orgs=lambda path: path.rsplit("/", 1)[1])
        assert (df.count(), df.select("org").distinct().count(), errors.count()) == (n, n, 0)
        jobs[n] = len(tracker.getJobIdsForGroup(f"ingest{n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[300] <= jobs[20] + 3  # for each of three scans Spark lists more than 32 paths by a job


def test_organizations_follow_from_file_names(spark, tmp_path):
    catalog = organizations(spark, [{"name": "Kid", "filename_tokens": ["kid"]}, {"name": "Kid-Prod", "filename_tokens": ["kid-prod", "kid"]}, {"name": "Else"}])
    text = "Task ID,Metered Value\n1,1\n"
    names = ["kid_prod.csv", "kid.csv", "kid (1).csv", "kid (2).csv", "kidmi.csv", "other.csv", "given.csv"]
    for name in names:
        (tmp_path / name).write_text(text)
    df, _ = read(spark, tmp_path, *names, orgs={"given.csv": "Named"}, catalog=catalog)
    got = {r.source_file.rsplit("/", 1)[1].replace("%20", " "): r.org for r in df.select("source_file", "org").collect()}
    # the last file without a match gets the first label of its kind that no file has
    assert got == {"kid_prod.csv": "Kid-Prod", "kid.csv": "Kid", "kid (1).csv": "Kid", "kid (2).csv": "Kid", "kidmi.csv": "Kid", "other.csv": "Else", "given.csv": "Named"}


def test_given_log_type_wins(spark, folder):
    df, _ = read(spark, folder, "neither.csv", log_types={"neither.csv": BULK})
    assert values(df, "log_type", "org") == [(BULK, "Unknown Mass Ingestion")]


def test_two_headers_for_one_column(spark, folder):
    df, _ = read(spark, folder, "two_environment_headers.csv")
    assert values(df.orderBy("task_id"), "environment") == [("second",), ("first",)]


def test_bad_files_do_not_stop_others(spark, folder):
    df, errors = read(spark, folder, "broken.csv", "empty.csv", "missing.csv", "neither.csv")
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in errors.collect()) == ["broken.csv", "empty.csv", "missing.csv"]
    assert values(df, "task_run_id") == [("r6",)]
    everything_failed, errors = read(spark, folder, "broken.csv")
    assert everything_failed.count() == 0 and errors.count() == 1 and "ipus" in everything_failed.columns


def test_all_files_have_one_schema(spark, folder):
    df, errors = read(spark, folder, *FILES)
    assert df.count() == 4 + 3 + 3 + 4 + 2 and errors.where("cells is null").count() == 2
    assert ingest.standard_frame(df).columns == list(STANDARD_COLUMNS)


def test_append_and_repeat(spark, folder, tmp_path):
    root = str(tmp_path / "lake")
    df, _ = read(spark, folder, "task_usage_standard.csv", "org_ami.csv")
    first = history.append_tasks(spark, root, df, NOW)
    assert (first.rows_added, first.total_rows) == (7, 7)
    assert (first.start_date, first.end_date) == (dt.date(2024, 1, 13), dt.date(2024, 6, 9))
    assert first.added_ranges == "2024-01-13; 2024-06-05 to 2024-06-06; 2024-06-09"
    again = history.append_tasks(spark, root, df.withColumn("status", F.lit("Changed")), NOW)
    assert (again.rows_added, again.total_rows, again.start_date) == (0, 7, None)
    twice = history.append_tasks(spark, root, df.unionByName(df).withColumn("task_name", F.lit("other")), NOW)
    assert (twice.rows_added, twice.total_rows) == (7, 14)
    shown = history.events_display(history.read_events(spark, root, "ADD"))
    assert values(shown, "processed_date_range", "added_date_ranges", "affected_rows", "remaining_rows")[-1] == (
        "2024-01-13 to 2024-06-09", first.added_ranges, 7, 7)
    assert history.read_events(spark, root, limit=1).count() == 1


def test_delete_and_restore(spark, folder, tmp_path):
    from meterlake.operators.filters import TaskFilter

    root = str(tmp_path / "lake")
    df, _ = read(spark, folder, "task_usage_standard.csv", "org_ami.csv")
    history.append_tasks(spark, root, df, NOW)
    before = sorted(values(history.read_history(spark, root), "row_hash"))
    assert history.delete_tasks(spark, root, TaskFilter("2024-06-05", "2024-06-30", log_type=BULK), NOW) == (2, 5)
    assert history.delete_tasks(spark, root, TaskFilter("2024-01-01", "2024-01-31"), NOW) == (1, 4)
    left = history.read_history(spark, root)
    assert left.where("end_time is null").count() == 2  # rows without an end time are in no range
    assert "2024-01-01" not in {m for months in history.current_version(spark, root).parts.values() for m in months}
    assert history.delete_tasks(spark, root, TaskFilter("2020-01-01", "2020-01-31"), NOW) == (0, 4)
    assert history.append_tasks(spark, root, df, NOW).rows_added == 3
    assert sorted(values(history.read_history(spark, root), "row_hash")) == before
    assert values(history.read_events(spark, root, "DELETE"), "affected_rows", "remaining_rows", "note") != []


def test_only_rows_of_partly_repeated_months_are_compared(spark, folder, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    df, _ = read(spark, folder, "task_usage_standard.csv", "org_ami.csv")
    compared, whole = [], history.one_per_hash

    def seen(rows):
        compared.append(sorted(values(rows, "task_id")))
        return whole(rows)

    monkeypatch.setattr(history, "one_per_hash", seen)
    assert history.append_tasks(spark, root, df, NOW).rows_added == 7 and compared == []
    assert history.append_tasks(spark, root, df, NOW).rows_added == 0 and compared == []
    january = df.where("end_time < '2024-02-01'").withColumn("task_name", F.lit("other"))
    later = january.withColumn("status", F.lit("Changed"))
    both = later.unionByName(january).unionByName(df.where("task_id = 'j1'"))
    assert history.append_tasks(spark, root, both, NOW).rows_added == 1 and compared == [[("2",), ("2",)]]
    got = history.read_history(spark, root).where("task_name = 'other'")
    assert values(got, "task_id", "status", F.to_date("end_month")) == [("2", "Changed", dt.date(2024, 1, 1))]
    assert len(history.current_version(spark, root).parts) == 2


def test_changes_that_die_leave_the_old_state(spark, folder, tmp_path, monkeypatch):
    from meterlake.operators.filters import TaskFilter

    root = str(tmp_path / "lake")
    first, second = (read(spark, folder, n)[0] for n in ("task_usage_standard.csv", "org_ami.csv"))
    history.append_tasks(spark, root, first, NOW)

    def state():
        return sorted(values(history.read_history(spark, root), "row_hash", "org")), history.read_events(spark, root).count()

    before, unlisted = state(), len(history.remove_unlisted(spark, root))
    june = TaskFilter("2024-06-01", "2024-06-30")
    changes = [lambda: history.append_tasks(spark, root, second, NOW), lambda: history.delete_tasks(spark, root, june, NOW)]
    for step in ("write_change", "_publish", "_by_day"):
        for change in changes:
            whole = getattr(history, step)

            def dies(*args, whole=whole, step=step):
                if step == "write_change":
                    whole(*args)  # the rows are there, but in no list
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(history, step, dies)
                if not (step == "_by_day" and change is changes[1]):
                    with pytest.raises(RuntimeError, match="lost"):
                        change()
            assert state() == before
    assert unlisted == 0 and len(history.remove_unlisted(spark, root)) >= 3
    assert state() == before
    assert history.append_tasks(spark, root, second, NOW).total_rows == 7
    assert history.delete_tasks(spark, root, june, NOW) == (4, 3)
    assert values(history.read_events(spark, root), "action", "affected_rows", "remaining_rows") == [("DELETE", 4, 3), ("ADD", 3, 7), ("ADD", 4, 4)]


def test_two_writers_of_one_version(spark, folder, tmp_path):
    root = str(tmp_path / "lake")
    history.append_tasks(spark, root, read(spark, folder, "neither.csv")[0], NOW)
    version = history.current_version(spark, root)
    history.record_event(spark, root, "NOTE", None, None, None, None, "first", NOW)
    with pytest.raises(FileExistsError):
        history._publish(spark, root, version, None)
    assert values(history.read_events(spark, root), "action", "note") == [("NOTE", "first"), ("ADD", None)]


def test_retag_writes_only_months_with_a_row_to_change(spark, folder, tmp_path):
    root = str(tmp_path / "lake")
    df, _ = read(spark, folder, "task_usage_standard.csv", "org_ami.csv", orgs={"org_ami.csv": "North"})
    plain = df.withColumn("org", F.when(F.col("log_type") == BULK, F.lit("North")).otherwise(F.col("org")))
    history.append_tasks(spark, root, plain.unionByName(df.where("task_id = 'j1'")), NOW)  # j1 is there under both names
    files = lambda: {p for p in (tmp_path / "lake/data").rglob("*.parquet")}
    january = lambda: [f for f in history.read_history(spark, root).inputFiles() if "end_month=2024-01-01" in f]
    old, kept = files(), january()
    assert history.retag_tasks(spark, root, NOW) == (3, 7)
    got = history.read_history(spark, root)
    assert sorted(values(got.where("log_type = 'Mass Ingestion'"), "task_id", "org")) == [(j, "North Mass Ingestion") for j in ("j1", "j2", "j3")]
    assert january() == kept != [] and old < files()
    assert history.append_tasks(spark, root, df, NOW).rows_added == 0  # the new hashes are those of a new delivery
    assert history.retag_tasks(spark, root, NOW) == (0, 7)


def test_empty_batch(spark, folder, tmp_path):
    df, _ = read(spark, folder, "broken.csv")
    assert history.append_tasks(spark, str(tmp_path / "lake"), df, NOW) == history.AppendResult(0, 0)


def test_history_prunes_months(spark, folder, tmp_path):
    from meterlake.operators.filters import TaskFilter

    root = str(tmp_path / "lake")
    history.append_tasks(spark, root, read(spark, folder, "task_usage_standard.csv")[0], NOW)
    tasks = TaskFilter("2024-06-01", "2024-06-30").apply(history.read_history(spark, root))
    plan = tasks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(end_month" in plan and "GreaterThanOrEqual(end_time" in plan


def test_exports(spark, folder, tmp_path):
    df, _ = read(spark, folder, "task_usage_standard.csv")
    export_batch(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == list(STANDARD_COLUMNS) and back.count() == 4
    write_summary_report(df, str(tmp_path / "summary"))
    assert sorted(p.name for p in (tmp_path / "summary").iterdir()) == ["by_agent", "by_env", "by_log_type", "by_org", "overall"]


def test_stream_equals_batch(spark, folder, tmp_path):
    from meterlake.streaming.ingest import start_ingest

    source, root = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()

    def run():
        query = start_ingest(spark, str(source), root, str(tmp_path / "checkpoint"), orgs={"a.csv": "North"}, clock=lambda: NOW, max_files=1)
        query.awaitTermination()

    (source / "a.csv").write_text(FILES["task_usage_standard.csv"])
    (source / "b_ami.csv").write_text(FILES["org_ami.csv"])
    run()
    (source / "repeat").mkdir()
    (source / "repeat" / "a.csv").write_text(FILES["task_usage_standard.csv"])
    run()
    stored = history.read_history(spark, root)
    batch, _ = log_files.ingest_files(spark, log_files.list_log_files(spark, str(source)), RUN_DATE, {"a.csv": "North"})
    want = str(tmp_path / "batch")
    history.append_tasks(spark, want, batch, NOW)
    key = ["row_hash", "org", "status", "ipus", "end_time"]
    assert sorted(map(str, values(stored, *key))) == sorted(map(str, values(history.read_history(spark, want), *key)))
    assert stored.count() == 7


def test_merge_frames(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 3.0)], "i int, d double")
    assert values(log_files.merge_frames(spark, [a, b])) == [(1, "x", None), (2, None, 3.0)]
    assert log_files.merge_frames(spark, []).count() == 0


def test_frames_of_other_formats(spark, folder):
    raw = spark.read.option("header", True).csv(str(folder / "two_environment_headers.csv"))
    typed = raw.select(F.col("Task ID").cast("int"), F.col("Metered Value").cast("double"), F.col("Environment"), F.col("Runtime Environment"))
    df = log_files.ingest_frames(spark, {"two_environment_headers": typed}, RUN_DATE, {"two_environment_headers": "North"})
    files, _ = read(spark, folder, "two_environment_headers.csv", orgs={"two_environment_headers.csv": "North"})
    columns = [c for c in files.columns if c != "source_file"]
    assert sorted(map(str, values(df, *columns))) == sorted(map(str, values(files, *columns)))


def test_batch_views(spark, folder):
    """What a user looks at before saving works on the ingested frame itself."""
    from meterlake.operators import dedup, filters, series, stats

    df, _ = read(spark, folder, "task_usage_standard.csv", "org_ami.csv", orgs={"org_ami.csv": "North"})
    assert stats.headline(df).first().row_count == 7
    assert values(stats.batch_daily(df, "log_type"), "date", "run_count")[0] == (dt.date(2024, 1, 13), 1)
    assert stats.batch_hourly(df).count() > 1 and stats.summary_by(df, "project_name").count() == 1
    assert dict(values(stats.log_type_counts(df))) == {TASK: 4, BULK: 3}
    assert stats.duration_stats(df).first().task_count == 7
    assert filters.hours_between(df, "2024-06-01", "2024-06-30", 11, 11).count() == 1
    assert values(series.cumulative_by_org(df, "2024-06-01", "2024-06-30").where("org like 'North%'"), "cumulative_ipus") == [
        (1.0,), (1.5,), (1.5,)]
    copies = df.unionByName(df.where("task_id = '1'").withColumn("source_file", F.lit("other")))
    assert dedup.full_row_duplicates(copies).count() == 2


def test_line_breaks_in_cells_and_header(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('Task ID,"Free\ntext",Metered Value,Task Name\n1,"a\nb",2.5,"x, ""y""\nz"\n2,,3,plain\n')
    df, errors = log_files.ingest_files(spark, [str(path)], RUN_DATE)
    assert values(df.orderBy("task_id"), "task_id", "metered_value", "task_name") == [("1", 2.5, 'x, "y"\nz'), ("2", 3.0, "plain")]
    assert errors.count() == 0


def test_bad_files_are_found_by_their_whole_path(spark, tmp_path):
    from meterlake.sources.files import qualified

    path = tmp_path / "a b%20c.csv"
    path.write_text("Task ID,Metered Value\n1,2\n3,4,5,6\n")
    df, errors = log_files.ingest_files(spark, [str(path)], RUN_DATE)
    assert (df.count(), errors.count()) == (0, 1)
    assert qualified(spark, str(path)) == ("file", "", str(path)) == qualified(spark, f"file://{path}")
    assert log_files._reported("s3a://a/x.csv") != log_files._reported("s3a://b/x.csv")


def test_hash_keeps_parts_apart(spark):
    from meterlake.functions.identity import IDENTITY_TEXT, row_hash

    def row(**cells):
        return tuple(cells.get(c) for c in IDENTITY_TEXT) + (None, None, 1.0)

    rows = [row(task_id="a|b", task_run_id="c"), row(task_id="a", task_run_id="b|c"), row(task_id="a", task_run_id="1:b"),
            row(task_id="", task_run_id="1:b"), row(task_run_id="1:b")]
    schema = ", ".join(f"{c} string" for c in IDENTITY_TEXT) + ", start_time timestamp, end_time timestamp, metered_value double"
    hashes = [r[0] for r in values(spark.createDataFrame(rows, schema), row_hash())]
    assert len(set(hashes)) == 4 and hashes[3] == hashes[4]  # a blank is stored as NULL


def test_stream_batch_that_died_before_its_event(spark, folder, tmp_path, monkeypatch):
    from meterlake.streaming.ingest import start_ingest

    source, root = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()
    (source / "a.csv").write_text(FILES["task_usage_standard.csv"])
    (source / "broken.csv").write_text(FILES["broken.csv"])

    def run():
        start_ingest(spark, str(source), root, str(tmp_path / "checkpoint"), clock=lambda: NOW).awaitTermination()

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(history, "_publish", dies)
        with pytest.raises(Exception, match="lost"):
            run()
    assert history.read_history(spark, root).count() == 0 == history.read_events(spark, root).count()
    run()
    assert values(history.read_events(spark, root), "action", "affected_rows", "remaining_rows") == [("ADD", 4, 4)]
    assert spark.read.parquet(f"{root}/ingest_errors").count() == 2  # the broken file, and a cell that is no number
    batch = history.read_history(spark, root).first().batch_id
    df, _ = read(spark, folder, "task_usage_standard.csv")
    history.append_tasks(spark, root, df, NOW, batch)
    assert history.read_history(spark, root).count() == 4 and history.read_events(spark, root).count() == 1


def test_stream_leaves_no_staged_rows(spark, folder, tmp_path):
    from meterlake.sources import files
    from meterlake.streaming.ingest import start_ingest

    source, root = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()
    (source / "task_usage_standard.csv").write_text(FILES["task_usage_standard.csv"])
    shared = spark.conf.get("spark.checkpoint.dir")
    before = [n for n in files.names(spark, shared) if n.startswith("ingest-")]
    start_ingest(spark, str(source), root, str(tmp_path / "checkpoint"), clock=lambda: NOW).awaitTermination()
    assert [n for n in files.names(spark, shared) if n.startswith("ingest-")] == before
    assert files.names(spark, f"{root}/_staging") == [] and history.read_history(spark, root).count() == 4


def test_stream_takes_files_of_a_pattern(spark, folder, tmp_path):
    import gzip

    from meterlake.streaming.ingest import start_ingest

    source, root = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()
    (source / "a.csv.gz").write_bytes(gzip.compress(FILES["task_usage_standard.csv"].encode()))
    (source / "b.csv").write_text(FILES["both.csv"])
    start_ingest(spark, str(source), root, str(tmp_path / "checkpoint"), clock=lambda: NOW, pattern="*.csv.gz").awaitTermination()
    assert sorted(r.task_id for r in history.read_history(spark, root).collect()) == ["1", "2", "3", "4"]
