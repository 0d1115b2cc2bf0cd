import datetime as dt

from pyspark.sql import functions as F

from helpers import values
from meterlake.operators import reports as P
from meterlake.operators import runs as R
from meterlake.operators.filters import TaskFilter
from meterlake.operators.stats import org_stats
from meterlake.plans.comparisons import monthly_runs
from meterlake.plans.views import tasks_events, tasks_tpch
from meterlake.schema import EVENTS_SCHEMA
from meterlake.sources import history
from meterlake.sources.sinks import export_between


def test_run_tables(spark, sf, tmp_path):
    root = str(tmp_path / "runs")
    rows = monthly_runs(spark, sf).where("run_id in ('1998-01', '1998-02', '1998-03')")
    R.write_runs(rows, root)
    tables = R.read_runs(spark, root)
    assert [r.run_id for r in R.all_runs(tables["runs"]).collect()] == ["1998-03", "1998-02", "1998-01"]
    details = R.run_details(tables, "1998-02")
    want = org_stats(tasks_tpch(spark, sf), TaskFilter("1998-02-01", "1998-02-28"))
    assert values(details["org_summaries"].orderBy("org_name"), "org_name", "task_count", "total_ipus", "unique_tasks") == values(
        want.orderBy("org"), "org", "task_count", "total_ipus", "unique_tasks")
    assert R.run_details(tables, "none")["runs"].count() == 0
    assert R.delete_run(spark, root, "1998-02") and not R.delete_run(spark, root, "1998-02")
    left = R.read_runs(spark, root)
    assert all(t.where("run_id = '1998-02'").count() == 0 and t.count() > 0 for t in left.values())
    assert R.run_anomalies(left["runs"]).count() == 0  # two runs are too few


def test_audit_texts(spark):
    day = dt.date(2024, 1, 5)
    rows = [
        ("1", "ADD", day, dt.date(2024, 1, 9), 3, 3, "Added date range(s): 2024-01-05; 2024-01-09", dt.datetime(2024, 2, 1)),
        ("2", "ADD", day, day, 1, 4, "Saved file x; added date range(s): 2024-01-05", dt.datetime(2024, 2, 2)),
        ("3", "ADD", None, None, 1, 5, None, dt.datetime(2024, 2, 3)),
        ("4", "DELETE", day, day, 1, 4, "gone", dt.datetime(2024, 2, 3)),
    ]
    events = spark.createDataFrame(rows, EVENTS_SCHEMA)
    assert [r.event_id for r in history.list_events(events, limit=2).collect()] == ["4", "3"]
    assert values(history.events_display(history.list_events(events, "ADD")), "processed_date_range", "added_date_ranges") == [
        (None, ""), ("2024-01-05", "2024-01-05"), ("2024-01-05 to 2024-01-09", "2024-01-05; 2024-01-09")]


def test_export_between(spark, sf, tmp_path):
    tasks = tasks_events(spark, sf)
    start, end = dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 20)
    for fmt in ("csv", "parquet"):
        export_between(tasks, start, end, str(tmp_path / fmt), fmt)
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert back.count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() > 0
    first, last = back.agg(F.min("end_time"), F.max("end_time")).first()
    assert start <= first <= last <= end


def test_quiet_narrative(spark, sf):
    """A window without rows still gives a whole report."""
    text = [r.text for r in P.narrative(tasks_events(spark, sf), "2030-01-24").collect()]
    assert text == [
        "Past week (Jan 18 - Jan 24): total IPUs 0.00 -> previous week 0.00 (↑ 0.00)",
        "Log type comparison:", "Organization comparison:", "Environment comparison:",
        "Project anomalies:", "- None detected",
        "Task anomalies:", "- Changes", "  - None detected", "- Starts and stops", "  - None detected",
        "Task Spikes (Past Week):", "- No task showed a major spike versus prior baseline.",
    ]


def test_coverage_without_global_gaps(spark):
    def message(*rows):
        days = spark.createDataFrame([(o, dt.date(2024, 1, d)) for o, d in rows], "org string, end_date date")
        tasks = days.select("*", F.col("end_date").cast("timestamp").alias("end_time"), F.lit(None).cast("string").alias("log_type"))
        return [r.text for r in P.coverage_message(tasks, "2024-01-01", "2024-01-03").collect()]

    assert message(("A", 1), ("A", 2), ("A", 3)) == ["No missing days detected across the full available date span."]
    assert message(("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 3)) == [
        "Every calendar day has at least some data, but individual organizations still have gaps.",
        "- B (Task Usage): has January 1, 2024 → January 3, 2024, missing 1 day(s) in 1 gap(s) — January 2, 2024",
    ]


def test_executive_sections(spark, sf):
    text = [r.text for r in P.executive(tasks_tpch(spark, sf), "1999-05-31", "1999-06-02", ("monthly_calendar",)).collect()]
    assert text[:2] + text[5:7] == ["Usage Executive Trend Report", "Data through May 31, 1999", "Monthly Change (Calendar Month)", "May Change Report"]
    assert text[2:5] == P.SUMMARY and text[-4:] == P.ACTIONS
    assert text[7].endswith("crease from Apr to May")
    assert text[8] == "- Month to Date (May 1999): May 1, 1999 to May 31, 1999 (vs April 1, 1999 to April 30, 1999)."
    assert text[11].startswith("  - Totals: ") and text[11].endswith(" total IPUs.")
    assert any(t.startswith("- Organizations trending up: ") for t in text)
    assert "Potential Anomalies" in text and "Task Spike Watch" in text


def test_executive_without_rows(spark, sf):
    text = [r.text for r in P.executive(tasks_tpch(spark, sf), "2030-05-20", "2030-06-02", ("quarterly", "weekly")).collect()]
    assert "- Quarter to Date (Q2 2030): April 1, 2030 to May 20, 2030 (vs January 1, 2030 to February 19, 2030)." in text
    assert "- Past Week: May 14, 2030 to May 20, 2030 (vs May 7, 2030 to May 13, 2030)." in text
    for line in ("- Organizations: no data in either comparison window.", "- Projects: no data in either comparison window.",
                 "- No organization-level changes found for this period.", "  - Totals: 0 tasks, 0.00 total IPUs."):
        assert text.count(line) == 2
    assert not any("trending" in t or "Change Report" in t for t in text)


def subtree(plan, start):
    """The lines of a plan below the one that has a text."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if start in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = []
    for line in lines[at + 1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    return "\n".join(below)


def test_line_items_are_not_joined_to_customers(spark, sf):
    from meterlake.plans.views import tasks_tpch

    plan = tasks_tpch(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = subtree(plan, "Join Inner, (o_custkey")
    assert "c_custkey" in below and "l_shipdate" not in below


def test_summary_report_reads_its_rows_once(spark, tmp_path):
    from meterlake.sources import files
    from meterlake.sources.sinks import write_summary_report

    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    rows = [("a", None, "g", "t", f"r{i}" if i else None, float(i), float("nan"), None, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "org string, environment string, agent_name string, log_type string, task_run_id string, ipus double, cost double, metered_value double, cores_used double")
    df = df.withColumn("ipus", F.udf(counted, "double")("ipus"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = files.names(spark, shared)
    write_summary_report(df, str(tmp_path / "report"))
    assert read.value == 5 and [n for n in files.names(spark, shared) if n not in before and n.startswith("summary-rows")] == []
    got = {n: spark.read.option("header", True).csv(str(tmp_path / "report" / n)).collect() for n in ("overall", "by_org", "by_env")}
    assert [(r.org, r.task_count, r.total_ipus) for r in got["by_org"]] == [("a", "4", "10.0")] and got["by_env"] == []
    assert [(r.metric, r.value_count) for r in got["overall"] if r.metric == "ipus"] == [("ipus", "5")]


def test_snapshot_counts_ids_apart_from_sums(spark, monkeypatch):
    from meterlake.operators import runs as R

    rows = [("1", "a", "t0", "f", o, "e", None, "k", s, None, t, x, 1.0, None, 2.0) for o, s, t, x in (
        ("North", "ok", "1", "r1"), ("North", "ok", None, "r1"), (None, None, None, None), ("South", "ok", "1", "r2"), ("South", None, "2", "r2"))]
    rows.append(("1", "a", "t0", "g", "South", None, "p", "k", "ok", None, "2", "r9", None, None, 3.0))  # the run has a second header
    schema = ("run_id string, run_name string, run_timestamp string, source_files string, org string, environment string, project_name string, task_type string, "
              "status string, end_date date, task_id string, task_run_id string, ipus double, cost double, metered_value double")
    df = spark.createDataFrame(rows, schema).withColumn("log_type", F.lit("Task Usage"))
    written = {}

    def keep(frame, purpose, path=None):
        written[purpose] = frame._jdf.queryExecution().executedPlan().toString()
        return kept(frame, purpose, path)

    from meterlake.operators.cells import kept
    monkeypatch.setattr(R, "kept", keep)
    tables = R.run_snapshot(df)
    counting = [line for line in written["run-sums"].splitlines() if "count(distinct" in line]
    assert counting and not any("sum(" in line for line in counting)
    for name, want in {"runs": R.run_headers(df), **R.run_summaries(df)}.items():
        columns = want.columns
        assert sorted(map(str, values(tables[name], *columns))) == sorted(map(str, values(want, *columns))), name
