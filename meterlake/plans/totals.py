"""Check queries: scans, filters and grouped totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterlake.operators import filters as FL
from meterlake.operators import lookup as L
from meterlake.operators import stats as S
from meterlake.operators.filters import TaskFilter
from meterlake.operators.ingest import price
from meterlake.plans.registry import (
    EC, EI, ENV, FACTOR, LOG, ORG, PROJECT, STATS, TASK_NAME, UNIQUE, base, days, register, shown, total,
)
from meterlake.plans.views import tasks_events, tasks_tpch
from meterlake.sources.files import work_dir
from meterlake.sources.sinks import write_summary_report

FULL = ("1995-01-01", "2001-12-31")
ALL = TaskFilter(*FULL)
JAN = ("2024-01-01", "2024-01-31")
IN_FULL = days(*FULL)


def grouped_sql(keys: str, extra: str = "", where: str = IN_FULL, view: str = "tpch", measures: str = STATS) -> str:
    return f"{base(view)} SELECT {keys}, {measures}{', ' + extra if extra else ''} FROM tasks WHERE {where} GROUP BY ALL"


# --- totals by dimension ---

@register("daily_stats", grouped_sql("end_date AS date"))
def daily_stats(spark, d):
    return S.daily_stats(tasks_tpch(spark, d), ALL)


@register("daily_stats_filtered", grouped_sql(
    "end_date AS date",
    where=f"{days('1997-01-01', '1998-12-31')} AND org = 'ASIA' AND project_name = 'BUILDING' AND {LOG} = 'Task Usage'",
))
def daily_stats_filtered(spark, d):
    f = TaskFilter("1997-01-01", "1998-12-31", org="ASIA", project="BUILDING", log_type="Task Usage")
    return S.daily_stats(tasks_tpch(spark, d), f)


@register("org_stats", grouped_sql(f"{ORG} AS org", UNIQUE))
def org_stats(spark, d):
    return S.org_stats(tasks_tpch(spark, d), ALL)


@register("org_daily", grouped_sql(f"end_date AS date, {ORG} AS org"))
def org_daily(spark, d):
    return S.org_daily_stats(tasks_tpch(spark, d), ALL)


@register("project_stats", grouped_sql("project_name", UNIQUE))
def project_stats(spark, d):
    return S.project_stats(tasks_tpch(spark, d), ALL)


@register("task_top", grouped_sql(f"{ORG} AS org, {PROJECT} AS project_name, {TASK_NAME} AS task_name")
          + " ORDER BY total_ipus DESC, org, project_name, task_name LIMIT 25")
def task_top(spark, d):
    return S.top_tasks(tasks_tpch(spark, d), ALL)


@register("task_all", grouped_sql(f"{ORG} AS org, {PROJECT} AS project_name, {TASK_NAME} AS task_name"))
def task_all(spark, d):
    return S.top_tasks(tasks_tpch(spark, d), ALL, limit=None)


@register("env_stats", f"""{base('tpch')}, per_name AS (
  SELECT environment, COUNT(*) AS n, {total(EI)} AS i, {total(EC)} AS c, COUNT(DISTINCT task_id) AS u
  FROM tasks WHERE {IN_FULL} GROUP BY environment)
SELECT {ENV} AS environment, CAST(SUM(n) AS BIGINT) AS task_count, {shown('SUM(i)')} AS total_ipus,
  {shown('SUM(c)')} AS total_cost, CAST(SUM(u) AS BIGINT) AS unique_tasks FROM per_name GROUP BY 1""")
def env_stats(spark, d):
    return S.environment_stats(tasks_tpch(spark, d), ALL)


@register("env_stats_exact_unique", grouped_sql(f"{ENV} AS environment", UNIQUE))
def env_stats_exact_unique(spark, d):
    return S.environment_stats(tasks_tpch(spark, d), ALL, exact_unique=True)


@register("agent_stats", grouped_sql("agent_name", UNIQUE))
def agent_stats(spark, d):
    return S.agent_stats(tasks_tpch(spark, d), ALL)


@register("log_type_stats", grouped_sql(f"{LOG} AS log_type", UNIQUE))
def log_type_stats(spark, d):
    return S.log_type_stats(tasks_tpch(spark, d), *FULL)


@register("log_type_daily", grouped_sql(f"end_date AS date, {LOG} AS log_type"))
def log_type_daily(spark, d):
    return S.log_type_daily_stats(tasks_tpch(spark, d), ALL)


@register("task_type_stats", grouped_sql("task_type", UNIQUE))
def task_type_stats(spark, d):
    return S.task_type_stats(tasks_tpch(spark, d), ALL)


@register("status_stats", grouped_sql("status"))
def status_stats(spark, d):
    return S.status_stats(tasks_tpch(spark, d), ALL)


@register("filtered_daily", grouped_sql(
    "end_date AS date",
    where=f"{IN_FULL} AND org IN ('ASIA', 'EUROPE', 'ASIA Mass Ingestion') "
          "AND TRIM(COALESCE(project_name, '')) IN ('-', '(No project)', '')",
))
def filtered_daily(spark, d):
    orgs = ["ASIA", "EUROPE", "ASIA Mass Ingestion"]
    return S.filtered_daily_stats(tasks_tpch(spark, d), *FULL, orgs=orgs, project="(No project)")


@register("filtered_daily_task", grouped_sql(
    "end_date AS date",
    where=f"{IN_FULL} AND org = 'EUROPE' AND project_name = 'BUILDING' AND task_name = 'red widget' AND {LOG} = 'Task Usage'",
))
def filtered_daily_task(spark, d):
    return S.filtered_daily_stats(
        tasks_tpch(spark, d), *FULL, org="EUROPE", orgs=["ASIA"], project="BUILDING", task_name="red widget", log_type="Task Usage"
    )


@register("date_range", f"""{base('tpch')} SELECT MIN(end_time) AS first_end, MAX(end_time) AS last_end
FROM tasks WHERE end_time <= TIMESTAMP '2000-06-29 12:00:00'""")
def date_range(spark, d):
    return S.history_range(tasks_tpch(spark, d), dt.datetime(2000, 6, 30, 12))


# --- scans and filters ---

ROW = "task_run_id, task_id, task_name, org, project_name, environment, status, log_type, end_time, metered_value"


def row_columns(df):
    return df.select(*ROW.split(", "))


@register("tasks_in_range", f"""{base('tpch')} SELECT {ROW} FROM tasks WHERE {days('1996-01-01', '1999-06-30')}
AND status = 'F' AND task_type = 'ECONOMY' AND environment = 'NATION_7 - Cloud' AND log_type = 'Mass Ingestion'""")
def tasks_in_range(spark, d):
    f = TaskFilter("1996-01-01", "1999-06-30", status="F", task_type="ECONOMY", environment="NATION_7 - Cloud",
                   log_type="Mass Ingestion")
    return row_columns(FL.tasks_in_range(tasks_tpch(spark, d), f))


@register("tasks_of_task_usage", f"""{base('tpch')} SELECT {ROW} FROM tasks WHERE {IN_FULL}
AND (log_type = 'Task Usage' OR log_type IS NULL OR TRIM(log_type) = '')""")
def tasks_of_task_usage(spark, d):
    return row_columns(FL.tasks_in_range(tasks_tpch(spark, d), TaskFilter(*FULL, log_type="Task Usage")))


@register("tasks_of_agent", f"""{base('tpch')} SELECT {ROW} FROM tasks WHERE {IN_FULL} AND agent_name = 'Supplier#000000007'""")
def tasks_of_agent(spark, d):
    return row_columns(FL.tasks_in_range(tasks_tpch(spark, d), TaskFilter(*FULL, agent="Supplier#000000007")))


@register("count_in_range", f"""{base('tpch')} SELECT COUNT(*) AS task_count FROM tasks
WHERE {days('1996-02-01', '1996-05-31')} AND org = 'EUROPE Mass Ingestion'""")
def count_in_range(spark, d):
    return FL.count_in_range(tasks_tpch(spark, d), TaskFilter("1996-02-01", "1996-05-31", org="EUROPE Mass Ingestion"))


@register("choose_values", f"""{base('tpch')} SELECT {ROW} FROM tasks
WHERE (project_name IN ('BUILDING', '-') OR project_name IS NULL) AND log_type IN ('Task Usage') AND task_name = 'blue bolt'""")
def choose_values(spark, d):
    picks = {"project_name": ["BUILDING", "-", "(Missing)"], "log_type": ["Task Usage"], "org": []}
    return row_columns(FL.choose(tasks_tpch(spark, d), picks, task_name="blue bolt"))


@register("choice_options", f"""{base('tpch')} SELECT DISTINCT COALESCE(project_name, '(Missing)') AS option,
project_name IS NULL AS is_missing FROM tasks""")
def choice_options(spark, d):
    return FL.choice_options(tasks_tpch(spark, d), "project_name")


@register("hours_between", f"""{base('events')} SELECT {ROW} FROM tasks
WHERE {days('2024-01-05', '2024-01-20')} AND hour(end_time) BETWEEN 9 AND 17""")
def hours_between(spark, d):
    return row_columns(FL.hours_between(tasks_events(spark, d), "2024-01-05", "2024-01-20", 9, 17))


@register("timestamps_between", f"""{base('events')} SELECT {ROW} FROM tasks
WHERE end_time BETWEEN TIMESTAMP '2024-01-03 04:05:06' AND TIMESTAMP '2024-01-19 20:21:22'""")
def timestamps_between(spark, d):
    return row_columns(FL.timestamps_between(tasks_events(spark, d), dt.datetime(2024, 1, 3, 4, 5, 6), dt.datetime(2024, 1, 19, 20, 21, 22)))


# --- summaries of a priced batch ---

PRICED = f""", priced AS (SELECT * REPLACE (round_even(COALESCE(metered_value, 0) * {FACTOR}, 8) AS ipus) FROM tasks),
batch AS (SELECT * REPLACE (round_even(ipus * CAST(36.04 AS DOUBLE), 6) AS cost) FROM priced)"""
AMOUNTS = f"{shown(total('ipus'))} AS total_ipus, {shown(total('cost'))} AS total_cost"
RUNS = "COUNT(task_run_id) AS run_count"


def batch_sql(keys: str, measures: str, view: str = "tpch", where: str = "TRUE") -> str:
    return f"{base(view)}{PRICED} SELECT {keys + ', ' if keys else ''}{measures} FROM batch WHERE {where} GROUP BY ALL"


def batch(spark, d, view=tasks_tpch):
    return price(view(spark, d))


def avg(x: str) -> str:
    return f"ROUND(CAST(SUM(CAST({x} AS DECIMAL(28,8))) AS DOUBLE) / COUNT(*), 6)"


SUMMARY = "COUNT(task_run_id) AS task_count, " + ", ".join(
    f"{shown(total(c))} AS total_{n}, {avg(c)} AS avg_{n}" for c, n in (("ipus", "ipus"), ("cost", "cost"), ("cores_used", "cores"))
)


@register("reprice", f"{base('tpch')}{PRICED} SELECT task_run_id, metered_value, ipus, cost FROM batch")
def reprice(spark, d):
    return batch(spark, d).select("task_run_id", "metered_value", "ipus", "cost")


@register("summary_by_org", batch_sql("org", SUMMARY, where="org IS NOT NULL"))
def summary_by_org(spark, d):
    return S.summary_by(batch(spark, d), "org")


@register("summary_by_project", batch_sql("project_name", SUMMARY, where="project_name IS NOT NULL"))
def summary_by_project(spark, d):
    return S.summary_by(batch(spark, d), "project_name")


@register("summary_by_log_type", batch_sql("log_type", SUMMARY, where="log_type IS NOT NULL"))
def summary_by_log_type(spark, d):
    return S.summary_by(batch(spark, d), "log_type")


@register("summary_by_environment", batch_sql("environment", SUMMARY))
def summary_by_environment(spark, d):
    return S.summary_by(batch(spark, d), "environment")


@register("summary_report", batch_sql("agent_name", SUMMARY, where="agent_name IS NOT NULL"))
def summary_report(spark, d):
    """The set of summaries written out; the one by agent read back."""
    path = work_dir(spark, "summaries")
    write_summary_report(batch(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/by_agent")
    return back.select("agent_name", F.col("task_count").cast("long").alias("task_count"), *[F.col(c).cast("double").alias(c) for c in back.columns[2:]])


@register("pivot_summary", batch_sql("org, task_type", AMOUNTS))
def pivot_summary(spark, d):
    return S.pivot_summary(batch(spark, d), "org", "task_type")


@register("project_folder", batch_sql("project_name, folder_name", f"{RUNS}, {AMOUNTS}, {UNIQUE}", where="project_name IS NOT NULL"))
def project_folder(spark, d):
    return S.project_folder_summary(batch(spark, d))


@register("status_counts", f"{base('events')} SELECT status, COUNT(*) AS row_count FROM tasks GROUP BY status")
def status_counts(spark, d):
    return S.status_counts(tasks_events(spark, d))


@register("log_type_counts", f"{base('tpch')} SELECT log_type, COUNT(*) AS row_count FROM tasks WHERE log_type IS NOT NULL GROUP BY 1")
def log_type_counts(spark, d):
    return S.log_type_counts(tasks_tpch(spark, d))


@register("headline", batch_sql("", f"COUNT(*) AS row_count, {AMOUNTS}, COUNT(DISTINCT task_run_id) AS unique_runs"))
def headline(spark, d):
    return S.headline(batch(spark, d))


@register("status_slice", batch_sql("", f"COUNT(*) AS row_count, {AMOUNTS}, {UNIQUE}", where="status = 'F'"))
def status_slice(spark, d):
    return S.status_headline(batch(spark, d), "F")


@register("status_top_tasks", batch_sql(
    "task_id, task_name, project_name, folder_name", f"{RUNS}, {AMOUNTS}", where="status = 'F' AND project_name IS NOT NULL"
) + " ORDER BY total_ipus DESC, task_id, task_name, project_name, folder_name LIMIT 20")
def status_top_tasks(spark, d):
    return S.status_top_tasks(batch(spark, d), "F", 20)


@register("status_daily", batch_sql("end_date AS date", f"{RUNS}, {AMOUNTS}", "events", "status = 'Failed'"))
def status_daily(spark, d):
    return S.batch_daily(FL.choose(batch(spark, d, tasks_events), {"status": ["Failed"]}))


@register("status_hourly", batch_sql("hour(end_time) AS hour_of_day", f"{RUNS}, {AMOUNTS}", "events", "status = 'Failed'"))
def status_hourly(spark, d):
    return S.batch_hourly(FL.choose(batch(spark, d, tasks_events), {"status": ["Failed"]}))


@register("status_by_org", batch_sql("org", f"{RUNS}, {AMOUNTS}", "events", "status = 'Failed'"))
def status_by_org(spark, d):
    return S.batch_by_org(FL.choose(batch(spark, d, tasks_events), {"status": ["Failed"]}))


@register("batch_daily", batch_sql("end_date AS date", f"{RUNS}, {AMOUNTS}"))
def batch_daily(spark, d):
    return S.batch_daily(batch(spark, d))


@register("batch_daily_org", batch_sql("end_date AS date, org", f"{RUNS}, {AMOUNTS}"))
def batch_daily_org(spark, d):
    return S.batch_daily(batch(spark, d), "org")


@register("batch_daily_log_type", batch_sql("end_date AS date, log_type", f"{RUNS}, {AMOUNTS}", where="log_type IS NOT NULL"))
def batch_daily_log_type(spark, d):
    return S.batch_daily(batch(spark, d), "log_type")


@register("hourly", batch_sql("hour(end_time) AS hour_of_day", f"{RUNS}, {AMOUNTS}", "events"))
def hourly(spark, d):
    return S.batch_hourly(batch(spark, d, tasks_events))


@register("hour_org", batch_sql("hour(end_time) AS hour_of_day, org", f"{RUNS}, {AMOUNTS}", "events"))
def hour_org(spark, d):
    return S.batch_hourly(batch(spark, d, tasks_events), "org")


@register("duration_stats", f"""{base('tpch')}, m AS (
  SELECT abs(COALESCE(date_diff('microsecond', start_time, end_time) / 60000000.0, 0)) AS x FROM tasks)
SELECT COUNT(*) AS task_count, ROUND(CAST(SUM({'CAST(x AS DECIMAL(28,8))'}) AS DOUBLE) / COUNT(*), 6) AS mean_minutes,
  ROUND(MAX(x), 6) AS max_minutes, ROUND(MIN(x), 6) AS min_minutes, ROUND(median(x), 6) AS median_minutes,
  {shown(total('x'))} AS total_minutes FROM m""")
def duration_stats(spark, d):
    return S.duration_stats(tasks_tpch(spark, d))


def describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS metric, COUNT({column}) AS value_count, round_even(AVG({column}), 2) AS mean_value,
  round_even(stddev_samp({column}), 2) AS std_value, round_even(MIN({column}), 2) AS min_value,
  round_even(quantile_cont({column}, 0.25), 2) AS q25, round_even(quantile_cont({column}, 0.5), 2) AS q50,
  round_even(quantile_cont({column}, 0.75), 2) AS q75, round_even(MAX({column}), 2) AS max_value FROM batch"""


@register("describe_numeric", f"{base('events')}{PRICED} " + " UNION ALL ".join(describe_sql(c) for c in S.NUMERIC))
def describe_numeric(spark, d):
    return S.describe_numeric(batch(spark, d, tasks_events))


REGIONS = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BOTH = [r + s for r in REGIONS for s in ("", " Mass Ingestion")] + ["Unknown"]


def wide_sql(index: str, key: str, names: list[str], inner: str, value: str) -> str:
    columns = ", ".join(f"SUM(CASE WHEN {key} = '{n}' THEN {value} END) AS \"{n}\"" for n in names)
    return f"{inner} SELECT {index}, {columns} FROM x GROUP BY {index}"


@register("pivot_org_daily", wide_sql(
    "date", "org", BOTH, f"{base('tpch')}, x AS (SELECT end_date AS date, {ORG} AS org, {shown(total(EI))} AS v FROM tasks GROUP BY 1, 2)", "v"))
def pivot_org_daily(spark, d):
    return S.wide(S.org_daily_stats(tasks_tpch(spark, d), ALL), "date", "org", "total_ipus", BOTH)


@register("pivot_log_type_daily", wide_sql(
    "date", "log_type", ["Task Usage", "Mass Ingestion"],
    f"{base('tpch')}, x AS (SELECT end_date AS date, {LOG} AS log_type, COUNT(*) AS v FROM tasks GROUP BY 1, 2)", "v"))
def pivot_log_type_daily(spark, d):
    rows = S.log_type_daily_stats(tasks_tpch(spark, d), ALL)
    return S.wide(rows, "date", "log_type", "task_count", ["Task Usage", "Mass Ingestion"])


EVENT_ORGS = [f"org_{i}" for i in range(5)]


@register("pivot_hour_org", wide_sql(
    "hour_of_day", "org", EVENT_ORGS,
    f"{base('events')}, x AS (SELECT hour(end_time) AS hour_of_day, org, COUNT(*) AS v FROM tasks GROUP BY 1, 2)", "v"))
def pivot_hour_org(spark, d):
    return S.wide(S.batch_hourly(batch(spark, d, tasks_events), "org"), "hour_of_day", "org", "run_count", EVENT_ORGS)


# --- lookup ---

LOOKUP = f"""{base('tpch')}, m AS (SELECT task_run_id,
  COALESCE(NULLIF(TRIM(task_object_name), ''), NULLIF(TRIM(task_name), ''), '(Unnamed)') AS matched_task,
  COALESCE(NULLIF(TRIM(task_object_name), ''), '') AS task_object_name, COALESCE(NULLIF(TRIM(task_name), ''), '') AS task_name,
  COALESCE(NULLIF(TRIM(folder_name), ''), '(No folder)') AS folder_name,
  COALESCE(NULLIF(TRIM(project_name), ''), '(No project)') AS project_name, {ORG} AS org, {LOG} AS log_type, end_time,
  {EI} AS effective_ipus, {EC} AS effective_cost, COALESCE(metered_value, 0) AS metered_value
  FROM tasks WHERE {IN_FULL} AND (LOWER(TRIM(COALESCE(task_object_name, ''))) LIKE '%re%i_g%'
    OR LOWER(TRIM(COALESCE(task_name, ''))) LIKE '%re%i_g%') AND LOWER(TRIM(COALESCE(folder_name, ''))) LIKE '%low%')"""


def lookup(spark, d):
    return L.lookup_rows(tasks_tpch(spark, d), ALL, " RE%i_g ", "Low")


@register("lookup_rows", LOOKUP + """ SELECT * REPLACE (round_even(effective_ipus, 6) AS effective_ipus,
  round_even(effective_cost, 6) AS effective_cost, round_even(metered_value, 6) AS metered_value) FROM m""")
def lookup_rows(spark, d):
    return L.lookup_details(lookup(spark, d))


@register("lookup_exact", f"""{base('tpch')} SELECT task_run_id, end_time FROM tasks WHERE {IN_FULL} AND org = 'EUROPE'
AND {LOG} = 'Task Usage' AND (LOWER(TRIM(COALESCE(task_object_name, ''))) = 'red widget' OR LOWER(TRIM(COALESCE(task_name, ''))) = 'red widget')
AND LOWER(TRIM(COALESCE(folder_name, ''))) = '5-low'""")
def lookup_exact(spark, d):
    f = TaskFilter(*FULL, org="EUROPE", log_type="Task Usage")
    return L.lookup_rows(tasks_tpch(spark, d), f, "Red Widget", "5-low", mode="exact").select("task_run_id", "end_time")


LOOKUP_SUMS = f"COUNT(task_run_id) AS task_runs, {shown(total('effective_ipus'))} AS total_ipus"
LOOKUP_COST = f"{shown(total('effective_cost'))} AS total_cost"


@register("lookup_terms", LOOKUP + f""" SELECT matched_task, {LOOKUP_SUMS},
  COALESCE(string_agg(DISTINCT NULLIF(task_object_name, ''), ', ' ORDER BY NULLIF(task_object_name, '')), '') AS object_names,
  COALESCE(string_agg(DISTINCT NULLIF(task_name, ''), ', ' ORDER BY NULLIF(task_name, '')), '') AS task_names FROM m GROUP BY 1""")
def lookup_terms(spark, d):
    terms = L.lookup_terms(lookup(spark, d))
    return terms.withColumns({c: F.array_join(c, ", ") for c in ("object_names", "task_names")})


@register("lookup_totals", LOOKUP + f""" SELECT COUNT(*) AS run_count, {shown(total('effective_ipus'))} AS total_ipus, {LOOKUP_COST},
  ROUND(AVG(CASE WHEN TRIM(task_object_name) <> '' THEN 1.0 ELSE 0.0 END) * 100, 6) AS object_coverage_pct FROM m""")
def lookup_totals(spark, d):
    return L.lookup_totals(lookup(spark, d))


@register("lookup_by_term", LOOKUP + f""" SELECT matched_task, {LOOKUP_SUMS}, {LOOKUP_COST} FROM m
WHERE matched_task IN ('obj_red ring', 'green ring', 'red ring') GROUP BY 1""")
def lookup_by_term(spark, d):
    return L.lookup_by_term(L.pick_terms(lookup(spark, d), ["obj_red ring", "green ring", "red ring"]))


@register("lookup_daily", LOOKUP + f" SELECT CAST(end_time AS DATE) AS date, {LOOKUP_SUMS}, {LOOKUP_COST} FROM m GROUP BY 1")
def lookup_daily(spark, d):
    return L.lookup_daily(lookup(spark, d))


@register("lookup_by_org", LOOKUP + f" SELECT org, {LOOKUP_SUMS} FROM m GROUP BY 1")
def lookup_by_org(spark, d):
    return L.lookup_by(lookup(spark, d), "org")


@register("lookup_by_project", LOOKUP + f" SELECT project_name, {LOOKUP_SUMS} FROM m GROUP BY 1")
def lookup_by_project(spark, d):
    return L.lookup_by(lookup(spark, d), "project_name")
