"""Check queries: date ranges, coverage, running totals, unusual days and spikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.labels import display_date, env_base
from meterlake.operators import anomalies as A
from meterlake.operators import series as D
from meterlake.operators.filters import TaskFilter
from meterlake.plans.registry import EC, EI, ENV, LOG, ORG, base, days, register, shown, total
from meterlake.plans.totals import FULL
from meterlake.plans.views import tasks_events, tasks_tpch

RANGE_TEXT = "CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, ' to ', b) END"
SHOWN_RANGE = "CASE WHEN a = b THEN strftime(a, '%B %-d, %Y') ELSE concat(strftime(a, '%B %-d, %Y'), ' to ', strftime(b, '%B %-d, %Y')) END"


def islands_sql(source: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""runs AS (SELECT {group}d, d - CAST(ROW_NUMBER() OVER ({part} ORDER BY d) AS INTEGER) AS run FROM {source}),
isl AS (SELECT {group}MIN(d) AS a, MAX(d) AS b FROM runs GROUP BY {group}run)"""


@register("date_islands", f"""{base('tpch')}, seen AS (SELECT DISTINCT agent_name, end_date AS d FROM tasks),
{islands_sql('seen', 'agent_name')} SELECT agent_name, a AS range_start, b AS range_end FROM isl""")
def date_islands(spark, d):
    return D.islands(tasks_tpch(spark, d).select("agent_name", F.col("end_date").alias("date")).distinct(), ["agent_name"])


@register("date_summary", f"""{base('tpch')}, seen AS (SELECT DISTINCT end_date AS d FROM tasks),
{islands_sql('seen')} SELECT MIN(a) AS start_date, MAX(b) AS end_date, string_agg({RANGE_TEXT}, '; ' ORDER BY a) AS label FROM isl""")
def date_summary(spark, d):
    return D.date_summary(tasks_tpch(spark, d))


@register("missing_ranges", f"""{base('tpch')}, seen AS (SELECT DISTINCT end_date AS d FROM tasks WHERE {days(*FULL)}
  AND org = 'EUROPE' AND environment = 'NATION_3 - Cloud' AND {LOG} = 'Task Usage'),
gone AS (SELECT CAST(g AS DATE) AS d FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(g)
  WHERE CAST(g AS DATE) NOT IN (SELECT d FROM seen)), {islands_sql('gone')}
SELECT a AS range_start, b AS range_end, {SHOWN_RANGE} AS label FROM isl""")
def missing_ranges(spark, d):
    f = TaskFilter(*FULL, org="EUROPE", environment="NATION_3 - Cloud", log_type="Task Usage")
    return D.missing_ranges(tasks_tpch(spark, d), f)


def coverage_sql(where: str) -> str:
    return f"""{base('tpch')}, seen AS (SELECT DISTINCT {ORG} AS org, {LOG} AS log_type, end_date AS d FROM tasks WHERE {where}),
steps AS (SELECT *, LEAD(d) OVER (PARTITION BY org, log_type ORDER BY d) AS nx FROM seen),
holes AS (SELECT org, log_type, d, nx - d - 1 AS n, d + 1 AS a, nx - 1 AS b FROM steps)
SELECT org, log_type, strftime(MIN(d), '%B %-d, %Y') AS first_date, strftime(MAX(d), '%B %-d, %Y') AS last_date,
  COUNT(*) AS days_present, CAST(COALESCE(SUM(n) FILTER (n > 0), 0) AS BIGINT) AS days_missing, COUNT(*) FILTER (n > 0) AS gap_count,
  COALESCE(string_agg({SHOWN_RANGE}, '; ' ORDER BY d) FILTER (n > 0), '') AS missing_ranges FROM holes GROUP BY org, log_type"""


@register("coverage_gaps", coverage_sql(days("1999-01-01", "1999-12-31")))
def coverage_gaps(spark, d):
    return D.coverage_gaps(tasks_tpch(spark, d), "1999-01-01", "1999-12-31")


@register("coverage_gaps_bulk", coverage_sql(f"{days(*FULL)} AND log_type = 'Mass Ingestion'"))
def coverage_gaps_bulk(spark, d):
    return D.coverage_gaps(tasks_tpch(spark, d), *FULL, log_type="Mass Ingestion")


@register("cumulative_org", f"""{base('tpch')}, daily AS (SELECT end_date AS d, org, {total("metered_value")} AS x FROM tasks
  WHERE {days(*FULL)} GROUP BY 1, 2),
grid AS (SELECT g.d, o.org, COALESCE(x, 0) AS x FROM (SELECT DISTINCT d FROM daily) g CROSS JOIN (SELECT DISTINCT org FROM daily) o
  LEFT JOIN daily USING (d, org))
SELECT d AS date, org, {shown('SUM(x) OVER (PARTITION BY org ORDER BY d)')} AS cumulative_ipus FROM grid""")
def cumulative_org(spark, d):
    return D.cumulative_by_org(tasks_tpch(spark, d).withColumn("ipus", F.col("metered_value")), *FULL)


@register("weekly_trend", f"""{base('events')}, w AS (SELECT org, CAST(date_trunc('week', end_date) AS DATE) AS week_start, {total(EI)} AS x
  FROM tasks WHERE {days('2023-12-18', '2024-01-24')} GROUP BY 1, 2),
weeks AS (SELECT DATE '2023-12-18' + 7 * CAST(i AS INTEGER) AS week_start FROM range(6) t(i))
SELECT o.org, weeks.week_start, {shown('COALESCE(x, 0)')} AS total_ipus FROM (SELECT DISTINCT org FROM w) o CROSS JOIN weeks
LEFT JOIN w USING (org, week_start)""")
def weekly_trend(spark, d):
    return D.weekly_trend(tasks_events(spark, d), "2024-01-24")


@register("weekly_trend_bulk", f"""{base('events')}, w AS (SELECT org, CAST(date_trunc('week', end_date) AS DATE) AS week_start, {total(EI)} AS x
  FROM tasks WHERE {days('2024-01-01', '2024-01-24')} AND log_type = 'Mass Ingestion' GROUP BY 1, 2),
weeks AS (SELECT DATE '2024-01-01' + 7 * CAST(i AS INTEGER) AS week_start FROM range(4) t(i))
SELECT o.org, weeks.week_start, {shown('COALESCE(x, 0)')} AS total_ipus FROM (SELECT org FROM w UNION SELECT org FROM tasks) o CROSS JOIN weeks
LEFT JOIN w USING (org, week_start)""")
def weekly_trend_bulk(spark, d):
    """Bulk rows of four weeks; organizations without any are listed with zeros."""
    tasks = tasks_events(spark, d)
    return D.weekly_trend(tasks, "2024-01-24", 4, log_type="Mass Ingestion", orgs=tasks.select("org"))


# --- unusual days ---

def anomaly_sql(view: str, start: str, end: str, metric: str, t: float, where: str = "TRUE") -> str:
    return f"""{base(view)}, daily AS (SELECT end_date AS date, COUNT(*) AS task_count, {shown(total(EI))} AS total_ipus,
  {shown(total(EC))} AS total_cost FROM tasks WHERE {days(start, end)} AND {where} GROUP BY 1),
s AS (SELECT AVG({metric}) AS m, stddev_samp({metric}) AS sd, COUNT(*) AS n FROM daily),
z AS (SELECT daily.*, ROUND(({metric} - m) / sd, 6) AS z_score FROM daily, s WHERE n >= 3 AND sd > 0)
SELECT *, CASE WHEN z_score > {t} THEN 'High' ELSE 'Low' END AS anomaly_type FROM z WHERE abs(z_score) > {t}"""


@register("anomalies", anomaly_sql("tpch", "1999-01-01", "1999-12-31", "total_ipus", 2.0))
def anomalies(spark, d):
    return A.daily_anomalies(tasks_tpch(spark, d), "1999-01-01", "1999-12-31")


@register("anomalies_by_count", anomaly_sql(
    "tpch", *FULL, "task_count", 2.5, f"org = 'ASIA' AND {LOG} = 'Task Usage'"))
def anomalies_by_count(spark, d):
    return A.daily_anomalies(tasks_tpch(spark, d), *FULL, metric="task_count", threshold=2.5, org="ASIA", log_type="Task Usage")


def spikes_sql(view: str, first: str, last: str, base_first: str, base_last: str, t: float, n: int | None = None, where: str = "TRUE") -> str:
    keys = "end_date AS task_date, task_name, task_id, org, project_name"
    limit = f"ORDER BY z_score DESC, daily_ipus DESC, task_date, task_name, task_id, org, project_name LIMIT {n}" if n else ""
    return f"""{base(view)}, g AS (SELECT {keys}, COUNT(*) AS run_count, {shown(total(EI), 8)} AS x, {shown(total(EC), 8)} AS c FROM tasks
  WHERE {days(base_first, last)} AND TRIM(task_name) <> '' AND {where} GROUP BY ALL),
b AS (SELECT task_name, COUNT(x) AS baseline_days, AVG(x) AS m, COALESCE(stddev_samp(x), 0) AS sd FROM g
  WHERE {days(base_first, base_last, 'task_date')} GROUP BY 1 HAVING COUNT(x) >= 5)
SELECT task_date, g.task_name, task_id, org, project_name, run_count, ROUND(x, 6) AS daily_ipus, ROUND(c, 6) AS daily_cost, baseline_days,
  ROUND(m, 6) AS baseline_mean_ipus, ROUND(sd, 6) AS baseline_std_ipus, ROUND(m + {t} * sd, 6) AS baseline_threshold,
  ROUND(CASE WHEN sd > 0 THEN (x - m) / sd WHEN x > m THEN 99.0 ELSE 0.0 END, 6) AS z_score,
  ROUND(COALESCE(x / NULLIF(m, 0), 0), 6) AS multiplier_vs_baseline
FROM g JOIN b ON g.task_name = b.task_name WHERE {days(first, last, 'task_date')} AND x > m + {t} * sd AND x > m * 1.5 {limit}"""


@register("task_spikes", spikes_sql("events", "2024-01-16", "2024-01-30", "2024-01-01", "2024-01-15", 3.0))
def task_spikes(spark, d):
    return A.task_spikes(tasks_events(spark, d), "2024-01-30", 15, 15, 3.0, 5, top_n=None)


@register("task_spikes_top", spikes_sql("events", "2024-01-16", "2024-01-30", "2024-01-01", "2024-01-15", 3.0, 10))
def task_spikes_top(spark, d):
    return A.task_spikes(tasks_events(spark, d), "2024-01-30", 15, 15)


@register("task_spikes_long", spikes_sql("tpch", "1999-10-03", "1999-12-31", "1999-07-05", "1999-10-02", 1.5, None, f"{LOG} = 'Task Usage'"))
def task_spikes_long(spark, d):
    return A.task_spikes(tasks_tpch(spark, d), "1999-12-31", 90, 90, 1.5, top_n=None, log_type="Task Usage")


SPIKE_KEYS = "SELECT DISTINCT org, project_name, task_name FROM spikes"


@register("task_history", f"""{spikes_sql('events', '2024-01-16', '2024-01-30', '2024-01-01', '2024-01-15', 3.0, 10).replace(
    'SELECT task_date,', ', spikes AS (SELECT task_date,', 1)}), k AS ({SPIKE_KEYS})
SELECT end_date AS date, tasks.org, tasks.project_name, tasks.task_name, {shown(total(EI))} AS total_ipus, COUNT(*) AS runs
FROM tasks JOIN k USING (org, project_name, task_name) WHERE {days('2024-01-16', '2024-01-30')} GROUP BY ALL""")
def task_history(spark, d):
    tasks = tasks_events(spark, d)
    return A.task_history(tasks, A.task_spikes(tasks, "2024-01-30", 15, 15).drop("task_id"), "2024-01-16", "2024-01-30")


def drivers_sql(view: str, start: str, end: str, t: float) -> str:
    return f"""{anomaly_sql(view, start, end, 'total_ipus', t).replace(
    'SELECT *, CASE', ', a AS (SELECT *, CASE', 1)}),
c AS (SELECT end_date AS date, COALESCE(project_name, '(Unknown)') AS p, COALESCE(task_name, '(Unknown)') AS t, {total(EI)} AS x
  FROM tasks WHERE end_date IN (SELECT date FROM a) GROUP BY 1, 2, 3),
n AS (SELECT date, 'project' AS kind, p AS name, SUM(x) AS x FROM c GROUP BY ALL UNION ALL
  SELECT date, 'task', t, SUM(x) FROM c GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, kind ORDER BY x DESC, name) AS place, SUM(x) OVER (PARTITION BY date, kind) AS whole FROM n),
p AS (SELECT * FROM r WHERE place = 1 AND kind = 'project'), t AS (SELECT * FROM r WHERE place = 1 AND kind = 'task'),
b AS (SELECT p.date, p.whole, GREATEST(p.x, t.x) AS x, CASE WHEN p.x >= t.x THEN 'project' ELSE 'task' END AS kind,
  CASE WHEN p.x >= t.x THEN p.name ELSE t.name END AS name FROM p JOIN t USING (date))
SELECT date, {shown('whole')} AS day_ipus, CASE WHEN ok THEN kind END AS driver_kind, CASE WHEN ok THEN name END AS driver_name,
  CASE WHEN ok THEN {shown('x')} END AS driver_ipus
FROM (SELECT *, whole > 0 AND CAST(x AS DOUBLE) / CAST(whole AS DOUBLE) >= 0.35 AS ok FROM b)"""


@register("anomaly_drivers", drivers_sql("tpch", "1999-01-01", "1999-12-31", 1.0))
def anomaly_drivers(spark, d):
    tasks = tasks_tpch(spark, d)
    unusual = A.daily_anomalies(tasks, "1999-01-01", "1999-12-31", threshold=1.0)
    return A.anomaly_drivers(tasks, unusual, "1999-01-01", "1999-12-31")


@register("effective_metrics", f"""{base('tpch')} SELECT task_run_id, ROUND({EI}, 8) AS effective_ipus, ROUND({EC}, 8) AS effective_cost,
COALESCE(org, '(Unknown)') AS org, COALESCE(project_name, '(Unknown)') AS project_name, COALESCE(task_name, '(Unknown)') AS task_name FROM tasks""")
def effective_metrics(spark, d):
    from meterlake.functions.pricing import eff_cost, eff_ipus
    from meterlake.operators.compare import named
    from meterlake.schema import Pricing

    p = Pricing()
    return named(tasks_tpch(spark, d)).select(
        "task_run_id", F.round(eff_ipus(p), 8).alias("effective_ipus"), F.round(eff_cost(p), 8).alias("effective_cost"),
        "org", "project_name", "task_name",
    )


@register("run_cost", f"""{base('tpch')}, m AS (SELECT task_run_id, cores_used,
  round_even(COALESCE(date_diff('microsecond', start_time, end_time) / 60000000.0, 0), 2) AS duration_minutes FROM tasks)
SELECT task_run_id, duration_minutes, round_even(COALESCE(cores_used, 0) * duration_minutes * CAST(0.001 AS DOUBLE), 4) AS cores_cost FROM m""")
def run_cost(spark, d):
    from meterlake.functions.pricing import cores_cost, duration_minutes

    rows = tasks_tpch(spark, d).withColumn("duration_minutes", duration_minutes(F.col("start_time"), F.col("end_time")))
    return rows.select("task_run_id", "duration_minutes", cores_cost(F.col("cores_used"), F.col("duration_minutes")).alias("cores_cost"))


@register("display_labels", f"""{base('tpch')} SELECT task_run_id, strftime(end_date, '%B %-d, %Y') AS end_shown, {ENV} AS environment_base,
{ORG} AS org_shown, {LOG} AS log_type_shown FROM tasks""")
def display_labels(spark, d):
    from meterlake.functions.labels import log_type_label, org_label

    return tasks_tpch(spark, d).select(
        "task_run_id", display_date(F.col("end_date")).alias("end_shown"), env_base(F.col("environment")).alias("environment_base"),
        org_label().alias("org_shown"), log_type_label().alias("log_type_shown"),
    )


