"""Check queries: period comparison, changes and run snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import anomalies as A
from meterlake.operators import compare as C
from meterlake.operators import runs as R
from meterlake.plans.registry import EC, EI, ENV, LOG, ORG, STATS, UNIQUE, base, register, shown, total
from meterlake.plans.views import tasks_events, tasks_tpch
from meterlake.sources.files import work_dir

ANCHOR = "2024-01-24"
PERIODS = C.report_periods(ANCHOR)
TPCH_PERIODS = C.report_periods("1999-03-31")
WHOLE_MONTHS = C.report_periods("1999-03-31", whole_months=True)
EXECUTIVE = C.executive_periods("1999-05-31", "1999-05-31")
QUARTER = EXECUTIVE[3]
WEEK = PERIODS[0]

NAMED = "COALESCE(org, '(Unknown)') AS org, COALESCE(project_name, '(Unknown)') AS project_name, COALESCE(task_name, '(Unknown)') AS task_name"
ARROW = "concat(CASE WHEN {0} >= 0 THEN '↑ ' ELSE '↓ ' END, format('{{:,.2f}}', CAST(ROUND(abs({0}), 2) AS DOUBLE)))"


def windows_sql(view: str, periods: list[C.Period]) -> str:
    rows = ", ".join(
        f"({i}, '{p.name}', '{side}', DATE '{a}', DATE '{b}')"
        for i, p in enumerate(periods) for side, a, b in (("cur", p.start, p.end), ("prev", p.prev_start, p.prev_end))
    )
    return f"""{base(view)}, w(period_no, period, side, a, b) AS (VALUES {rows}),
x AS (SELECT tasks.* REPLACE ({NAMED}), org AS raw_org, project_name AS raw_project, w.*, {EI} AS ei, {EC} AS ec
  FROM tasks JOIN w ON end_date BETWEEN a AND b)"""


def side_sum(measure: str, side: str) -> str:
    return f"COALESCE(SUM(CAST({measure} AS DECIMAL(28,8))) FILTER (side = '{side}'), 0)"


SIDES = f"""COUNT(*) FILTER (side = 'cur') AS rc, COUNT(*) FILTER (side = 'prev') AS rp, {side_sum('ei', 'cur')} AS ic, {side_sum('ei', 'prev')} AS ip,
{side_sum('ec', 'cur')} AS cc, {side_sum('ec', 'prev')} AS cp"""
IPUS = f"{shown('ic')} AS ipus_cur, {shown('ip')} AS ipus_prev, {shown('ic - ip')} AS delta_ipus"
RUNS = "rc AS runs_cur, rp AS runs_prev, rc - rp AS delta_runs"
COSTS = f"{shown('cc')} AS cost_cur, {shown('cp')} AS cost_prev, {shown('cc - cp')} AS delta_cost"


@register("period_totals", f"""{windows_sql('tpch', EXECUTIVE)} SELECT w.period, w.side, w.a AS start_date, w.b AS end_date,
COUNT(x.task_run_id) AS task_count, {shown('COALESCE(SUM(CAST(ei AS DECIMAL(28,8))), 0)')} AS total_ipus
FROM w LEFT JOIN x ON x.period_no = w.period_no AND x.side = w.side GROUP BY 1, 2, 3, 4""")
def period_totals(spark, d):
    return C.period_totals(tasks_tpch(spark, d), EXECUTIVE)


@register("period_totals_whole_months", f"""{windows_sql('tpch', WHOLE_MONTHS)} SELECT w.period, w.side, w.a AS start_date, w.b AS end_date,
COUNT(x.task_run_id) AS task_count, {shown('COALESCE(SUM(CAST(ei AS DECIMAL(28,8))), 0)')} AS total_ipus
FROM w LEFT JOIN x ON x.period_no = w.period_no AND x.side = w.side GROUP BY 1, 2, 3, 4""")
def period_totals_whole_months(spark, d):
    return C.period_totals(tasks_tpch(spark, d), WHOLE_MONTHS)


def compare_sql(view: str, periods: list[C.Period], only: str = "TRUE") -> str:
    org, log, env = (c.replace("(org)", "(raw_org)") for c in (ORG, LOG, ENV))
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS dimension, {e} AS value, x.period_no, side, ei FROM x WHERE {kept}"
        for n, e, kept in (("log_type", log, "TRUE"), ("org", org, only), ("environment", env, only))
    )
    return f"""{windows_sql(view, periods)}, l AS ({parts}), v AS (SELECT DISTINCT dimension, value FROM l),
g AS (SELECT v.dimension, v.value, p.period_no, p.period, {side_sum('ei', 'cur')} AS ic, {side_sum('ei', 'prev')} AS ip
  FROM v CROSS JOIN (SELECT DISTINCT period_no, period FROM w) p LEFT JOIN l ON l.dimension = v.dimension AND l.value = v.value
  AND l.period_no = p.period_no GROUP BY ALL)
SELECT dimension, value, period_no, period, {IPUS}, {ARROW.format('ic - ip')} AS change FROM g"""


@register("period_compare", compare_sql("events", PERIODS))
def period_compare(spark, d):
    return C.period_compare(tasks_events(spark, d), PERIODS)


@register("period_compare_sparse", compare_sql("tpch", TPCH_PERIODS))
def period_compare_sparse(spark, d):
    return C.period_compare(tasks_tpch(spark, d), TPCH_PERIODS)


@register("window_changes", f"""{windows_sql('tpch', [QUARTER])}, g AS (SELECT raw_project AS project_name, {SIDES} FROM x GROUP BY 1)
SELECT project_name, {RUNS}, {IPUS}, {COSTS} FROM g""")
def window_changes(spark, d):
    return C.window_changes(tasks_tpch(spark, d), ["project_name"], QUARTER)


MOVED = f"""{windows_sql('tpch', [QUARTER])}, g AS (SELECT {ENV} AS environment, {SIDES} FROM x GROUP BY 1)"""


@register("top_movers", f"""{MOVED}, m AS (SELECT environment, {RUNS}, {IPUS}, {COSTS}, CASE WHEN ic > ip THEN 'up' ELSE 'down' END AS direction FROM g WHERE ic <> ip),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY direction ORDER BY abs(delta_ipus) DESC, environment) AS INTEGER) AS place FROM m)
SELECT * FROM r WHERE place <= 3""")
def top_movers(spark, d):
    from meterlake.functions.labels import env_base

    rows = C.window_changes(tasks_tpch(spark, d), [env_base(F.col("environment")).alias("environment")], QUARTER)
    return C.movers(rows, "environment")


@register("change_trends", f"""{windows_sql('tpch', [TPCH_PERIODS[0]])}, g AS (SELECT task_name, {SIDES} FROM x GROUP BY 1),
s AS (SELECT task_name, {RUNS}, {IPUS}, {COSTS} FROM g),
p AS (SELECT *, (ipus_cur - ipus_prev) / NULLIF(ipus_prev, 0) * 100 AS pct FROM s)
SELECT * EXCLUDE (pct), CASE WHEN ipus_prev = 0 AND ipus_cur = 0 THEN 'n/a' WHEN ipus_prev = 0 THEN 'new' ELSE format('{{:+.1f}}%', pct) END AS pct_change,
  CASE WHEN ipus_prev = 0 AND ipus_cur > 0 THEN 'new activity' WHEN ipus_prev = 0 THEN 'flat' WHEN abs(pct) < 5 THEN 'roughly flat'
    WHEN pct > 0 THEN format('up ({{:+.0f}}%)', pct) ELSE format('down ({{:+.0f}}%)', pct) END AS trend FROM p""")
def change_trends(spark, d):
    return C.with_trend(C.window_changes(tasks_tpch(spark, d), ["task_name"], TPCH_PERIODS[0]))


@register("org_top_changes", f"""{windows_sql('tpch', [QUARTER])},
n AS (SELECT org, 'project' AS kind, project_name AS name, side, ei, ec FROM x UNION ALL SELECT org, 'task', task_name, side, ei, ec FROM x),
g AS (SELECT org, kind, name, {SIDES} FROM n GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY org, kind ORDER BY abs(ic - ip) DESC, CASE WHEN kind = 'task' THEN rc - rp END DESC,
  CASE WHEN kind = 'task' THEN rc END DESC, name) AS INTEGER) AS place FROM g)
SELECT org, kind, place, name, {RUNS}, {IPUS}, ROUND(CAST(ic AS DOUBLE) / GREATEST(rc, 1), 6) AS ipus_per_run_cur,
  ROUND(CAST(ip AS DOUBLE) / GREATEST(rp, 1), 6) AS ipus_per_run_prev FROM r WHERE place <= CASE WHEN kind = 'task' THEN 3 ELSE 1 END""")
def org_top_changes(spark, d):
    return C.org_top_changes(tasks_tpch(spark, d), QUARTER)


@register("project_changes", f"""{windows_sql('events', PERIODS)}, g AS (SELECT period_no, period, org, project_name, {SIDES} FROM x GROUP BY 1, 2, 3, 4)
SELECT period_no, period, org, project_name, {IPUS} FROM g WHERE abs(ic - ip) >= 5""")
def project_changes(spark, d):
    return C.project_changes(tasks_events(spark, d), PERIODS)


def task_changes_sql(view: str, periods: list[C.Period]) -> str:
    return f"""{windows_sql(view, periods)}, g AS (SELECT period_no, period, org, project_name, task_name, {SIDES} FROM x GROUP BY 1, 2, 3, 4, 5),
flags AS (SELECT period_no, period, CASE WHEN ip <= 0 AND ic > 0 THEN 'Starts' WHEN ip > 0 AND ic <= 0 THEN 'Stops' ELSE 'Changes' END AS change_type,
  CASE WHEN ic > ip THEN 'up' WHEN ic < ip THEN 'down' ELSE 'flat' END AS direction, org, project_name, task_name, {RUNS}, {IPUS}
  FROM g WHERE abs(ic - ip) >= 1 OR abs(rc - rp) > 50)"""


@register("task_changes", task_changes_sql("events", PERIODS) + " SELECT * FROM flags")
def task_changes(spark, d):
    return C.task_changes(tasks_events(spark, d), PERIODS)


@register("task_changes_sparse", task_changes_sql("tpch", TPCH_PERIODS) + " SELECT * FROM flags")
def task_changes_sparse(spark, d):
    return C.task_changes(tasks_tpch(spark, d), TPCH_PERIODS)


@register("spike_kind", f"""{task_changes_sql('events', [WEEK])},
k AS (SELECT org, project_name, task_name, delta_ipus, delta_runs FROM flags WHERE change_type = 'Changes'),
h AS (SELECT end_date AS d, org, project_name, task_name, {shown(total(EI))} AS x, COUNT(*) AS n FROM tasks
  WHERE end_date BETWEEN DATE '2024-01-04' AND DATE '2024-01-24' GROUP BY ALL),
s AS (SELECT org, project_name, task_name, MAX(x) AS px, AVG(x) AS mx, MAX(n) AS pn, AVG(n) AS mn FROM h GROUP BY 1, 2, 3),
j AS (SELECT *, CASE WHEN abs(delta_runs) > 50 OR CASE WHEN mn > 0 THEN pn / mn ELSE pn END > CASE WHEN mx > 0 THEN px / mx ELSE GREATEST(px, 0) END
  THEN 'runs' ELSE 'ipus' END AS kind FROM k JOIN s USING (org, project_name, task_name)),
v AS (SELECT *, ROUND(CASE WHEN kind = 'runs' THEN delta_runs ELSE delta_ipus END, 6) AS spike_value FROM j)
SELECT org, project_name, task_name, kind, CASE WHEN spike_value >= 0 THEN 'up' ELSE 'down' END AS direction, CAST(spike_value AS DOUBLE) AS spike_value FROM v""")
def spike_kind(spark, d):
    tasks = tasks_events(spark, d)
    flags = C.task_changes(tasks, [WEEK]).where(F.col("change_type") == "Changes")
    keys = flags.select(*A.TASK_KEY, "delta_ipus", "delta_runs")
    return A.spike_kind(keys, A.task_history(tasks, keys, "2024-01-04", ANCHOR))


# --- run snapshots: every calendar month of the view stands for one import ---

def monthly_runs(spark, d):
    month = F.date_format("end_date", "yyyy-MM")
    return tasks_tpch(spark, d).withColumns({
        "run_id": month, "run_name": F.concat(F.lit("import "), month),
        "run_timestamp": F.to_timestamp(F.last_day("end_date")), "source_files": F.concat(month, F.lit(".csv")),
    })


def run_tables(spark, d):
    rows = monthly_runs(spark, d)
    return {"runs": R.run_headers(rows), **R.run_summaries(rows)}


RUN_ROWS = f"""{base('tpch')}, x AS (SELECT *, strftime(end_date, '%Y-%m') AS run_id, concat('import ', strftime(end_date, '%Y-%m')) AS run_name,
  CAST(last_day(end_date) AS TIMESTAMP) AS run_timestamp, concat(strftime(end_date, '%Y-%m'), '.csv') AS source_files FROM tasks),
runs AS (SELECT run_id, run_name, run_timestamp, source_files, CAST(0.16 AS DOUBLE) AS ipu_conversion_factor, CAST(36.04 AS DOUBLE) AS cost_per_ipu_month,
  COUNT(*) AS total_rows, {shown(total(EI))} AS total_ipus, {shown(total(EC))} AS total_cost, COUNT(DISTINCT task_run_id) AS unique_task_runs,
  COUNT(*) AS row_count FROM x GROUP BY ALL),
org_summaries AS (SELECT run_id, {ORG} AS org_name, {STATS}, {UNIQUE} FROM x GROUP BY 1, 2)"""


@register("run_headers", RUN_ROWS + " SELECT * FROM runs")
def run_headers(spark, d):
    return R.all_runs(run_tables(spark, d)["runs"])


@register("run_org_summaries", RUN_ROWS + " SELECT *, ROUND(total_ipus / task_count, 6) AS avg_ipus_per_task FROM org_summaries")
def run_org_summaries(spark, d):
    return run_tables(spark, d)["org_summaries"]


@register("run_env_summaries", RUN_ROWS + f""" SELECT run_id, COALESCE(NULLIF(TRIM(environment), ''), 'Unknown') AS environment, {STATS}, {UNIQUE}
FROM x GROUP BY 1, 2""")
def run_env_summaries(spark, d):
    return run_tables(spark, d)["env_summaries"]


@register("run_daily_stats", RUN_ROWS + f" SELECT run_id, end_date AS stat_date, {STATS} FROM x GROUP BY 1, 2")
def run_daily_stats(spark, d):
    return run_tables(spark, d)["daily_stats"]


@register("run_details_task_types", RUN_ROWS + f""" SELECT run_id, task_type, {STATS}, {UNIQUE} FROM x WHERE run_id = '1999-04' GROUP BY 1, 2""")
def run_details_task_types(spark, d):
    return R.run_details(run_tables(spark, d), "1999-04")["task_type_summaries"]


@register("run_details_status", RUN_ROWS + f" SELECT run_id, status, {STATS} FROM x WHERE run_id = '1999-04' GROUP BY 1, 2")
def run_details_status(spark, d):
    return R.run_details(run_tables(spark, d), "1999-04")["status_summaries"]


COMPARED = ["1998-02", "1999-04", "2000-10"]


@register("run_compare", RUN_ROWS + """ SELECT run_id, org_name, total_ipus, total_cost, task_count FROM org_summaries
WHERE run_id IN ('1998-02', '1999-04', '2000-10')""")
def run_compare(spark, d):
    return R.compare_runs(run_tables(spark, d), COMPARED)["org_comparison"]


@register("run_compare_projects", RUN_ROWS + f""", p AS (SELECT run_id, COALESCE(NULLIF(TRIM(project_name), ''), '-') AS project_name, {STATS} FROM x GROUP BY 1, 2)
SELECT run_id, project_name, total_ipus, total_cost, task_count FROM p WHERE run_id IN ('1998-02', '1999-04', '2000-10')""")
def run_compare_projects(spark, d):
    return R.compare_runs(run_tables(spark, d), COMPARED)["project_comparison"]


@register("run_trend", RUN_ROWS + """, last AS (SELECT run_id, run_name, run_timestamp FROM runs ORDER BY run_timestamp DESC LIMIT 10)
SELECT last.*, total_ipus, total_cost, task_count FROM last JOIN org_summaries USING (run_id) WHERE org_name = 'EUROPE'""")
def run_trend(spark, d):
    return R.run_trend(run_tables(spark, d), "org_summaries", "org_name", "EUROPE")


@register("run_trend_overall", RUN_ROWS + """ SELECT run_id, run_name, run_timestamp, total_ipus, total_cost, total_rows FROM runs
ORDER BY run_timestamp DESC LIMIT 10""")
def run_trend_overall(spark, d):
    return R.run_trend(run_tables(spark, d))


@register("run_anomalies", RUN_ROWS + """, s AS (SELECT AVG(total_ipus) AS m, stddev_samp(total_ipus) AS sd FROM runs),
z AS (SELECT run_id, run_name, run_timestamp, total_ipus, ROUND((total_ipus - m) / sd, 6) AS z_score FROM runs, s)
SELECT *, CASE WHEN z_score > 1.5 THEN 'High' ELSE 'Low' END AS anomaly_type FROM z WHERE abs(z_score) > 1.5""")
def run_anomalies(spark, d):
    return R.run_anomalies(run_tables(spark, d)["runs"], threshold=1.5)


# --- snapshots that are written, deleted from and read back ---

def written_runs(spark, d):
    root = work_dir(spark, "runs")
    R.write_runs(monthly_runs(spark, d), root)
    R.delete_run(spark, root, "1999-04")
    return R.read_runs(spark, root)


@register("run_store_headers", RUN_ROWS + " SELECT * FROM runs WHERE run_id <> '1999-04'")
def run_store_headers(spark, d):
    return R.all_runs(written_runs(spark, d)["runs"])


@register("run_store_summaries", RUN_ROWS + f""" SELECT 'org' AS kind, run_id, org_name AS name, task_count, total_ipus, total_cost, unique_tasks FROM org_summaries WHERE run_id <> '1999-04'
UNION ALL SELECT 'type', run_id, task_type, {STATS}, {UNIQUE} FROM x WHERE run_id <> '1999-04' GROUP BY run_id, task_type
UNION ALL SELECT 'status', run_id, status, {STATS}, CAST(NULL AS BIGINT) FROM x WHERE run_id <> '1999-04' GROUP BY run_id, status
UNION ALL SELECT 'day', run_id, CAST(end_date AS VARCHAR), {STATS}, CAST(NULL AS BIGINT) FROM x WHERE run_id <> '1999-04' GROUP BY run_id, end_date""")
def run_store_summaries(spark, d):
    tables, parts = written_runs(spark, d), None
    for kind, table, key in (("org", "org_summaries", "org_name"), ("type", "task_type_summaries", "task_type"), ("status", "status_summaries", "status"), ("day", "daily_stats", "stat_date")):
        t = tables[table]
        unique = F.col("unique_tasks") if "unique_tasks" in t.columns else F.lit(None).cast("long").alias("unique_tasks")
        part = t.select(F.lit(kind).alias("kind"), "run_id", F.col(key).cast("string").alias("name"), "task_count", "total_ipus", "total_cost", unique)
        parts = part if parts is None else parts.unionByName(part)
    return parts
