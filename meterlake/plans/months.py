"""Check queries: month-to-date view, drivers and what-if cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import month as M
from meterlake.operators.filters import TaskFilter
from meterlake.operators.month import Month
from meterlake.plans.registry import BASE, EI, EVENTS_PARENT, LOG, ORG, PROJECT, TASK_NAME, TPCH_PARENT, base, days, half_even, register, shown, total
from meterlake.plans.totals import FULL, STATS
from meterlake.plans.views import events_organizations, tasks_events, tasks_tpch, tpch_organizations

JAN = Month.of("2024-01-20", "2024-01-20")
DEC = Month.of("1998-12-01", "1998-12-18")
BUSY = ["org_1", "org_1 Mass Ingestion", "org_2", "org_2 Mass Ingestion"]


def month_sql(view: str, m: Month, budget: float, where: str = "TRUE") -> str:
    return f"""{base(view)}, daily AS (SELECT end_date AS d, {total(EI)} AS x FROM tasks
  WHERE {days(m.prev_start, m.end)} AND {where} GROUP BY 1),
m AS (SELECT *, SUM(x) OVER (ORDER BY d) AS running FROM daily WHERE d >= DATE '{m.start}'),
p AS (SELECT COALESCE(SUM(x), 0) AS prev FROM daily WHERE d <= DATE '{m.prev_end}'),
r AS (SELECT COALESCE(AVG(CAST(x AS DOUBLE)), 0) AS rate, COUNT(*) AS n FROM (SELECT * FROM m ORDER BY d DESC LIMIT 3)),
t AS (SELECT COALESCE(SUM(x), 0) AS mtd, MIN(d) FILTER (running >= {budget}) AS reached FROM m),
j AS (SELECT *, CAST(mtd AS DOUBLE) AS spent, CAST(ceil(({budget} - CAST(mtd AS DOUBLE)) / NULLIF(rate, 0)) AS INTEGER) AS need FROM t, r, p)
SELECT {shown('mtd')} AS mtd_ipus, ROUND(spent / {m.elapsed}, 6) AS avg_daily, CAST(n AS INTEGER) AS recent_days, ROUND(rate, 6) AS recent_avg,
  {m.remaining} AS days_remaining, ROUND(spent + rate * {m.remaining}, 6) AS projected_ipus, ROUND(spent / {budget} * 100, 6) AS budget_pct,
  ROUND(CAST({m.elapsed} AS DOUBLE) / {m.days} * 100, 6) AS expected_pct, {shown('prev')} AS prev_mtd_ipus, {shown('mtd - prev')} AS delta_vs_prev,
  CASE WHEN reached IS NOT NULL THEN 'already reached' WHEN rate <= 0 THEN 'not at current rate'
    WHEN DATE '{m.end}' + need > DATE '{m.last}' THEN 'after month-end' ELSE 'projected' END AS budget_state,
  CASE WHEN reached IS NOT NULL THEN reached WHEN rate > 0 THEN DATE '{m.end}' + need END AS budget_hit_date,
  CASE WHEN reached IS NULL AND rate > 0 THEN CAST(need AS DOUBLE) END AS budget_hit_days FROM j"""


def days_as_double(df: DataFrame) -> DataFrame:
    """An all-NULL integer column looks different in the two engines' result frames."""
    return df.withColumn("budget_hit_days", F.col("budget_hit_days").cast("double"))


IN_BUSY = f"{ORG} IN ({', '.join(repr(o) for o in BUSY)})"


@register("month_metrics", month_sql("events", JAN, 50000.0, IN_BUSY))
def month_metrics(spark, d):
    return days_as_double(M.month_metrics(tasks_events(spark, d), JAN, 50000.0, orgs=BUSY))


@register("month_metrics_prior_month", month_sql("tpch", DEC, 100.0, f"{LOG} = 'Task Usage'"))
def month_metrics_prior_month(spark, d):
    return days_as_double(M.month_metrics(tasks_tpch(spark, d), DEC, 100.0, log_type="Task Usage"))


@register("budget_hit", month_sql("tpch", DEC, 4500.0))
def budget_hit(spark, d):
    return days_as_double(M.month_metrics(tasks_tpch(spark, d), DEC, 4500.0))


def day_by_day_sql(view: str, m: Month, budget: float) -> str:
    return f"""{base(view)}, daily AS (SELECT end_date AS d, {total(EI)} AS x FROM tasks WHERE {days(m.prev_start, m.end)} GROUP BY 1),
cal AS (SELECT CAST(g AS DATE) AS date FROM generate_series(DATE '{m.start}', DATE '{m.end}', INTERVAL 1 DAY) t(g)),
j AS (SELECT date, CAST(COALESCE(a.x, 0) AS DOUBLE) AS x, COALESCE(b.x, 0) AS prev FROM cal LEFT JOIN daily a ON a.d = date
  LEFT JOIN (SELECT * FROM daily WHERE d <= DATE '{m.prev_end}') b ON day(b.d) = day(date)),
r AS (SELECT COALESCE(AVG(CAST(x AS DOUBLE)), 0) AS rate FROM (SELECT * FROM daily WHERE d >= DATE '{m.start}' ORDER BY d DESC LIMIT 3)),
s AS (SELECT SUM(x) AS mtd, AVG(x) AS mean, stddev_pop(x) AS sd FROM j),
days AS (SELECT date, CAST(day(date) AS INTEGER) AS day_num, ROUND(x, 6) AS total_ipus, ROUND(mtd / {m.elapsed}, 6) AS avg_daily,
  ROUND(rate, 6) AS recent_avg, ROUND(CAST({budget} AS DOUBLE) / {m.days}, 6) AS budget_pace, {shown('prev')} AS total_ipus_prev,
  ROUND(x, 6) >= ROUND(CASE WHEN mean > 0 THEN mean + GREATEST(sd, mean * 0.25) ELSE 0 END, 6) AS spike FROM j, r, s)"""


@register("day_by_day", day_by_day_sql("tpch", DEC, 4500.0) + " SELECT * FROM days")
def day_by_day(spark, d):
    return M.day_by_day(tasks_tpch(spark, d), DEC, 4500.0)


@register("hottest_days", day_by_day_sql("events", JAN, 1.0)
          + " SELECT date, round_even(total_ipus, 2) AS total_ipus FROM days ORDER BY total_ipus DESC, date LIMIT 5")
def hottest_days(spark, d):
    return M.hottest_days(M.day_by_day(tasks_events(spark, d), JAN))


@register("spike_vs_other", day_by_day_sql("events", JAN, 1.0) + f""", o AS (SELECT end_date AS date, {ORG} AS org, {total(EI)} AS x FROM tasks
  WHERE {days(JAN.start, JAN.end)} GROUP BY 1, 2)
SELECT org, {half_even('COALESCE(SUM(x) FILTER (spike), 0)')} AS spike_days, {half_even('COALESCE(SUM(x) FILTER (NOT spike), 0)')} AS other_days
FROM o JOIN days USING (date) GROUP BY org ORDER BY spike_days DESC, org LIMIT 12""")
def spike_vs_other(spark, d):
    tasks = tasks_events(spark, d)
    return M.spike_vs_other(tasks, M.day_by_day(tasks, JAN), JAN)


def rollup_sql(view: str, start: str, end: str, parent: str) -> str:
    return f"""{base(view)}, o AS (SELECT {ORG} AS org, {shown(total(EI))} AS x FROM tasks WHERE {days(start, end)} GROUP BY 1),
f AS (SELECT {BASE.format('org')} AS family, SUM(CAST(x AS DECIMAL(28,8))) AS x FROM o GROUP BY 1),
p AS (SELECT {parent.format('family')} AS parent, family, x FROM f),
w AS (SELECT *, SUM(x) OVER (PARTITION BY parent) AS px, SUM(x) OVER () AS gx FROM p),
u AS (SELECT parent, family, x, px, gx FROM w UNION ALL SELECT parent, NULL, MAX(px), MAX(px), MAX(gx) FROM w GROUP BY parent)
SELECT parent, family, {shown('x')} AS total_ipus, ROUND(CAST(x AS DOUBLE) / CAST(gx AS DOUBLE) * 100, 4) AS pct_total,
  ROUND(CAST(x AS DOUBLE) / CAST(px AS DOUBLE) * 100, 4) AS pct_parent FROM u"""


@register("rollup_parent", rollup_sql("tpch", *FULL, TPCH_PARENT))
def rollup_parent(spark, d):
    return M.family_rollup(tasks_tpch(spark, d), TaskFilter(*FULL), tpch_organizations(spark))


@register("rollup_parent_month", rollup_sql("events", "2024-01-01", "2024-01-20", EVENTS_PARENT))
def rollup_parent_month(spark, d):
    return M.family_rollup(tasks_events(spark, d), TaskFilter(JAN.start, JAN.end), events_organizations(spark))


@register("log_type_mix", f"""{base('tpch')}, f AS (SELECT {BASE.format(ORG)} AS family,
  COALESCE(SUM(CAST({EI} AS DECIMAL(28,8))) FILTER ({LOG} = 'Task Usage'), 0) AS t,
  COALESCE(SUM(CAST({EI} AS DECIMAL(28,8))) FILTER (log_type = 'Mass Ingestion'), 0) AS b FROM tasks WHERE {days(*FULL)} GROUP BY 1)
SELECT {TPCH_PARENT.format('family')} AS parent, family, {half_even('t')} AS task_usage, {half_even('b')} AS bulk_ingestion,
  {half_even('t + b')} AS total, round_even(CAST(t AS DOUBLE) / CAST(t + b AS DOUBLE) * 100, 1) AS task_pct,
  round_even(CAST(b AS DOUBLE) / CAST(t + b AS DOUBLE) * 100, 1) AS bulk_pct FROM f""")
def log_type_mix(spark, d):
    return M.log_type_mix(tasks_tpch(spark, d), *FULL, tpch_organizations(spark))


PICKED = ["2024-01-03", "2024-01-07", "2024-01-19"]
IN_PICKED = "end_date IN (" + ", ".join(f"DATE '{p}'" for p in PICKED) + ")"


@register("org_drivers", f"""{base('events')}, o AS (SELECT {ORG} AS org, {total(EI)} AS x FROM tasks WHERE {IN_PICKED} GROUP BY 1),
w AS (SELECT *, SUM(x) OVER () AS g, SUM(x) OVER (PARTITION BY {BASE.format('org')}) AS f, {BASE.format('org')} AS family FROM o)
SELECT {EVENTS_PARENT.format('family')} AS parent, org, {half_even('x')} AS total_ipus,
  round_even(CAST(f AS DOUBLE) / CAST(g AS DOUBLE) * 100, 1) AS org_pct, round_even(CAST(x AS DOUBLE) / CAST(g AS DOUBLE) * 100, 1) AS log_pct FROM w""")
def org_drivers(spark, d):
    return M.org_drivers(tasks_events(spark, d), JAN.start, JAN.end, events_organizations(spark), days=PICKED)


@register("project_drivers", f"""{base('tpch')} SELECT project_name, {STATS} FROM tasks WHERE {days(DEC.start, DEC.end)}
AND project_name IS NOT NULL GROUP BY 1 ORDER BY total_ipus DESC, project_name LIMIT 15""")
def project_drivers(spark, d):
    return M.project_drivers(tasks_tpch(spark, d), DEC.start, DEC.end)


@register("task_drivers", f"""{base('tpch')}, r AS (SELECT * FROM tasks WHERE {days(*FULL)}),
t AS (SELECT {ORG} AS org, {PROJECT} AS project_name, {TASK_NAME} AS task_name, {total(EI)} AS x FROM r GROUP BY ALL
  ORDER BY x DESC, org, project_name, task_name LIMIT 40),
p AS (SELECT project_name, {total(EI)} AS px FROM r WHERE project_name IS NOT NULL GROUP BY 1), g AS (SELECT {total(EI)} AS gx FROM r)
SELECT org, t.project_name, task_name, {half_even('x')} AS task_ipus,
  {half_even('COALESCE(px, SUM(x) OVER (PARTITION BY t.project_name))')} AS project_ipus,
  round_even(CAST(x AS DOUBLE) / CAST(gx AS DOUBLE) * 100, 1) AS pct FROM t LEFT JOIN p USING (project_name), g
ORDER BY project_ipus DESC, task_ipus DESC, org, project_name, task_name LIMIT 25""")
def task_drivers(spark, d):
    return M.task_drivers(tasks_tpch(spark, d), *FULL)


def what_if_sql(view: str, m: Month, budget: float) -> str:
    return f"""{base(view)}, c AS (SELECT end_date AS d, {ORG} AS org, {PROJECT} AS project_name, {TASK_NAME} AS task_name, {total(EI)} AS x
  FROM tasks WHERE {days(m.start, m.end)} GROUP BY ALL),
i AS (SELECT 'org' AS cut, org, CAST(NULL AS VARCHAR) AS project_name, CAST(NULL AS VARCHAR) AS task_name, d, x FROM c UNION ALL
  SELECT 'project', NULL, project_name, NULL, d, x FROM c WHERE project_name <> '-' UNION ALL
  SELECT 'task', org, project_name, task_name, d, x FROM c),
s AS (SELECT cut, org, project_name, task_name, d, SUM(x) AS x FROM i GROUP BY ALL),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cut, org, project_name, task_name ORDER BY d DESC) AS nth FROM s),
a AS (SELECT cut, org, project_name, task_name, SUM(x) AS x, AVG(CAST(x AS DOUBLE)) FILTER (nth <= 3) AS item_rate,
  COUNT(*) FILTER (nth <= 3) AS item_days FROM n GROUP BY ALL),
t AS (SELECT d, SUM(x) AS x, SUM(SUM(x)) OVER (ORDER BY d) AS running FROM c GROUP BY d),
w AS (SELECT (SELECT CAST(SUM(x) AS DOUBLE) FROM t) AS spent, (SELECT MIN(d) FROM t WHERE running >= {budget}) AS reached,
  (SELECT AVG(CAST(x AS DOUBLE)) FROM (SELECT * FROM t ORDER BY d DESC LIMIT 3)) AS rate),
j AS (SELECT *, GREATEST(rate - item_rate, 0) AS left_rate FROM a, w),
k AS (SELECT *, CAST(ceil(({budget} - spent) / NULLIF(left_rate, 0)) AS INTEGER) AS need FROM j)
SELECT cut, org, project_name, task_name, {shown('x')} AS item_mtd, CAST(item_days AS INTEGER) AS item_recent_days,
  ROUND(item_rate, 6) AS item_recent_avg, ROUND(item_rate * {m.remaining}, 6) AS remaining_saved,
  ROUND(spent + left_rate * {m.remaining}, 6) AS new_projected,
  CASE WHEN reached IS NOT NULL THEN 'already reached' WHEN left_rate <= 0 THEN 'not at current rate'
    WHEN DATE '{m.end}' + need > DATE '{m.last}' THEN 'after month-end' ELSE 'projected' END AS budget_state,
  CASE WHEN reached IS NOT NULL THEN reached WHEN left_rate > 0 THEN DATE '{m.end}' + need END AS budget_hit_date,
  CASE WHEN reached IS NULL AND left_rate > 0 THEN CAST(need AS DOUBLE) END AS budget_hit_days FROM k"""


@register("what_if", what_if_sql("tpch", DEC, 7000.0))
def what_if(spark, d):
    return days_as_double(M.what_if(tasks_tpch(spark, d), DEC, 7000.0))


@register("what_if_reached", what_if_sql("events", JAN, 30000.0))
def what_if_reached(spark, d):
    return days_as_double(M.what_if(tasks_events(spark, d), JAN, 30000.0))
