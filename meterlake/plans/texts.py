"""Check queries: text reports."""

from __future__ import annotations

import datetime as dt

from meterlake.operators import compare as C
from meterlake.operators import reports as P
from meterlake.plans.comparisons import EXECUTIVE, PERIODS, WHOLE_MONTHS, compare_sql, windows_sql
from meterlake.plans.registry import LOG, ORG, register
from meterlake.plans.series import SHOWN_RANGE, anomaly_sql, coverage_sql, drivers_sql, islands_sql, spikes_sql
from meterlake.plans.totals import FULL
from meterlake.plans.views import tasks_events, tasks_tpch

EVERY = ("Past week", "Past calendar month", "Past 30 days")


def fixed2(x: str, separators: bool = True) -> str:
    return f"format('{{:{',' if separators else ''}.2f}}', CAST(ROUND({x}, 2) AS DOUBLE))"


def arrow2(x: str) -> str:
    return f"concat(CASE WHEN {x} >= 0 THEN '↑ ' ELSE '↓ ' END, {fixed2(f'abs({x})')})"


def spike_lines_sql(view: str, only: str, section: int, title: str, period: C.Period) -> str:
    """Header, count and first five of the spikes of one period."""
    back = dt.timedelta(days=(period.end - period.start).days + 1)
    windows = [str(d) for d in (period.start, period.end, period.start - back, period.start - dt.timedelta(days=1))]
    found = f"({spikes_sql(view, *windows, 3.0, 10, only)})"
    shown_first = "ORDER BY z_score DESC, daily_ipus DESC, task_date, task_name, task_id LIMIT 5"
    return f"""SELECT {section} AS section, 'Task Spikes ({title}):' AS text UNION ALL
SELECT {section}, CASE WHEN COUNT(*) = 0 THEN '- No task showed a major spike versus prior baseline.'
  ELSE concat('- ', COUNT(*), ' task spike(s) flagged. Top items:') END FROM {found} UNION ALL
SELECT {section}, concat('  - ', strftime(task_date, '%B %-d, %Y'), ': ', task_name, ' in ', org, ' / ', project_name,
  ' ran materially above baseline (about ', format('{{:.1f}}', ROUND(multiplier_vs_baseline, 1)), 'x).') FROM (SELECT * FROM {found} {shown_first})"""


def narrative_sql(view: str, periods: list[C.Period], only: str = "TRUE") -> str:
    """Lines of all sections; ``only`` is the log-type condition of all but the log-type lines."""
    short = [f"{p.name} ({p.start:%b} {p.start.day} - {p.end:%b} {p.end.day}): total IPUs " for p in periods]
    against = ["previous week", "previous period", "previous 30-day period"]
    titles = ["Past Week", "Month-to-date", "Past 30 Days"]
    compared = compare_sql(view, periods, only).split(" SELECT dimension", 1)[0].rsplit("SELECT dimension, value, period_no", 1)[0]
    dims = " UNION ALL ".join(
        f"""SELECT {n} AS section, '{title} comparison:' AS text UNION ALL
SELECT {n}, concat('{title}: ', value) FROM g WHERE dimension = '{d}' AND period_no = 0 UNION ALL
SELECT {n}, concat('  ', period, ': ', {fixed2('ic')}, ' IPUs -> ', {fixed2('ip')}, ' previous (', {arrow2('ic - ip')}, ')') FROM g WHERE dimension = '{d}'"""
        for n, d, title in ((2, "log_type", "Log type"), (3, "org", "Organization"), (4, "environment", "Environment"))
    )
    changed = """COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'cur'), 0) AS c,
  COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'prev'), 0) AS p,
  COUNT(*) FILTER (side = 'cur') AS rc, COUNT(*) FILTER (side = 'prev') AS rp"""
    runs = "concat(CASE WHEN rc >= rp THEN '↑ ' ELSE '↓ ' END, format('{:,}', abs(rc - rp)))"
    return f"""{compared}, y AS (SELECT * FROM x WHERE {only}),
totals AS (SELECT period_no, {changed} FROM (SELECT w.period_no, w.side, ei FROM w LEFT JOIN y ON y.period_no = w.period_no
  AND y.side = w.side) GROUP BY 1),
pc AS (SELECT period_no, org, project_name, {changed} FROM y GROUP BY 1, 2, 3),
tc AS (SELECT period_no, org, project_name, task_name, {changed} FROM y GROUP BY 1, 2, 3, 4),
tf AS (SELECT *, {titles}[period_no + 1] AS title, CASE WHEN p <= 0 AND c > 0 THEN 'Starts' WHEN p > 0 AND c <= 0 THEN 'Stops'
  WHEN c > p THEN 'Going up' WHEN c < p THEN 'Going down' END AS kind FROM tc WHERE abs(c - p) >= 1 OR abs(rc - rp) > 50),
tl AS (SELECT CASE WHEN kind IN ('Starts', 'Stops') THEN 7 ELSE 6 END AS section, * FROM tf WHERE kind IS NOT NULL)
SELECT 1 AS section, concat({short}[period_no + 1], {fixed2('c')}, ' -> ', {against}[period_no + 1], ' ', {fixed2('p')}, ' (', {arrow2('c - p')}, ')') AS text FROM totals
UNION ALL {dims}
UNION ALL SELECT 5, 'Project anomalies:'
UNION ALL SELECT 5, concat('- ', {titles}[period_no + 1], ': ', org, ' / ', project_name, ' IPUs ', {fixed2('p', False)}, ' -> ', {fixed2('c', False)}, ' (',
  {arrow2('c - p')}, ')') FROM pc WHERE abs(c - p) >= 5
UNION ALL SELECT 6, 'Task anomalies:' UNION ALL SELECT 6, '- Changes' UNION ALL SELECT 7, '- Starts and stops'
UNION ALL SELECT DISTINCT section, concat('  - ', title) FROM tl
UNION ALL SELECT section, concat('    - ', kind) FROM (SELECT DISTINCT section, title, kind FROM tl)
UNION ALL SELECT section, concat('      - ', org, ' / ', project_name, ' / ', task_name, ' IPUs ', {fixed2('p', False)}, ' -> ', {fixed2('c', False)}, ' (',
  {arrow2('c - p')}, '), Runs ', rp, ' -> ', rc, ' (', {runs}, ')') FROM tl
UNION ALL {spike_lines_sql(view, only, 8, 'Past Week', periods[0])}
UNION ALL {spike_lines_sql(view, only, 9, 'Month', periods[1])}
UNION ALL {spike_lines_sql(view, only, 10, 'Rolling Month', periods[2])}"""


@register("narrative", narrative_sql("events", PERIODS))
def narrative(spark, d):
    return P.narrative(tasks_events(spark, d), "2024-01-24", EVERY).select("section", "text")


@register("narrative_whole_months", narrative_sql("tpch", WHOLE_MONTHS, f"{LOG} = 'Task Usage'"))
def narrative_whole_months(spark, d):
    lines = P.narrative(tasks_tpch(spark, d), "1999-03-31", EVERY, whole_months=True, log_type="Task Usage")
    return lines.select("section", "text")


def signed2(x: str) -> str:
    return f"concat(CASE WHEN {x} >= 0 THEN '+' ELSE '-' END, {fixed2(f'abs({x})')})"


def whole(x: str) -> str:
    return f"format('{{:,}}', {x})"


def signed_whole(x: str) -> str:
    return f"concat(CASE WHEN {x} >= 0 THEN '+' ELSE '-' END, {whole(f'abs({x})')})"


def rate(x: str) -> str:
    def places(n: int) -> str:
        return f"format('{{:.{n}f}}', CAST(ROUND(CAST({x} AS DECIMAL(30,6)), {n}) AS DOUBLE))"

    return f"CASE WHEN {x} = 0 THEN '0' WHEN {x} >= 0.01 THEN {places(3)} WHEN {x} >= 0.0001 THEN {places(6)} ELSE format('{{:.2e}}', {x}) END"


def long_range(a: dt.date, b: dt.date) -> str:
    return f"{a:%B} {a.day}, {a.year} to {b:%B} {b.day}, {b.year}"


def executive_section_sql(view: str, p: C.Period, section: int) -> str:
    """Lines of one period: totals, movers, and the split by organization."""
    sums = """COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'cur'), 0) AS c, COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'prev'), 0) AS p,
  COUNT(*) FILTER (side = 'cur') AS rc, COUNT(*) FILTER (side = 'prev') AS rp"""
    trends = " UNION ALL ".join(
        f"""SELECT {section + 1} AS section, concat('- {word} trending {way}: ', COALESCE(string_agg(k, ', ' ORDER BY nth), 'none material'), '.') AS text FROM (
  SELECT k, ROW_NUMBER() OVER (ORDER BY abs(c - p) DESC, k NULLS FIRST) AS nth FROM {source} WHERE {test}) WHERE nth <= 3 AND k IS NOT NULL"""
        for source, word in (("mo", "Organizations"), ("mp", "Projects")) for way, test in (("up", "c > p"), ("down", "c < p"))
    )
    org = ORG.replace("(org)", "(raw_org)")
    runs = f"""CASE WHEN rc > rp THEN concat('up ', {signed_whole('rc - rp')}, ' runs (', rp, ' → ', rc, ')')
  WHEN rc < rp THEN concat('down ', {signed_whole('rc - rp')}, ' runs (', rp, ' → ', rc, ')') ELSE concat('flat at ', rc, ' runs') END"""
    quoted = P.period_title(p)
    month = f"""SELECT {section}, '{p.start:%B} Change Report' UNION ALL
SELECT {section}, concat({fixed2('abs(c - p)')}, CASE WHEN c >= p THEN ' IPU increase' ELSE ' IPU decrease' END, ' from {p.prev_start:%b} to {p.start:%b}') FROM a UNION ALL
""" if p.name == "monthly_calendar" else ""
    return f"""SELECT * FROM ({windows_sql(view, [p])}, a AS (SELECT {sums} FROM x), mo AS (SELECT {org} AS k, {sums} FROM x GROUP BY 1),
used AS (SELECT * FROM mo WHERE c <> 0 OR p <> 0),
mp AS (SELECT raw_project AS k, {sums} FROM x GROUP BY 1),
n AS (SELECT {org} AS o, 'project' AS kind, project_name AS name, {sums} FROM x GROUP BY 1, 2, 3 UNION ALL
  SELECT {org}, 'task', task_name, {sums} FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o, kind ORDER BY abs(c - p) DESC, CASE WHEN kind = 'task' THEN rc - rp END DESC,
  CASE WHEN kind = 'task' THEN rc END DESC, name) AS nth, CAST(c AS DOUBLE) / GREATEST(rc, 1) AS xc, CAST(p AS DOUBLE) / GREATEST(rp, 1) AS xp FROM n WHERE o IN (SELECT k FROM used)),
t AS (SELECT * FROM r WHERE kind = 'task' AND nth <= 3)
SELECT {section} AS section, '{P.PERIOD_TITLES[p.name]}' AS text UNION ALL
{month}SELECT {section}, '- {quoted}: {long_range(p.start, p.end)} (vs {long_range(p.prev_start, p.prev_end)}).' UNION ALL
SELECT {section}, concat('  - Workload: ', {whole('rp')}, ' → ', {whole('rc')}, ' tasks (', {signed_whole('rc - rp')}, ').') FROM a UNION ALL
SELECT {section}, concat('  - IPU usage: ', {fixed2('p')}, ' → ', {fixed2('c')}, ' (', {signed2('c - p')}, ').') FROM a UNION ALL
SELECT {section}, concat('  - Totals: ', {whole('rc')}, ' tasks, ', {fixed2('c')}, ' total IPUs.') FROM a UNION ALL {trends} UNION ALL
SELECT {section + 2}, concat('- ', k, ': ', CASE WHEN c >= p THEN 'Increased ' ELSE 'Decreased ' END, {fixed2('abs(c - p)')}, ' IPUs') FROM used UNION ALL
SELECT {section + 2}, concat('  - ', name, ': ', CASE WHEN c >= p THEN 'increased ' ELSE 'decreased ' END, {fixed2('abs(c - p)')}, ' IPUs')
  FROM r WHERE kind = 'project' AND nth = 1 UNION ALL
SELECT {section + 2}, concat('    - ', name, ': ', {runs}) FROM t UNION ALL
SELECT {section + 2}, concat('      - IPUs: ', {fixed2('p')}, ' → ', {fixed2('c')}, ' (', {signed2('c - p')}, ')') FROM t UNION ALL
SELECT {section + 2}, concat('      - IPU/run: ', {rate('xp')}, ' → ', {rate('xc')},
  CASE WHEN {rate('xp')} = {rate('xc')} AND xp <> xc THEN ' (tiny change)' ELSE '' END) FROM t)"""


def executive_sql(view: str, anchor: dt.date, periods: list[C.Period]) -> str:
    start = anchor - dt.timedelta(days=89)
    unusual = anomaly_sql(view, str(start), str(anchor), "total_ipus", 2.0)
    sections = " UNION ALL ".join(executive_section_sql(view, p, 10 * (i + 1)) for i, p in enumerate(periods))
    spike_period = C.Period("watch", start, anchor, start, anchor)
    same = " UNION ALL ".join(f"SELECT {n}, '{text}'" for n, texts in ((0, P.SUMMARY), (92, P.ACTIONS)) for text in texts)
    return f"""SELECT 0 AS section, 'Usage Executive Trend Report' AS text UNION ALL {same} UNION ALL SELECT 0, 'Data through {anchor:%B} {anchor.day}, {anchor.year}' UNION ALL
{sections} UNION ALL SELECT 90, 'Potential Anomalies' UNION ALL
SELECT 90, CASE WHEN COUNT(*) = 0 THEN '- total_ipus: no unusual pattern detected.'
  ELSE concat('- total_ipus: ', COUNT(*), ' unusual day(s) detected. Dates to review:') END FROM ({unusual}) UNION ALL
SELECT 90, text FROM ({drivers_sql(view, str(start), str(anchor), 2.0).replace('SELECT date, CAST(ROUND(whole', ', d AS (SELECT date, CAST(ROUND(whole', 1)}),
  top AS (SELECT * FROM a ORDER BY z_score DESC, date LIMIT 3)
  SELECT concat('  - ', strftime(top.date, '%B %-d, %Y'), ' (', anomaly_type, '): ', {fixed2('CAST(total_ipus AS DECIMAL(28,6))')}, ' IPUs.',
    CASE WHEN driver_kind IS NOT NULL THEN concat(' Primary driver: ', driver_kind, ' ', driver_name, ' (', {fixed2('CAST(driver_ipus AS DECIMAL(28,6))')}, ' IPUs).')
      ELSE '' END) AS text FROM top LEFT JOIN d USING (date)) UNION ALL
{spike_lines_sql(view, 'TRUE', 91, 'x', spike_period).replace("'Task Spikes (x):'", "'Task Spike Watch'")}"""


EXEC_ANCHOR = dt.date(1999, 5, 31)


@register("executive_report", executive_sql("tpch", EXEC_ANCHOR, EXECUTIVE))
def executive_report(spark, d):
    lines = P.executive(tasks_tpch(spark, d), EXEC_ANCHOR, EXEC_ANCHOR, tuple(P.PERIOD_TITLES))
    return lines.select("section", "text")


def coverage_message_sql(start: str, end: str) -> str:
    holes = coverage_sql(f"end_date BETWEEN DATE '{start}' AND DATE '{end}'")
    return f"""{holes.split("SELECT org, log_type, strftime", 1)[0]}, gaps AS (SELECT org, log_type, strftime{holes.split("SELECT org, log_type, strftime", 1)[1]}),
gone AS (SELECT CAST(g AS DATE) AS d FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) t(g)
  WHERE CAST(g AS DATE) NOT IN (SELECT d FROM seen)), {islands_sql('gone')},
placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY a) AS nth, COUNT(*) OVER () AS n FROM isl),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY days_missing DESC, org, log_type) AS nth, COUNT(*) OVER () AS n FROM gaps WHERE days_missing > 0)
SELECT 1 AS section, concat('Missing data detected on ', MAX(n), ' global gap(s): ', string_agg({SHOWN_RANGE}, ', ' ORDER BY a) FILTER (nth <= 5),
  CASE WHEN MAX(n) > 5 THEN concat(' and ', MAX(n) - 5, ' more gap(s)') ELSE '' END, '.') AS text FROM placed UNION ALL
SELECT 2, concat('- ', org, ' (', log_type, '): has ', first_date, ' → ', last_date, ', missing ', days_missing, ' day(s) in ', gap_count, ' gap(s) — ',
  CASE WHEN length(missing_ranges) > 90 THEN concat(missing_ranges[1:87], '...') ELSE missing_ranges END) FROM ranked WHERE nth <= 8 UNION ALL
SELECT 3, concat('…and ', MAX(n) - 8, ' more org/log-type combination(s) with gaps.') FROM ranked HAVING MAX(n) > 8"""


@register("coverage_message", coverage_message_sql(*FULL))
def coverage_message(spark, d):
    return P.coverage_message(tasks_tpch(spark, d), *FULL).select("section", "text")


@register("narrative_project_lines", f"""{windows_sql('events', PERIODS)}, g AS (SELECT period_no, org, project_name,
  COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'cur'), 0) AS c, COALESCE(SUM(CAST(ei AS DECIMAL(28,8))) FILTER (side = 'prev'), 0) AS p
  FROM x GROUP BY 1, 2, 3)
SELECT concat('- ', ['Past Week', 'Month-to-date', 'Past 30 Days'][period_no + 1], ': ', org, ' / ', project_name, ' IPUs ',
  format('{{:.2f}}', CAST(ROUND(p, 2) AS DOUBLE)), ' -> ', format('{{:.2f}}', CAST(ROUND(c, 2) AS DOUBLE)), ' (', CASE WHEN c >= p THEN '↑ ' ELSE '↓ ' END,
  format('{{:,.2f}}', CAST(ROUND(abs(c - p), 2) AS DOUBLE)), ')') AS text FROM g WHERE abs(c - p) >= 5""")
def narrative_project_lines(spark, d):
    lines = P.narrative(tasks_events(spark, d), "2024-01-24", EVERY)
    return lines.where("section = 5 AND rank > 0").select("text")
