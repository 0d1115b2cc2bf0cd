"""Period-over-period comparison.

All windows of a report are read in one scan: rows are reduced to conditional sums per key, one
pair of sums per period, and the periods become rows after that."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import arrow, env_base, label, log_type_label, org_label, percent_change, trend
from meterlake.functions.pricing import LIMBS, fixed_parts, parts_sum, shown, usage
from meterlake.operators.filters import Day, as_date, in_days, log_type_is
from meterlake.schema import Pricing

# How large a change is reported.
PROJECT_CHANGE = 5
TASK_CHANGE = 1
TASK_RUN_CHANGE = 50


@dataclass(frozen=True)
class Period:
    name: str
    start: dt.date
    end: dt.date
    prev_start: dt.date
    prev_end: dt.date


def rolling(name: str, anchor: Day, days: int) -> Period:
    """The last ``days`` days and the same number of days before them."""
    end = as_date(anchor)
    start = end - dt.timedelta(days=days - 1)
    prev_end = start - dt.timedelta(days=1)
    return Period(name, start, end, prev_end - dt.timedelta(days=days - 1), prev_end)


def _month_before(first: dt.date) -> tuple[dt.date, dt.date]:
    last = first - dt.timedelta(days=1)
    return last.replace(day=1), last


def month_to_date(name: str, anchor: Day) -> Period:
    """Month to date and the prior month up to the same day number, or its last day."""
    end = as_date(anchor)
    start = end.replace(day=1)
    prev_start, prev_last = _month_before(start)
    return Period(name, start, end, prev_start, prev_last.replace(day=min(end.day, prev_last.day)))


def full_months(name: str, anchor: Day) -> Period:
    """The two whole months before the month of the anchor."""
    start, end = _month_before(as_date(anchor).replace(day=1))
    return Period(name, start, end, *_month_before(start))


def quarter_to_date(name: str, anchor: Day) -> Period:
    """Quarter to date and the same number of days from the start of the prior quarter."""
    end = as_date(anchor)
    start = end.replace(month=end.month - (end.month - 1) % 3, day=1)
    prev_start = (start - dt.timedelta(days=62)).replace(day=1)
    return Period(name, start, end, prev_start, prev_start + (end - start))


def report_periods(anchor: Day, whole_months: bool = False) -> list[Period]:
    month = full_months if whole_months else month_to_date
    return [rolling("Past week", anchor, 7), month("Past calendar month", anchor), rolling("Past 30 days", anchor, 30)]


def executive_periods(anchor: Day, today: Day) -> list[Period]:
    """Week, rolling month, month and quarter to date; the week ends before ``today``."""
    end = as_date(anchor)
    week_end = end - dt.timedelta(days=1) if end >= as_date(today) else end
    return [
        rolling("weekly", week_end, 7),
        rolling("monthly_30d", end, 30),
        month_to_date("monthly_calendar", end),
        quarter_to_date("quarterly", end),
    ]


def named(df: DataFrame) -> DataFrame:
    """Key columns with NULL shown as "(Unknown)"; blank text stays."""
    return df.fillna("(Unknown)", subset=["org", "project_name", "task_name"])


def _between(day: Column, start: dt.date, end: dt.date) -> Column:
    return day.between(F.lit(start), F.lit(end))


def in_periods(df: DataFrame, periods: Sequence[Period]) -> Column:
    """Rows of any window; the outer span first, for partition pruning."""
    span = in_days(df, min(p.prev_start for p in periods), max(p.end for p in periods))
    windows = [
        _between(F.col("end_date"), a, b) for p in periods for a, b in ((p.start, p.end), (p.prev_start, p.prev_end))
    ]
    return span & reduce(lambda x, y: x | y, windows)


def _measured(df: DataFrame, pricing: Pricing) -> DataFrame:
    """Task rows with the parts of their amounts as columns, so that a row is priced once and not
    once per window."""
    used = usage(df, pricing)
    if used.summed:
        return df
    return df.withColumns({**fixed_parts("_ipus", used.ipus), **fixed_parts("_cost", used.cost)})


def _windows(periods: Sequence[Period]) -> list[tuple[str, dt.date, dt.date]]:
    """Column suffix, first and last day of every window."""
    return [
        (f"{side}_{i}", a, b) for i, p in enumerate(periods)
        for side, a, b in (("cur", p.start, p.end), ("prev", p.prev_start, p.prev_end))
    ]


def window_sums(tasks: DataFrame, keys: Sequence[Column | str], periods: Sequence[Period], pricing: Pricing) -> DataFrame:
    """Runs, units and cost of every window per key: runs_cur_0, runs_prev_0, ipus_cur_0, …

    The first and last days of the windows cut the calendar into spans that no window divides. A row
    is summed once, into its key and span, however many windows hold it; a window is then the sum of
    the spans from its first to its last, over as many rows as keys and spans."""
    df = _measured(tasks, pricing)
    used, windows = usage(df, pricing), _windows(periods)
    cuts = sorted({a for _, a, _ in windows} | {b + dt.timedelta(days=1) for _, _, b in windows})
    span = reduce(lambda x, y: x + y, [(F.col("end_date") >= F.lit(c)).cast("int") for c in cuts])
    amounts = ("ipus", "cost")
    totals = {n: used.total(F.col(n)) if used.summed else parts_sum(*[F.col(f"_{n}_{part}") for part in LIMBS]) for n in amounts}
    cells = df.where(in_periods(df, periods)).groupBy(*keys, span.alias("_span")).agg(
        used.runs().alias("_runs"), *[c.alias(f"_{n}") for n, c in totals.items()]
    )
    out = []
    for name, a, b in windows:
        inside = F.col("_span").between(sum(c <= a for c in cuts), sum(c <= b for c in cuts))
        out.append(F.coalesce(F.sum(F.when(inside, F.col("_runs"))), F.lit(0)).cast("long").alias(f"runs_{name}"))
        out += [F.coalesce(F.sum(F.when(inside, F.col(f"_{n}"))), F.lit(0)).cast("decimal(38,8)").alias(f"{n}_{name}") for n in amounts]
    return cells.groupBy(*[c for c in cells.columns if c not in ("_span", "_runs", "_ipus", "_cost")]).agg(*out)


_VALUES = [f"{m}_{s}" for m in ("runs", "ipus", "cost") for s in ("cur", "prev")]


def _periods_to_rows(df: DataFrame, keys: Sequence[str], periods: Sequence[Period]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("period_no"), F.lit(p.name).alias("period"),
            *[F.col(f"{v}_{i}").alias(v) for v in _VALUES],
        )
        for i, p in enumerate(periods)
    ]
    out = df.select(*keys, F.inline(F.array(*rows)))
    return out.withColumns({f"delta_{m}": F.col(f"{m}_cur") - F.col(f"{m}_prev") for m in ("runs", "ipus", "cost")})


def changes(
    tasks: DataFrame, keys: Sequence[Column | str], periods: Sequence[Period], pricing: Pricing = Pricing()
) -> DataFrame:
    """Runs, units and cost of both windows of every period, per key. A key that is present in one
    window only has zeros for the other, and NULL keys compare with NULL keys."""
    grouped = window_sums(tasks, keys, periods, pricing)
    names = [c for c in grouped.columns if not c.startswith(("runs_", "ipus_", "cost_"))]
    return _periods_to_rows(grouped, names, periods)


def shown_changes(df: DataFrame) -> DataFrame:
    amounts = [c for c in df.columns if c.startswith(("ipus_", "cost_", "delta_ipus", "delta_cost"))]
    return df.withColumns({c: shown(F.col(c)) for c in amounts})


def window_changes(
    tasks: DataFrame, keys: Sequence[Column | str], period: Period, pricing: Pricing = Pricing()
) -> DataFrame:
    """Current against previous window on one dimension."""
    return shown_changes(changes(tasks, keys, [period], pricing).drop("period_no", "period"))


def period_totals(tasks: DataFrame, periods: Sequence[Period], pricing: Pricing = Pricing()) -> DataFrame:
    """Total units of each window; also where a window has no rows."""
    wide = window_sums(tasks, [], periods, pricing)
    rows = [
        F.struct(
            F.lit(p.name).alias("period"), F.lit(side).alias("side"),
            F.lit(a).alias("start_date"), F.lit(b).alias("end_date"),
            F.col(f"runs_{side}_{i}").alias("task_count"),
            shown(F.col(f"ipus_{side}_{i}")).alias("total_ipus"),
        )
        for i, p in enumerate(periods)
        for side, a, b in (("cur", p.start, p.end), ("prev", p.prev_start, p.prev_end))
    ]
    return wide.select(F.inline(F.array(*rows)))


def period_compare(
    tasks: DataFrame, periods: Sequence[Period], pricing: Pricing = Pricing(), log_type: str | None = None
) -> DataFrame:
    """Units per log type, organization and base environment in both windows of every period.

    The log-type lines cover both types whatever ``log_type`` is. Each combination of the three is
    summed before it is counted under each of its dimensions."""
    labels = [log_type_label().alias("log_type"), org_label().alias("org"), env_base(F.col("environment")).alias("environment")]
    cells = window_sums(tasks, labels, periods, pricing)
    scoped = F.lit(True) if not log_type else F.col("log_type") == log_type
    sides = F.array(
        F.struct(F.lit("log_type").alias("dimension"), F.col("log_type").alias("value"), F.lit(True).alias("kept")),
        F.struct(F.lit("org").alias("dimension"), F.col("org").alias("value"), scoped.alias("kept")),
        F.struct(F.lit("environment").alias("dimension"), F.col("environment").alias("value"), scoped.alias("kept")),
    )
    sums = [c for c in cells.columns if c.startswith(("runs_", "ipus_", "cost_"))]
    per_value = (
        cells.select(*sums, F.inline(sides)).where("kept")
        .groupBy("dimension", label(F.col("value"), "(Unknown)").alias("value"))
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    rows = shown_changes(_periods_to_rows(per_value, ["dimension", "value"], periods))
    return rows.select(
        "dimension", "value", "period_no", "period", "ipus_cur", "ipus_prev", "delta_ipus",
        arrow(F.col("delta_ipus")).alias("change"),
    ).orderBy("dimension", "value", "period_no")


def movers(change_rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n largest increases and decreases of units."""
    delta = F.col("delta_ipus")
    direction = F.when(delta > 0, "up").when(delta < 0, "down")
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(F.abs(delta)), key))
    return (
        change_rows.withColumn("direction", direction)
        .where(F.col("direction").isNotNull())
        .withColumn("place", place)
        .where(F.col("place") <= n)
        .orderBy(F.desc("direction"), "place")
    )


def with_trend(change_rows: DataFrame) -> DataFrame:
    cur, prev = F.col("ipus_cur").cast("double"), F.col("ipus_prev").cast("double")
    return change_rows.withColumns({"pct_change": percent_change(cur, prev), "trend": trend(cur, prev)})


def org_top_changes(
    tasks: DataFrame, period: Period, pricing: Pricing = Pricing(), top: int = 3, rate_moved: bool = False
) -> DataFrame:
    """Per organization: the project with the largest change and the ``top`` tasks, with runs and
    units per run; with ``rate_moved``, whether these differ before they are rounded."""
    cells = window_sums(named(tasks), ["org", "project_name", "task_name"], [period], pricing)
    sides = F.array(
        F.struct(F.lit("project").alias("kind"), F.col("project_name").alias("name")),
        F.struct(F.lit("task").alias("kind"), F.col("task_name").alias("name")),
    )
    sums = [f"{m}_{s}_0" for m in ("runs", "ipus") for s in ("cur", "prev")]
    names = cells.select("org", *sums, F.inline(sides)).groupBy("org", "kind", "name").agg(
        *[F.sum(c).alias(c[:-2]) for c in sums]
    )
    delta, run_delta = F.col("ipus_cur") - F.col("ipus_prev"), F.col("runs_cur") - F.col("runs_prev")
    by_runs = F.when(F.col("kind") == "task", run_delta), F.when(F.col("kind") == "task", F.col("runs_cur"))
    order = Window.partitionBy("org", "kind").orderBy(F.desc(F.abs(delta)), F.desc(by_runs[0]), F.desc(by_runs[1]), "name")
    placed = names.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    placed = placed.where((F.col("kind") == "task") | (F.col("place") == 1))

    def per_run(side: str) -> Column:
        return F.col(f"ipus_{side}").cast("double") / F.greatest(F.col(f"runs_{side}"), F.lit(1))

    return placed.select(
        "org", "kind", "place", "name", "runs_cur", "runs_prev", run_delta.alias("delta_runs"),
        shown(F.col("ipus_cur")).alias("ipus_cur"), shown(F.col("ipus_prev")).alias("ipus_prev"),
        shown(delta).alias("delta_ipus"),
        F.round(per_run("cur"), 6).alias("ipus_per_run_cur"), F.round(per_run("prev"), 6).alias("ipus_per_run_prev"),
        *([(per_run("cur") != per_run("prev")).alias("rate_moved")] if rate_moved else []),
    ).orderBy("org", "kind", "place")


def _scoped(tasks: DataFrame, log_type: str | None) -> DataFrame:
    return named(tasks.where(log_type_is(log_type)) if log_type else tasks)


def project_changes(
    tasks: DataFrame, periods: Sequence[Period], pricing: Pricing = Pricing(), log_type: str | None = None
) -> DataFrame:
    """Projects whose units changed by the reporting threshold or more."""
    rows = changes(_scoped(tasks, log_type), ["org", "project_name"], periods, pricing)
    kept = shown_changes(rows.where(F.abs("delta_ipus") >= PROJECT_CHANGE))
    return kept.select("period_no", "period", "org", "project_name", "ipus_cur", "ipus_prev", "delta_ipus").orderBy(
        "period_no", F.desc(F.abs("delta_ipus")), "org", "project_name"
    )


def task_changes(
    tasks: DataFrame, periods: Sequence[Period], pricing: Pricing = Pricing(), log_type: str | None = None
) -> DataFrame:
    """Tasks whose units or runs changed enough, as starts, stops or changes."""
    rows = changes(_scoped(tasks, log_type), ["org", "project_name", "task_name"], periods, pricing)
    kept = rows.where((F.abs("delta_ipus") >= TASK_CHANGE) | (F.abs("delta_runs") > TASK_RUN_CHANGE))
    kind = (
        F.when((F.col("ipus_prev") <= 0) & (F.col("ipus_cur") > 0), "Starts")
        .when((F.col("ipus_prev") > 0) & (F.col("ipus_cur") <= 0), "Stops")
        .otherwise("Changes")
    )
    direction = F.when(F.col("delta_ipus") > 0, "up").when(F.col("delta_ipus") < 0, "down").otherwise("flat")
    return shown_changes(kept.withColumns({"change_type": kind, "direction": direction})).select(
        "period_no", "period", "change_type", "direction", "org", "project_name", "task_name",
        "runs_cur", "runs_prev", "delta_runs", "ipus_cur", "ipus_prev", "delta_ipus",
    ).orderBy(
        "change_type", "period_no", F.desc("direction"), F.desc(F.abs("delta_ipus")), "org", "project_name", "task_name"
    )
