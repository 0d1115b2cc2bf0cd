"""Month-to-date view: projection, budget, day-by-day frame, drivers and what-if cuts.

Everything is first reduced to daily totals of the month (and of the prior month where it is
compared), so the frames below hold at most a few dozen days per key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import base_org, org_label
from meterlake.functions.pricing import eff_cost, eff_ipus, exact_sum, shown
from meterlake.operators.filters import Day, TaskFilter, as_date, in_days, log_type_is
from meterlake.operators.series import calendar
from meterlake.operators.stats import org_stats, task_keys
from meterlake.schema import BULK, TASK, Pricing
from meterlake.sources.organizations import parent_of

RECENT_DAYS = 3  # fixed value: the projection uses the last three observed days


@dataclass(frozen=True)
class Month:
    """A calendar month, seen up to ``end``, with the prior month's same span."""

    start: dt.date
    end: dt.date
    last: dt.date

    @classmethod
    def of(cls, day: Day, data_end: Day) -> Month:
        start = as_date(day).replace(day=1)
        last = (start + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
        return cls(start, min(last, as_date(data_end)), last)

    @property
    def days(self) -> int:
        return self.last.day

    @property
    def elapsed(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def remaining(self) -> int:
        return max(self.days - self.elapsed, 0)

    @property
    def prev_start(self) -> dt.date:
        return (self.start - dt.timedelta(days=1)).replace(day=1)

    @property
    def prev_end(self) -> dt.date:
        whole = (self.start - dt.timedelta(days=1)).day
        return self.prev_start + dt.timedelta(days=min(self.elapsed, whole) - 1)


def _scope(tasks: DataFrame, start: dt.date, end: dt.date, orgs: Sequence[str] | None, log_type: str | None) -> DataFrame:
    rows = tasks.where(in_days(tasks, start, end))
    if log_type:
        rows = rows.where(log_type_is(log_type))
    if orgs is not None:
        rows = rows.where(org_label().isin(list(orgs)))
    return rows


def _daily(rows: DataFrame, pricing: Pricing, *keys: Column) -> DataFrame:
    return rows.groupBy(F.col("end_date").alias("date"), *keys).agg(exact_sum(eff_ipus(pricing)).alias("ipus"))


def _recent(day: Column, ipus: Column) -> Column:
    """Aggregate: amounts of the last observed days, newest first. One key has at most one entry
    per day of the month."""
    entries = F.reverse(F.array_sort(F.collect_list(F.when(ipus.isNotNull(), F.struct(day.alias("d"), ipus.cast("double").alias("x"))))))
    return F.transform(F.slice(entries, 1, RECENT_DAYS), lambda e: e["x"])


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def _budget_outcome(budget: float, spent: Column, rate: Column, reached: Column, month: Month) -> dict[str, Column]:
    """State, date and days until the budget is used up at a daily rate."""
    none_date, none_int = F.lit(None).cast("date"), F.lit(None).cast("int")
    if budget <= 0:
        return {"state": F.lit("no budget"), "date": none_date, "days": none_int}
    days = F.ceil((F.lit(float(budget)) - spent) / F.nullif(rate, F.lit(0.0))).cast("int")
    hit = F.date_add(F.lit(month.end), days)
    state = (
        F.when(reached.isNotNull(), "already reached")
        .when(rate <= 0, "not at current rate")
        .when(hit > F.lit(month.last), "after month-end")
        .otherwise("projected")
    )
    open_rate = reached.isNull() & (rate > 0)
    return {
        "state": state,
        "date": F.coalesce(reached, F.when(open_rate, hit)),
        "days": F.when(open_rate, days),
    }


def _reached(daily: DataFrame, budget: float) -> DataFrame:
    """Running total over the days of one month, to find the day the budget was used up."""
    in_order = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("running", F.sum("this_month").over(in_order)).withColumn(
        "crossed", F.when((F.lit(budget) > 0) & (F.col("running") >= budget) & F.col("this_month").isNotNull(), F.col("date"))
    )


def month_metrics(
    tasks: DataFrame,
    month: Month,
    budget: float = 0.0,
    orgs: Sequence[str] | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """One row: month to date, daily rates, projection, budget use and the prior month's same span."""
    rows = _scope(tasks, month.prev_start, month.end, orgs, log_type)
    daily = _daily(rows, pricing).select(
        "date",
        F.when(F.col("date") >= F.lit(month.start), F.col("ipus")).alias("this_month"),
        F.when(F.col("date") <= F.lit(month.prev_end), F.col("ipus")).alias("prev_month"),
    )
    zero = F.lit(0).cast("decimal(38,8)")
    sums = _reached(daily, budget).agg(
        F.coalesce(F.sum("this_month"), zero).alias("mtd"),
        F.coalesce(F.sum("prev_month"), zero).alias("prev"),
        _recent(F.col("date"), F.col("this_month")).alias("recent"),
        F.min("crossed").alias("reached"),
    )
    spent, rate = F.col("mtd").cast("double"), F.col("rate")
    outcome = _budget_outcome(budget, spent, rate, F.col("reached"), month)
    return sums.withColumn("rate", _mean(F.col("recent"))).select(
        shown(F.col("mtd")).alias("mtd_ipus"),
        F.round(spent / month.elapsed, 6).alias("avg_daily"),
        F.size("recent").alias("recent_days"),
        F.round(rate, 6).alias("recent_avg"),
        F.lit(month.remaining).alias("days_remaining"),
        F.round(spent + rate * month.remaining, 6).alias("projected_ipus"),
        (F.round(spent / budget * 100, 6) if budget > 0 else F.lit(None).cast("double")).alias("budget_pct"),
        F.round(F.lit(month.elapsed / month.days * 100), 6).alias("expected_pct"),
        shown(F.col("prev")).alias("prev_mtd_ipus"),
        shown(F.col("mtd") - F.col("prev")).alias("delta_vs_prev"),
        outcome["state"].alias("budget_state"),
        outcome["date"].alias("budget_hit_date"),
        outcome["days"].alias("budget_hit_days"),
    )


def day_by_day(
    tasks: DataFrame,
    month: Month,
    budget: float = 0.0,
    orgs: Sequence[str] | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """One row per day of the month so far, zero-filled, with rates, budget pace, the prior month's
    same day and a spike flag."""
    rows = _scope(tasks, month.prev_start, month.end, orgs, log_type)
    this = F.col("date") >= F.lit(month.start)
    per_day_number = (
        _daily(rows, pricing)
        .where(this | (F.col("date") <= F.lit(month.prev_end)))
        .groupBy(F.dayofmonth("date").alias("day_num"))
        .agg(F.sum(F.when(this, F.col("ipus"))).alias("this"), F.sum(F.when(~this, F.col("ipus"))).alias("prev"))
    )
    days = calendar(tasks.sparkSession, month.start, month.end).withColumn("day_num", F.dayofmonth("date"))
    filled = days.join(per_day_number, "day_num", "left").withColumn("x", F.coalesce("this", F.lit(0)).cast("double"))
    whole = Window.partitionBy(F.lit(0))
    newest = F.slice(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("this").isNotNull(), F.struct("date", "x"))).over(whole))), 1, RECENT_DAYS
    )
    mean, std = F.avg("x").over(whole), F.stddev_pop("x").over(whole)
    cut = F.when(mean > 0, mean + F.greatest(std, mean * 0.25)).otherwise(F.lit(0.0))
    pace = F.lit(budget / month.days) if budget > 0 else F.lit(None).cast("double")
    return filled.select(
        "date",
        "day_num",
        F.round("x", 6).alias("total_ipus"),
        F.round(F.sum("x").over(whole) / month.elapsed, 6).alias("avg_daily"),
        F.round(_mean(F.transform(newest, lambda e: e["x"])), 6).alias("recent_avg"),
        F.round(pace, 6).alias("budget_pace"),
        shown(F.coalesce("prev", F.lit(0))).alias("total_ipus_prev"),
        (F.round("x", 6) >= F.round(cut, 6)).alias("spike"),
    ).orderBy("date")


def hottest_days(days: DataFrame, n: int = 5) -> DataFrame:
    return days.select("date", F.bround("total_ipus", 2).alias("total_ipus")).orderBy(F.desc("total_ipus"), "date").limit(n)


def spike_vs_other(
    tasks: DataFrame, days: DataFrame, month: Month, orgs: Sequence[str] | None = None,
    log_type: str | None = None, pricing: Pricing = Pricing(), n: int = 12,
) -> DataFrame:
    """Units per organization on spike days and on other days; ``days`` is the day-by-day frame."""
    daily = _daily(_scope(tasks, month.start, month.end, orgs, log_type), pricing, org_label().alias("org"))
    flagged = daily.join(days.select("date", "spike"), "date")

    def on(flag: Column) -> Column:
        return F.bround(F.coalesce(F.sum(F.when(flag, F.col("ipus"))), F.lit(0)), 2).cast("double")

    sums = flagged.groupBy("org").agg(on(F.col("spike")).alias("spike_days"), on(~F.col("spike")).alias("other_days"))
    return sums.orderBy(F.desc("spike_days"), "org").limit(n)


def family_rollup(tasks: DataFrame, f: TaskFilter, organizations: DataFrame, pricing: Pricing = Pricing()) -> DataFrame:
    """Units per parent, and per family (both log types of one organization) inside it, with
    shares. The parent's own row has no family."""
    orgs = org_stats(tasks, f, pricing).select(base_org(F.col("org")).alias("family"), "total_ipus")
    families = orgs.groupBy("family").agg(exact_sum(F.col("total_ipus")).alias("ipus"))
    levels = (
        parent_of(families, "family", organizations)
        .rollup("parent", "family").agg(F.sum("ipus").alias("ipus"), F.grouping_id().alias("level"))
    )
    all_levels = Window.partitionBy(F.lit(0))
    grand = F.max(F.when(F.col("level") == 3, F.col("ipus"))).over(all_levels)
    of_parent = F.max(F.when(F.col("level") == 1, F.col("ipus"))).over(Window.partitionBy("parent"))

    def share(total: Column) -> Column:
        return F.round(F.col("ipus").cast("double") / F.when(total == 0, 1.0).otherwise(total.cast("double")) * 100, 4)

    return (
        levels.select("parent", "family", "level", shown(F.col("ipus")).alias("total_ipus"),
                      share(grand).alias("pct_total"), share(of_parent).alias("pct_parent"))
        .where(F.col("level") < 3)
        .drop("level")
        .orderBy("parent", F.desc("total_ipus"), "family")
    )


def log_type_mix(
    tasks: DataFrame, start: Day, end: Day, organizations: DataFrame,
    orgs: Sequence[str] | None = None, pricing: Pricing = Pricing(),
) -> DataFrame:
    """Task usage against bulk ingestion per family."""
    rows = _scope(tasks, as_date(start), as_date(end), orgs, None)

    def side(hit: Column) -> Column:
        return exact_sum(eff_ipus(pricing), hit)

    sums = rows.where(log_type_is(TASK) | log_type_is(BULK)).groupBy(base_org(org_label()).alias("family")).agg(
        side(log_type_is(TASK)).alias("task"), side(log_type_is(BULK)).alias("bulk")
    )
    total = F.col("task") + F.col("bulk")

    def pct(part: str) -> Column:
        share = F.col(part).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100
        return F.bround(F.coalesce(share, F.lit(0.0)), 1)

    return parent_of(sums, "family", organizations).select(
        "parent", "family",
        F.bround(F.col("task"), 2).cast("double").alias("task_usage"),
        F.bround(F.col("bulk"), 2).cast("double").alias("bulk_ingestion"),
        F.bround(total, 2).cast("double").alias("total"),
        pct("task").alias("task_pct"), pct("bulk").alias("bulk_pct"),
    ).orderBy(F.desc("total"), "family")


# --- drivers ------------------------------------------------------------------------------

def _driver_rows(
    tasks: DataFrame, start: Day, end: Day, days: Sequence[Day] | None, orgs: Sequence[str] | None, log_type: str | None
) -> DataFrame:
    rows = _scope(tasks, as_date(start), as_date(end), orgs, log_type)
    return rows.where(F.col("end_date").isin([as_date(d) for d in days])) if days else rows


def _driver_sums(pricing: Pricing) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("task_count"),
        exact_sum(eff_ipus(pricing)).alias("ipus"),
        exact_sum(eff_cost(pricing)).alias("cost"),
    ]


def org_drivers(
    tasks: DataFrame, start: Day, end: Day, organizations: DataFrame, days: Sequence[Day] | None = None,
    orgs: Sequence[str] | None = None, log_type: str | None = None, pricing: Pricing = Pricing(),
) -> DataFrame:
    """Units per organization label with the share of its family and of its own log."""
    rows = _driver_rows(tasks, start, end, days, orgs, log_type).groupBy(org_label().alias("org")).agg(*_driver_sums(pricing))
    rows = parent_of(rows.withColumn("family", base_org(F.col("org"))), "family", organizations)
    grand = F.sum("ipus").over(Window.partitionBy(F.lit(0)))  # one row per organization label
    family = F.sum("ipus").over(Window.partitionBy("family"))

    def pct(part: Column) -> Column:
        return F.bround(F.when(grand > 0, part.cast("double") / grand.cast("double") * 100).otherwise(F.lit(0.0)), 1)

    return rows.select(
        "parent", "org", F.bround(F.col("ipus"), 2).cast("double").alias("total_ipus"),
        pct(family).alias("org_pct"), pct(F.col("ipus")).alias("log_pct"),
    ).orderBy("parent", F.desc("org_pct"), F.desc("total_ipus"), "org")


def project_drivers(
    tasks: DataFrame, start: Day, end: Day, days: Sequence[Day] | None = None, orgs: Sequence[str] | None = None,
    log_type: str | None = None, pricing: Pricing = Pricing(), n: int = 15,
) -> DataFrame:
    """Top projects; rows without a project are left out."""
    rows = _driver_rows(tasks, start, end, days, orgs, log_type).where(F.col("project_name").isNotNull())
    sums = rows.groupBy("project_name").agg(*_driver_sums(pricing))
    return sums.select("project_name", "task_count", *_shown_amounts()).orderBy(F.desc("total_ipus"), "project_name").limit(n)


def _shown_amounts() -> list[Column]:
    return [shown(F.col("ipus")).alias("total_ipus"), shown(F.col("cost")).alias("total_cost")]


def task_drivers(
    tasks: DataFrame, start: Day, end: Day, days: Sequence[Day] | None = None, orgs: Sequence[str] | None = None,
    log_type: str | None = None, pricing: Pricing = Pricing(), first: int = 40, n: int = 25,
) -> DataFrame:
    """The ``first`` tasks by units, ordered by their project's total, cut to ``n``."""
    org, project, task = task_keys()
    cells = (
        _driver_rows(tasks, start, end, days, orgs, log_type)
        .groupBy(org, "project_name", task).agg(exact_sum(eff_ipus(pricing)).alias("ipus"))
    )
    per_task = cells.groupBy("org", project, "task_name").agg(F.sum("ipus").alias("ipus"))
    top = per_task.orderBy(F.desc("ipus"), "org", "project_name", "task_name").limit(first)
    top = top.replace({"(No project)": "-"}, subset=["project_name"])
    projects = cells.where(F.col("project_name").isNotNull()).groupBy("project_name").agg(F.sum("ipus").alias("project_ipus"))
    grand = cells.agg(F.coalesce(F.sum("ipus"), F.lit(0)).alias("ipus")).scalar()
    in_top = F.sum("ipus").over(Window.partitionBy("project_name"))
    placed = top.join(projects, "project_name", "left").withColumn("project_ipus", F.coalesce("project_ipus", in_top))
    pct = F.when(grand > 0, F.col("ipus").cast("double") / grand.cast("double") * 100).otherwise(F.lit(0.0))
    return placed.select(
        "org", "project_name", "task_name",
        F.bround(F.col("ipus"), 2).cast("double").alias("task_ipus"),
        F.bround(F.col("project_ipus"), 2).cast("double").alias("project_ipus"),
        F.bround(pct, 1).alias("pct"),
    ).orderBy(F.desc("project_ipus"), F.desc("task_ipus"), "org", "project_name", "task_name").limit(n)


def what_if(
    tasks: DataFrame,
    month: Month,
    budget: float = 0.0,
    orgs: Sequence[str] | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """What each organization, project or task would save if it were cut now, for all of them in
    one job. Spent units still count; only the item's recent rate leaves the projection."""
    rows = _scope(tasks, month.start, month.end, orgs, log_type)
    org, project, task = task_keys()
    cells = _daily(rows, pricing, org, F.when(project == "(No project)", "-").otherwise(project).alias("project_name"), task)

    daily = cells.groupBy("date").agg(F.sum("ipus").alias("this_month"))
    whole = (
        _reached(daily, budget)
        .agg(F.sum("this_month").alias("mtd"), _recent(F.col("date"), F.col("this_month")).alias("recent"),
             F.min("crossed").alias("reached"))
        .select(F.struct(F.coalesce("mtd", F.lit(0)).cast("double").alias("mtd"), _mean(F.col("recent")).alias("rate"), "reached").alias("whole"))
        .scalar()
    )
    nothing = F.lit(None).cast("string")

    def item(kind: str, *columns: Column) -> Column:
        return F.struct(F.lit(kind).alias("cut"), *[c.alias(n) for c, n in zip(columns, ("org", "project_name", "task_name"))])

    items = F.array(
        item("org", F.col("org"), nothing, nothing),
        item("project", nothing, F.col("project_name"), nothing),
        item("task", F.col("org"), F.col("project_name"), F.col("task_name")),
    )
    item_days = (
        cells.select("date", "ipus", F.explode(items).alias("item"))
        .where((F.col("item.cut") != "project") | (F.col("item.project_name") != "-"))
        .groupBy("item", "date").agg(F.sum("ipus").alias("ipus"))
    )
    per_item = item_days.groupBy("item").agg(
        F.sum("ipus").alias("ipus"), _recent(F.col("date"), F.col("ipus")).alias("recent")
    ).select("item.*", "ipus", "recent", _mean(F.col("recent")).alias("item_rate"), whole.alias("whole"))

    spent, left = F.col("whole.mtd"), F.col("new_rate")
    outcome = _budget_outcome(budget, spent, left, F.col("whole.reached"), month)
    return per_item.withColumn("new_rate", F.greatest(F.col("whole.rate") - F.col("item_rate"), F.lit(0.0))).select(
        "cut", "org", "project_name", "task_name",
        shown(F.col("ipus")).alias("item_mtd"),
        F.size("recent").alias("item_recent_days"),
        F.round("item_rate", 6).alias("item_recent_avg"),
        F.round(F.col("item_rate") * month.remaining, 6).alias("remaining_saved"),
        F.round(spent + left * month.remaining, 6).alias("new_projected"),
        outcome["state"].alias("budget_state"),
        outcome["date"].alias("budget_hit_date"),
        outcome["days"].alias("budget_hit_days"),
    ).orderBy("cut", F.desc("item_mtd"), "org", "project_name", "task_name")
