"""Date series: calendars, ranges, coverage and running totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import display_date, display_range, iso_range, log_type_label, org_label
from meterlake.functions.pricing import eff_ipus, exact_sum, shown
from meterlake.operators.filters import Day, TaskFilter, as_date, in_days, log_type_is
from meterlake.schema import Pricing


def calendar(spark: SparkSession, start: Day, end: Day) -> DataFrame:
    """One row per day, both ends included; empty if the start is after the end."""
    first, days = as_date(start), (as_date(end) - as_date(start)).days + 1
    return spark.range(max(days, 0)).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))


def islands(dates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive days per key from a frame of distinct (keys, date): one row per run.

    A window holds one key's distinct days, so its size is bounded by the calendar."""
    in_order = Window.partitionBy(*keys).orderBy("date")
    run = F.date_sub(F.col("date"), F.row_number().over(in_order))
    return (
        dates.withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(F.min("date").alias("range_start"), F.max("date").alias("range_end"))
        .drop("_run")
    )


def joined_ranges(text: Column, start: Column) -> Column:
    """Aggregate: range texts in date order, joined by "; "."""
    pairs = F.array_sort(F.collect_list(F.struct(start.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(pairs, lambda p: p["text"]), "; ")


def date_summary(df: DataFrame) -> DataFrame:
    """First day, last day and label of all days in a batch. Days are of the end time, or of the
    start time where no row has an end time. No row if there is no day at all."""
    any_end = df.agg(F.count("end_time").alias("n")).select(F.col("n") > 0).scalar()
    day = F.when(any_end, F.to_date("end_time")).otherwise(F.to_date("start_time"))
    days = df.select(day.alias("date")).where(F.col("date").isNotNull()).distinct()
    return (
        islands(days)
        .agg(
            F.min("range_start").alias("start_date"),
            F.max("range_end").alias("end_date"),
            joined_ranges(iso_range(F.col("range_start"), F.col("range_end")), F.col("range_start")).alias("label"),
        )
        .where(F.col("start_date").isNotNull())
    )


def missing_ranges(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    """Runs of days inside the window without any task row."""
    window = TaskFilter(f.start, f.end, org=f.org, project=f.project, environment=f.environment, log_type=f.log_type)
    seen = window.apply(tasks).select(F.col("end_date").alias("date")).distinct()
    holes = islands(calendar(tasks.sparkSession, f.start, f.end).join(seen, "date", "left_anti"))
    label = display_range(F.col("range_start"), F.col("range_end"))
    return holes.select("range_start", "range_end", label.alias("label")).orderBy("range_start")


def coverage_gaps(tasks: DataFrame, start: Day, end: Day, log_type: str | None = None) -> DataFrame:
    """Holes inside each organization and log type's own first-to-last span.

    The next observed day tells where a hole ends, so no calendar is built per key."""
    rows = tasks.where(in_days(tasks, start, end))
    if log_type:
        rows = rows.where(log_type_is(log_type))
    days = rows.select(
        org_label().alias("org"), log_type_label().alias("log_type"), F.col("end_date").alias("date")
    ).distinct()
    following = F.lead("date").over(Window.partitionBy("org", "log_type").orderBy("date"))
    steps = days.withColumn("_days_out", F.datediff(following, F.col("date")) - 1).withColumn("_next", following)
    hole = F.col("_days_out") > 0
    first_missing, last_missing = F.date_add("date", 1), F.date_sub("_next", 1)
    texts = joined_ranges(F.when(hole, display_range(first_missing, last_missing)), F.col("date"))
    return (
        steps.groupBy("org", "log_type")
        .agg(
            display_date(F.min("date")).alias("first_date"),
            display_date(F.max("date")).alias("last_date"),
            F.count(F.lit(1)).alias("days_present"),
            F.coalesce(F.sum(F.when(hole, F.col("_days_out"))), F.lit(0)).cast("long").alias("days_missing"),
            F.count(F.when(hole, 1)).alias("gap_count"),
            texts.alias("missing_ranges"),
        )
        .orderBy(F.desc("days_missing"), "org", "log_type")
    )


def cumulative_by_org(tasks: DataFrame, start: Day, end: Day) -> DataFrame:
    """Running stored units per organization on every observed day, flat where an organization
    has no rows. Each value is carried over the days up to the organization's next one; a
    semi-join keeps the observed days."""
    rows = tasks.where(in_days(tasks, start, end) & F.col("org").isNotNull())
    daily = rows.groupBy(F.to_date("end_time").alias("date"), "org").agg(exact_sum(F.col("ipus")).alias("ipus"))
    in_order = Window.partitionBy("org").orderBy("date")
    running = F.sum("ipus").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = daily.select(
        "org", "date", running.alias("running"), F.lead("date").over(in_order).alias("next"),
        F.row_number().over(in_order).alias("nth"),
    )
    until = F.coalesce(F.date_sub("next", 1), F.lit(as_date(end)))
    carried = F.transform(F.sequence("date", until), lambda d: F.struct(d.alias("date"), F.col("running").alias("ipus")))
    lead_in = F.when(
        (F.col("nth") == 1) & (F.col("date") > F.lit(as_date(start))),
        F.transform(
            F.sequence(F.lit(as_date(start)), F.date_sub("date", 1)),
            lambda d: F.struct(d.alias("date"), F.lit(0).cast("decimal(38,8)").alias("ipus")),
        ),
    ).otherwise(F.array())
    filled = steps.select("org", F.inline(F.concat(lead_in, carried)))
    observed = daily.select("date").distinct()
    return (
        filled.join(observed, "date", "left_semi")
        .select("date", "org", shown(F.col("ipus")).alias("cumulative_ipus"))
        .orderBy("org", "date")
    )


def weekly_trend(
    tasks: DataFrame, anchor: Day, weeks: int = 6, pricing: Pricing = Pricing(), log_type: str | None = None, orgs: DataFrame | None = None
) -> DataFrame:
    """Units per organization and Monday week over the last weeks, zero where there is no row, of all
    rows or of one log type. Organizations of ``orgs`` (column org), such as those of a comparison
    beside it, are listed too, with zeros if they have no row."""
    last = as_date(anchor)
    monday = last - dt.timedelta(days=last.weekday())
    first = monday - dt.timedelta(days=7 * (weeks - 1))
    org = F.when(F.trim("org") != "", F.trim("org")).otherwise(F.lit("(Unknown)")).alias("org")
    if log_type:
        tasks = tasks.where(log_type_is(log_type))
    week = F.to_date(F.date_trunc("week", "end_time")).alias("week_start")
    sums = (
        tasks.where(in_days(tasks, first, last))
        .groupBy(org, week).agg(exact_sum(eff_ipus(pricing)).alias("ipus"))
        .groupBy("org").agg(F.map_from_entries(F.collect_list(F.struct("week_start", "ipus"))).alias("by_week"))
    )
    if orgs is not None:
        listed = orgs.select(org).distinct().join(sums, "org", "left_anti")
        sums = sums.unionByName(listed.select("org", F.lit(None).cast(sums.schema["by_week"].dataType).alias("by_week")))
    starts = F.sequence(F.lit(first), F.lit(monday), F.expr("interval 7 days"))
    grid = sums.select("org", "by_week", F.explode(starts).alias("week_start"))
    total = F.coalesce(F.try_element_at("by_week", F.col("week_start")), F.lit(0))
    return grid.select("org", "week_start", shown(total).alias("total_ipus")).orderBy("org", "week_start")
