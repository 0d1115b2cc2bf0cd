"""Unusual days, task spikes and what drives them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.pricing import shown, usage
from meterlake.operators.compare import named
from meterlake.operators.filters import Day, TaskFilter, as_date, in_days, log_type_is
from meterlake.operators.stats import daily_stats
from meterlake.schema import Pricing

# Fixed values.
DRIVER_SHARE = 0.35
RUN_CHANGE = 50
FLAT_BASELINE_Z = 99.0
SPIKE_FACTOR = 1.5


def outliers(df: DataFrame, metric: str, threshold: float, skip_flat: bool = True) -> DataFrame:
    """Rows whose sample z-score exceeds the threshold; needs three rows.

    For frames that are already aggregated to one row per day or per run: the window is over all
    of them."""
    every = Window.partitionBy(F.lit(0))
    value = F.col(metric).cast("double")
    scored = df.select(
        "*",
        F.avg(value).over(every).alias("_mean"),
        F.stddev_samp(value).over(every).alias("_std"),
        F.count(F.lit(1)).over(every).alias("_n"),
    )
    scored = scored.where(F.col("_n") >= 3)
    if skip_flat:
        scored = scored.where(F.col("_std") > 0)
    z = (value - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    kind = F.when(F.col("z_score") > threshold, "High").when(F.col("z_score") < -threshold, "Low")
    return (
        scored.withColumn("z_score", F.round(z, 6))
        .withColumn("anomaly_type", kind)
        .where(F.col("anomaly_type").isNotNull())
        .drop("_mean", "_std", "_n")
    )


def daily_anomalies(
    tasks: DataFrame,
    start: Day,
    end: Day,
    metric: str = "total_ipus",
    threshold: float = 2.0,
    org: str | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    daily = daily_stats(tasks, TaskFilter(start, end, org=org, log_type=log_type), pricing)
    return outliers(daily, metric, threshold).orderBy("date")


def task_spikes(
    tasks: DataFrame,
    end: Day,
    lookback_days: int = 90,
    baseline_days: int = 90,
    threshold: float = 3.0,
    min_baseline_days: int = 5,
    top_n: int | None = 10,
    org: str | None = None,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """Task days of the current window far above the same task name's prior baseline.

    Both windows are first reduced to daily task totals; the baseline then to one row per task
    name. Only those totals meet in the join, where AQE splits a hot task name."""
    last = as_date(end)
    first = last - dt.timedelta(days=lookback_days - 1)
    base_last = first - dt.timedelta(days=1)
    base_first = base_last - dt.timedelta(days=baseline_days - 1)

    rows = tasks.where(F.trim("task_name") != "")
    if org:
        rows = rows.where(F.col("org") == org)
    if log_type:
        rows = rows.where(log_type_is(log_type))

    def task_days(start: dt.date, stop: dt.date) -> DataFrame:
        keys = [F.col("end_date").alias("task_date"), *map(F.col, ("task_name", "task_id", "org", "project_name"))]
        used = usage(rows, pricing)
        return rows.where(in_days(rows, start, stop)).groupBy(*keys).agg(
            used.runs().alias("run_count"),
            shown(used.total(used.ipus), 8).alias("daily_ipus"),
            shown(used.total(used.cost), 8).alias("daily_cost"),
        )

    baseline = (
        task_days(base_first, base_last)
        .groupBy("task_name")
        .agg(
            F.count("daily_ipus").alias("baseline_days"),
            F.avg("daily_ipus").alias("mean"),
            F.coalesce(F.stddev_samp("daily_ipus"), F.lit(0.0)).alias("std"),
        )
        .where(F.col("baseline_days") >= min_baseline_days)
    )
    x, mean, std = F.col("daily_ipus"), F.col("mean"), F.col("std")
    limit = mean + F.lit(float(threshold)) * std
    z = F.when(std > 0, (x - mean) / std).when(x > mean, F.lit(FLAT_BASELINE_Z)).otherwise(F.lit(0.0))
    multiple = F.coalesce(x / F.nullif(mean, F.lit(0.0)), F.lit(0.0))
    spikes = (
        task_days(first, last)
        .join(baseline, "task_name")
        .where((x > limit) & (x > mean * SPIKE_FACTOR))
        .select(
            "task_date", "task_name", "task_id", "org", "project_name", "run_count",
            F.round(x, 6).alias("daily_ipus"),
            F.round("daily_cost", 6).alias("daily_cost"),
            "baseline_days",
            F.round(mean, 6).alias("baseline_mean_ipus"),
            F.round(std, 6).alias("baseline_std_ipus"),
            F.round(limit, 6).alias("baseline_threshold"),
            F.round(z, 6).alias("z_score"),
            F.round(multiple, 6).alias("multiplier_vs_baseline"),
        )
        .orderBy(F.desc("z_score"), F.desc("daily_ipus"), "task_date", "task_name", "task_id", "org", "project_name")
    )
    return spikes.limit(top_n) if top_n else spikes


TASK_KEY = ["org", "project_name", "task_name"]


def task_history(tasks: DataFrame, keys: DataFrame, start: Day, end: Day, pricing: Pricing = Pricing()) -> DataFrame:
    """Units and runs per day of the given (org, project_name, task_name[, task_id]) keys."""
    on = [*TASK_KEY, "task_id"] if "task_id" in keys.columns else TASK_KEY
    rows = named(tasks.where(in_days(tasks, start, end)))
    used = usage(rows, pricing)
    daily = rows.groupBy(F.col("end_date").alias("date"), *on).agg(
        used.total(used.ipus).alias("total_ipus"), used.runs().alias("runs")
    )
    wanted = keys.select(*[F.coalesce(c, F.lit("(Unknown)")).alias(c) if c != "task_id" else F.col(c) for c in on])
    found = daily.join(wanted.distinct(), on, "left_semi")
    return found.withColumn("total_ipus", shown(F.col("total_ipus"))).orderBy(*on, "date")


def spike_kind(changes: DataFrame, history: DataFrame) -> DataFrame:
    """Whether a task's change comes from more runs or from more units, and its size.

    ``changes`` has the task key and optionally delta_ipus and delta_runs; ``history`` has daily
    units and runs of those tasks."""
    for c in ("delta_ipus", "delta_runs"):
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast("double"))
    shape = history.groupBy(*TASK_KEY).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("total_ipus", "runs") for n, f in (("peak", F.max), ("mean", F.avg))]
    )

    def multiple(c: str) -> Column:
        peak, mean = F.col(f"peak_{c}").cast("double"), F.col(f"mean_{c}")
        return F.when(mean > 0, peak / mean).otherwise(F.greatest(peak, F.lit(0.0)))

    by_runs = F.coalesce(F.abs("delta_runs") > RUN_CHANGE, F.lit(False)) | (multiple("runs") > multiple("total_ipus"))

    def size(delta: str, c: str) -> Column:
        return F.coalesce(F.col(delta).cast("double"), F.col(f"peak_{c}") - F.col(f"mean_{c}"))

    value = F.when(F.col("kind") == "runs", size("delta_runs", "runs")).otherwise(size("delta_ipus", "total_ipus"))
    return (
        changes.join(shape, TASK_KEY)
        .withColumn("kind", F.when(by_runs, "runs").otherwise("ipus"))
        .withColumn("spike_value", F.round(value, 6))
        .withColumn("direction", F.when(F.col("spike_value") >= 0, "up").otherwise("down"))
        .select(*TASK_KEY, "kind", "direction", "spike_value")
        .orderBy("kind", F.desc("direction"), F.desc(F.abs("spike_value")), *TASK_KEY)
    )


def anomaly_drivers(tasks: DataFrame, days: DataFrame, start: Day, end: Day, pricing: Pricing = Pricing()) -> DataFrame:
    """Largest project or task of each given day, where it has a large enough share of the day.

    The project wins a tie, and the smaller of the two is not tried."""
    rows = named(tasks.where(in_days(tasks, start, end)))
    wanted = days.select(F.col("date").alias("end_date")).distinct()
    used = usage(rows, pricing)
    cells = (
        rows.groupBy("end_date", "project_name", "task_name")
        .agg(used.total(used.ipus).alias("ipus"))
        .join(wanted, "end_date", "left_semi")
    )
    sides = F.array(
        F.struct(F.lit("project").alias("kind"), F.trim("project_name").alias("name")),
        F.struct(F.lit("task").alias("kind"), F.trim("task_name").alias("name")),
    )
    best = (
        cells.select("end_date", "ipus", F.inline(sides))
        .groupBy("end_date", "kind", "name").agg(F.sum("ipus").alias("ipus"))
        .groupBy("end_date")
        .agg(
            *[
                F.min(F.when(F.col("kind") == k, F.struct((-F.col("ipus")).alias("minus"), "name"))).alias(k)
                for k in ("project", "task")
            ],
            F.sum(F.when(F.col("kind") == "project", F.col("ipus"))).alias("day_ipus"),
        )
        .select(
            "end_date", "day_ipus",
            *[c for k in ("project", "task") for c in (F.col(f"{k}.name").alias(f"{k}_name"), (-F.col(f"{k}.minus")).alias(f"{k}_ipus"))],
        )
    )
    project_leads = F.col("project_ipus") >= F.col("task_ipus")
    ipus = F.greatest("project_ipus", "task_ipus")
    share = ipus.cast("double") / F.nullif(F.col("day_ipus").cast("double"), F.lit(0.0))
    reported = (F.col("day_ipus") > 0) & (share >= DRIVER_SHARE)
    return best.select(
        F.col("end_date").alias("date"),
        shown(F.col("day_ipus")).alias("day_ipus"),
        F.when(reported, F.when(project_leads, "project").otherwise("task")).alias("driver_kind"),
        F.when(reported, F.when(project_leads, F.col("project_name")).otherwise(F.col("task_name"))).alias("driver_name"),
        F.when(reported, shown(ipus)).alias("driver_ipus"),
    ).orderBy("date")
