"""Text reports as DataFrames of lines.

A line has a section number and sort keys, so a report is a union of line frames under one sort;
nothing is numbered one by one and no text is assembled on the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import arrow, display_date, display_range, grouped, org_label, signed
from meterlake.operators import anomalies as A
from meterlake.operators import compare as C
from meterlake.operators.cells import daily_cells, kept
from meterlake.operators.filters import Day, TaskFilter, as_date, log_type_is
from meterlake.operators.series import coverage_gaps, missing_ranges
from meterlake.schema import Pricing

SPIKE_HISTORY = 180  # days of the spike watch: 90 current, 90 before
LINE = ["section", "rank", "place", "name", "line_no", "text"]
# Titles of the periods, and lines of the executive report that are always the same.
PERIOD_TITLES = {
    "weekly": "Weekly Change", "monthly_30d": "Monthly Change (Rolling 30 Days)",
    "monthly_calendar": "Monthly Change (Calendar Month)", "quarterly": "Quarterly Change",
}
SUMMARY = [
    "Summary", "- Plain-language summary of week, month, and quarter trends across organizations and projects.",
    "- Focused on high-impact shifts and notable spikes.",
]
ACTIONS = [
    "Recommended Actions", "- Validate top increasing orgs/projects for planned growth versus unexpected activity.",
    "- Review anomaly days against release schedules, incidents, and backfills.",
    "- Investigate top task spikes for retry loops, schedule drift, or configuration changes.",
]
CHANGE_TITLES = {"Past week": "Past Week", "Past calendar month": "Month-to-date", "Past 30 days": "Past 30 Days"}


def lines(df: DataFrame, section: int, text: Column, rank=0, place=0.0, name: Column | str = "", line_no=0) -> DataFrame:
    def value(v, kind: str) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return df.select(
        F.lit(section).alias("section"), value(rank, "int").alias("rank"), value(place, "double").alias("place"),
        value(name, "string").alias("name"), value(line_no, "int").alias("line_no"), text.alias("text"),
    )


def fixed(spark: SparkSession, section: int, text: str, rank: int = 0, line_no: int = 0) -> DataFrame:
    return lines(spark.range(1), section, F.lit(text), rank=rank, line_no=line_no)


def otherwise(rows: DataFrame, section: int, text: str, rank: int = 1) -> DataFrame:
    """One line instead of an empty list."""
    empty = rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("n") == 0).scalar()
    return lines(rows.sparkSession.range(1).where(empty), section, F.lit(text), rank=rank)


def report(parts: Sequence[DataFrame]) -> DataFrame:
    """One sorted frame. Pairs are united first, so that no part is analyzed once per other part."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2])
        parts = [a.union(b) for a, b in pairs] + parts[len(parts) // 2 * 2:]
    return parts[0].orderBy(*LINE[:-1], "text")


def of_log_type(tasks: DataFrame, log_type: str | None) -> DataFrame:
    return tasks.where(log_type_is(log_type)) if log_type else tasks


def _short(day: dt.date) -> str:
    return f"{day:%b} {day.day}"


def _total_lines(tasks: DataFrame, periods: Sequence[C.Period], pricing: Pricing) -> DataFrame:
    against = {"Past week": "previous week", "Past calendar month": "previous period", "Past 30 days": "previous 30-day period"}
    heads = [f"{p.name} ({_short(p.start)} - {_short(p.end)}): total IPUs " for p in periods]
    wide = C.changes(tasks, [], periods, pricing)
    head = F.element_at(F.array(*map(F.lit, heads)), F.col("period_no") + 1)
    versus = F.element_at(F.array(*[F.lit(against[p.name]) for p in periods]), F.col("period_no") + 1)
    text = F.concat(
        head, grouped(F.col("ipus_cur")), F.lit(" -> "), versus, F.lit(" "), grouped(F.col("ipus_prev")),
        F.lit(" ("), arrow(F.col("delta_ipus")), F.lit(")"),
    )
    return lines(wide, 1, text, rank=F.col("period_no"))


def _dimension_lines(compared: DataFrame, dimension: str, title: str, section: int) -> list[DataFrame]:
    rows = compared.where(F.col("dimension") == dimension)
    text = F.concat(
        F.lit("  "), F.col("period"), F.lit(": "), grouped(F.col("ipus_cur")), F.lit(" IPUs -> "),
        grouped(F.col("ipus_prev")), F.lit(" previous ("), F.col("change"), F.lit(")"),
    )
    heads = rows.where(F.col("period_no") == 0)
    return [
        fixed(rows.sparkSession, section, f"{title} comparison:"),
        lines(heads, section, F.concat(F.lit(f"{title}: "), F.col("value")), rank=1, name=F.col("value")),
        lines(rows, section, text, rank=1, name=F.col("value"), line_no=F.col("period_no") + 1),
    ]


def _with_titles(rows: DataFrame) -> DataFrame:
    return rows.replace(CHANGE_TITLES, subset=["period"])


def _project_lines(rows: DataFrame, section: int) -> list[DataFrame]:
    text = F.concat(
        F.lit("- "), F.col("period"), F.lit(": "), F.col("org"), F.lit(" / "), F.col("project_name"), F.lit(" IPUs "),
        F.format_string("%.2f -> %.2f", "ipus_prev", "ipus_cur"), F.lit(" ("), arrow(F.col("delta_ipus")), F.lit(")"),
    )
    return [
        fixed(rows.sparkSession, section, "Project anomalies:"),
        lines(_with_titles(rows), section, text, rank=F.col("period_no") + 1, place=-F.abs("delta_ipus")),
        otherwise(rows, section, "- None detected"),
    ]


def _task_lines(rows: DataFrame, section: int) -> list[DataFrame]:
    """Changes (up, then down) and then starts and stops, each by period."""
    spark = rows.sparkSession
    rows = _with_titles(rows)
    text = F.concat(
        F.lit("      - "), F.concat_ws(" / ", "org", "project_name", "task_name"),
        F.format_string(" IPUs %.2f -> %.2f (", "ipus_prev", "ipus_cur"), arrow(F.col("delta_ipus")),
        F.format_string("), Runs %d -> %d (", "runs_prev", "runs_cur"), arrow(F.col("delta_runs"), 0), F.lit(")"),
    )
    group = F.when(F.col("change_type") == "Changes", F.col("direction")).otherwise(F.col("change_type"))
    place = F.when(group.isin("up", "Starts"), 1).otherwise(2)
    title = (
        F.when(group == "up", "    - Going up").when(group == "down", "    - Going down")
        .otherwise(F.concat(F.lit("    - "), group))
    )
    grouped_rows = rows.withColumns({"title": title, "nth": place}).where(group != "flat")
    parts = [fixed(spark, section, "Task anomalies:")]
    for offset, head, chosen in (
        (0, "- Changes", F.col("change_type") == "Changes"),
        (1, "- Starts and stops", F.col("change_type") != "Changes"),
    ):
        mine = grouped_rows.where(chosen)
        at = section + offset

        def rank(nth: Column) -> Column:
            return 10 + F.col("period_no") * 3 + nth

        parts += [
            fixed(spark, at, head, rank=1),
            lines(mine.select("period_no", "period").distinct(), at, F.concat(F.lit("  - "), F.col("period")), rank=rank(F.lit(0))),
            lines(mine.select("period_no", "title", "nth").distinct(), at, F.col("title"), rank=rank(F.col("nth")), place=-1e300),
            lines(mine, at, text, rank=rank(F.col("nth")), place=-F.abs("delta_ipus")),
            otherwise(mine, at, "  - None detected", rank=2),
        ]
    return parts


def _spike_lines(spikes: DataFrame, section: int, title: str, shown_rows: int = 5) -> list[DataFrame]:
    spark = spikes.sparkSession
    counted = spikes.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    text = F.concat(
        F.lit("  - "), display_date(F.col("task_date")), F.lit(": "), F.col("task_name"), F.lit(" in "),
        F.coalesce("org", F.lit("")), F.lit(" / "), F.coalesce("project_name", F.lit("")),
        F.format_string(" ran materially above baseline (about %.1fx).", "multiplier_vs_baseline"),
    )
    first = spikes.orderBy(F.desc("z_score"), F.desc("daily_ipus"), "task_date", "task_name", "task_id").limit(shown_rows)
    return [
        fixed(spark, section, title),
        lines(counted, section, F.concat(F.lit("- "), F.col("n").cast("string"), F.lit(" task spike(s) flagged. Top items:")), rank=1),
        lines(first, section, text, rank=2, place=-F.col("z_score")),
        otherwise(spikes, section, "- No task showed a major spike versus prior baseline."),
    ]


def narrative(
    tasks: DataFrame,
    anchor: Day,
    show: Sequence[str] = ("Past week",),
    whole_months: bool = False,
    show_environment: bool = True,
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """Narrative summary of the chosen periods: totals, comparisons by dimension, changed projects
    and tasks, and task spikes."""
    periods = [p for p in C.report_periods(anchor, whole_months) if p.name in show]
    first = min(p.prev_start for p in periods)
    tasks = kept(daily_cells(tasks, first, max(p.end for p in periods), pricing), "report-cells")
    compared = kept(C.period_compare(tasks, periods, pricing, log_type), "report-dimensions")
    parts = [_total_lines(of_log_type(tasks, log_type), periods, pricing)]
    parts += _dimension_lines(compared, "log_type", "Log type", 2)
    parts += _dimension_lines(compared, "org", "Organization", 3)
    if show_environment:
        parts += _dimension_lines(compared, "environment", "Environment", 4)
    parts += _project_lines(kept(C.project_changes(tasks, periods, pricing, log_type), "report-projects"), 5)
    parts += _task_lines(kept(C.task_changes(tasks, periods, pricing, log_type), "report-tasks"), 6)
    titles = {"Past week": "Past Week", "Past calendar month": "Month", "Past 30 days": "Rolling Month"}
    for i, p in enumerate(periods):
        days = (p.end - p.start).days + 1
        spikes = kept(A.task_spikes(tasks, p.end, days, days, log_type=log_type, pricing=pricing), "report-spikes")
        parts += _spike_lines(spikes, 8 + i, f"Task Spikes ({titles[p.name]}):")
    return report(parts)


def executive(
    tasks: DataFrame,
    anchor: Day,
    today: Day,
    include: Sequence[str] = ("weekly", "monthly_calendar"),
    log_type: str | None = None,
    pricing: Pricing = Pricing(),
) -> DataFrame:
    """Executive trend report: workload, units and totals per period, movers, the split by
    organization, unusual days with their driver, task spikes, and what to do."""
    spark = tasks.sparkSession
    end = as_date(anchor)
    first = end - dt.timedelta(days=SPIKE_HISTORY - 1)
    tasks = of_log_type(tasks, log_type)
    tasks = kept(daily_cells(tasks, min(first, *(p.prev_start for p in C.executive_periods(anchor, today))), end, pricing), "report-cells")
    parts = [
        fixed(spark, 0, "Usage Executive Trend Report"),
        lines(spark.range(1), 0, F.concat(F.lit("Data through "), display_date(F.lit(end))), rank=1),
        *[fixed(spark, 0, text, rank=2, line_no=i) for i, text in enumerate(SUMMARY)],
    ]
    for i, p in enumerate(p for p in C.executive_periods(anchor, today) if p.name in include):
        section = 10 * (i + 1)
        window = F.concat(
            F.lit(f"- {period_title(p)}: "), display_range(F.lit(p.start), F.lit(p.end)),
            F.lit(" (vs "), display_range(F.lit(p.prev_start), F.lit(p.prev_end)), F.lit(")."),
        )
        whole = C.shown_changes(C.changes(tasks, [], [p], pricing))
        workload = F.format_string("  - Workload: %,d → %,d tasks (%+,d).", "runs_prev", "runs_cur", "delta_runs")
        usage = F.concat(
            F.lit("  - IPU usage: "), grouped(F.col("ipus_prev")), F.lit(" → "), grouped(F.col("ipus_cur")),
            F.lit(" ("), signed(F.col("delta_ipus")), F.lit(")."),
        )
        totals = F.concat(F.format_string("  - Totals: %,d tasks, ", "runs_cur"), grouped(F.col("ipus_cur")), F.lit(" total IPUs."))
        parts += [
            fixed(spark, section, PERIOD_TITLES[p.name]), *_month_lines(whole, p, section), lines(whole, section, window, rank=2),
            lines(whole, section, workload, rank=3), lines(whole, section, usage, rank=4), lines(whole, section, totals, rank=5),
        ]
        for j, (key, word) in enumerate((("org", "Organizations"), ("project_name", "Projects"))):
            moved = C.movers(C.window_changes(tasks, [_mover_key(key)], p, pricing), key).where(F.col(key).isNotNull())
            placed = F.array_sort(F.collect_list(F.struct("place", F.col(key).cast("string").alias("name"), "direction")))
            texts = [
                F.struct(F.lit(2 * j + k).alias("nth"), F.concat(
                    F.lit(f"- {word} trending {direction}: "), _names_or_none(F.col("placed"), direction), F.lit("."),
                ).alias("text"))
                for k, direction in enumerate(("up", "down"))
            ]
            nothing = F.struct(F.lit(2 * j).alias("nth"), F.lit(f"- {word}: no data in either comparison window.").alias("text"))
            any_rows = whole.select(F.col("runs_cur") + F.col("runs_prev") > 0).scalar()
            listed = moved.agg(placed.alias("placed")).select(F.inline(F.when(any_rows, F.array(*texts)).otherwise(F.array(nothing))))
            parts.append(lines(listed, section + 1, F.col("text"), rank=F.col("nth")))
        parts += _org_split_lines(tasks, p, section + 2, pricing)
    start = end - dt.timedelta(days=89)
    parts += _anomaly_lines(tasks, start, end, 90, pricing)
    parts += _spike_lines(kept(A.task_spikes(tasks, end, pricing=pricing), "report-spikes"), 91, "Task Spike Watch")
    return report([*parts, *[fixed(spark, 92, text, line_no=i) for i, text in enumerate(ACTIONS)]])


def period_title(p: C.Period) -> str:
    """Name of a period, with the month or quarter that it is a part of."""
    titles = {
        "weekly": "Past Week", "monthly_30d": "Last 30 Days", "monthly_calendar": f"Month to Date ({p.start:%B} {p.start.year})",
        "quarterly": f"Quarter to Date (Q{(p.start.month + 2) // 3} {p.start.year})",
    }
    return titles[p.name]


def _month_lines(whole: DataFrame, p: C.Period, section: int) -> list[DataFrame]:
    """Headline of the calendar month; other periods have none."""
    if p.name != "monthly_calendar":
        return []
    way = F.when(F.col("delta_ipus") >= 0, " IPU increase").otherwise(" IPU decrease")
    text = F.concat(grouped(F.abs("delta_ipus")), way, F.lit(f" from {p.prev_start:%b} to {p.start:%b}"))
    return [fixed(whole.sparkSession, section, f"{p.start:%B} Change Report", rank=1), lines(whole, section, text, rank=1, line_no=1)]


def _names_or_none(placed: Column, direction: str) -> Column:
    names = F.transform(F.filter(placed, lambda x: x["direction"] == direction), lambda x: x["name"])
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("none material"))


def _mover_key(key: str) -> Column:
    return org_label().alias("org") if key == "org" else F.col(key)


def _org_split_lines(tasks: DataFrame, p: C.Period, section: int, pricing: Pricing) -> list[DataFrame]:
    tasks = tasks.withColumn("org", org_label())
    orgs = C.window_changes(tasks, ["org"], p, pricing)
    used = orgs.where((F.col("ipus_cur") != 0) | (F.col("ipus_prev") != 0))
    direction = F.when(F.col("delta_ipus") >= 0, "Increased").otherwise("Decreased")
    heads = lines(
        used, section,
        F.concat(F.lit("- "), F.col("org"), F.lit(": "), direction, F.lit(" "), grouped(F.abs("delta_ipus")), F.lit(" IPUs")),
        place=-F.col("delta_ipus"), name=F.col("org"),
    )
    detail = C.org_top_changes(tasks, p, pricing, rate_moved=True).join(used.select("org", F.col("delta_ipus").alias("org_delta")), "org")
    changed = F.when(F.col("delta_ipus") >= 0, "increased").otherwise("decreased")
    runs = (
        F.when(F.col("delta_runs") > 0, F.format_string("up %+,d runs (%d → %d)", "delta_runs", "runs_prev", "runs_cur"))
        .when(F.col("delta_runs") < 0, F.format_string("down %+,d runs (%d → %d)", "delta_runs", "runs_prev", "runs_cur"))
        .otherwise(F.format_string("flat at %d runs", "runs_cur"))
    )
    rates = [_per_run(F.col("ipus_per_run_prev")), _per_run(F.col("ipus_per_run_cur"))]
    tiny = F.when((rates[0] == rates[1]) & F.col("rate_moved"), " (tiny change)").otherwise("")
    task_texts = [
        F.concat(F.lit("    - "), F.col("name"), F.lit(": "), runs),
        F.concat(F.lit("      - IPUs: "), grouped(F.col("ipus_prev")), F.lit(" → "), grouped(F.col("ipus_cur")),
                 F.lit(" ("), signed(F.col("delta_ipus")), F.lit(")")),
        F.concat(F.lit("      - IPU/run: "), rates[0], F.lit(" → "), rates[1], tiny),
    ]
    project_text = F.concat(F.lit("  - "), F.col("name"), F.lit(": "), changed, F.lit(" "), grouped(F.abs("delta_ipus")), F.lit(" IPUs"))

    def numbered(nth: Column, text: Column) -> Column:
        return F.struct(nth.alias("nth"), text.alias("text"))

    texts = F.when(F.col("kind") == "project", F.array(numbered(F.lit(1), project_text))).otherwise(
        F.array(*[numbered(F.col("place") * 10 + i, t) for i, t in enumerate(task_texts)])
    )
    detail_lines = detail.select("org", "org_delta", F.inline(texts))
    none = otherwise(orgs, section, "- No organization-level changes found for this period.", rank=0)
    return [none, heads, lines(detail_lines, section, F.col("text"), place=-F.col("org_delta"), name=F.col("org"), line_no=F.col("nth"))]


def _per_run(rate: Column) -> Column:
    """A rate with as many places as its size needs."""
    size = F.abs(rate)
    return (
        F.when(size == 0, "0").when(size >= 0.01, F.format_string("%.3f", rate))
        .when(size >= 0.0001, F.format_string("%.6f", rate)).otherwise(F.format_string("%.2e", rate))
    )


def _anomaly_lines(tasks: DataFrame, start: dt.date, end: dt.date, section: int, pricing: Pricing) -> list[DataFrame]:
    days = kept(A.daily_anomalies(tasks, start, end, pricing=pricing), "report-days")
    top = days.orderBy(F.desc("z_score"), "date").limit(3)
    drivers = A.anomaly_drivers(tasks, top, start, end, pricing)
    listed = top.join(drivers, "date", "left")
    driver = F.when(
        F.col("driver_kind").isNotNull(),
        F.concat(F.lit(" Primary driver: "), F.col("driver_kind"), F.lit(" "), F.col("driver_name"), F.lit(" ("),
                 grouped(F.col("driver_ipus")), F.lit(" IPUs).")),
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("  - "), display_date(F.col("date")), F.lit(" ("), F.col("anomaly_type"), F.lit("): "),
        grouped(F.col("total_ipus")), F.lit(" IPUs."), driver,
    )
    counted = days.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    head = F.concat(F.lit("- total_ipus: "), F.col("n").cast("string"), F.lit(" unusual day(s) detected. Dates to review:"))
    return [
        fixed(tasks.sparkSession, section, "Potential Anomalies"),
        lines(counted, section, head, rank=1),
        lines(listed, section, text, rank=2, place=-F.col("z_score")),
        otherwise(days, section, "- total_ipus: no unusual pattern detected."),
    ]


def coverage_message(tasks: DataFrame, start: Day, end: Day, log_type: str | None = None) -> DataFrame:
    """Coverage lines: global gaps (first 5 and how many more) and organizations with gaps
    (first 8 and how many more)."""
    gaps = missing_ranges(tasks, TaskFilter(start, end, log_type=log_type))
    holes = coverage_gaps(tasks, start, end, log_type).where(F.col("days_missing") > 0)
    scope = f" ({log_type})" if log_type else ""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("range_start", "label"))), lambda g: g["label"])
    summed = gaps.agg(F.count(F.lit(1)).alias("n"), in_order.alias("labels"))
    hidden = F.col("n") - 5
    more = F.when(hidden > 0, F.concat(F.lit(" and "), hidden.cast("string"), F.lit(" more gap(s)"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"Missing data detected{scope} on "), F.col("n").cast("string"), F.lit(" global gap(s): "),
        F.array_join(F.slice("labels", 1, 5), ", "), more, F.lit("."),
    )
    any_hole = holes.agg(F.count(F.lit(1)).alias("holes")).scalar()
    complete = (
        F.when(any_hole > 0, F.lit("Every calendar day has at least some data, but individual organizations still have gaps."))
        .otherwise(F.lit(f"No missing days detected{f' for {log_type}' if log_type else ''} across the full available date span."))
    )
    sample = F.when(F.length("missing_ranges") > 90, F.concat(F.substring("missing_ranges", 1, 87), F.lit("..."))).otherwise(F.col("missing_ranges"))
    org_text = F.concat(
        F.lit("- "), F.col("org"), F.lit(" ("), F.col("log_type"), F.lit("): has "), F.col("first_date"), F.lit(" → "), F.col("last_date"),
        F.lit(", missing "), F.col("days_missing").cast("string"), F.lit(" day(s) in "), F.col("gap_count").cast("string"),
        F.lit(" gap(s) — "), sample,
    )
    first = holes.orderBy(F.desc("days_missing"), "org", "log_type").limit(8)
    rest = holes.agg((F.count(F.lit(1)) - 8).alias("n")).where(F.col("n") > 0)
    rest_text = F.concat(F.lit("…and "), F.col("n").cast("string"), F.lit(" more org/log-type combination(s) with gaps."))
    return report([
        lines(summed, 1, F.when(F.col("n") > 0, head).otherwise(complete)),
        lines(first, 2, org_text, place=-F.col("days_missing"), name=F.concat("org", "log_type")),
        lines(rest, 3, rest_text),
    ])
