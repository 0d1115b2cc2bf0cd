"""From raw log cells to priced task rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import pricing as P
from meterlake.functions.cells import (
    fill_missing, is_missing, number, text_number_or_zero, with_full_start, with_timestamps,
)
from meterlake.functions.identity import row_hash
from meterlake.functions.labels import base_org, bulk_org, is_bulk_org
from meterlake.schema import BULK, BULK_SUFFIX, STANDARD_COLUMNS, TASK, TASKS_SCHEMA, Pricing

# Header spellings (trimmed, lower case) of each standard column.
HEADER_SPELLINGS = {
    "Task ID": ["taskid", "task id"],
    "Task Name": ["taskname", "task name"],
    "Task Object Name": ["taskobjectname", "task object name"],
    "Task Type": ["tasktype", "task type"],
    "Task Run ID": ["taskrunid", "task run id", "job name"],
    "Agent Name": ["agent name"],
    "Project Name": ["projectname", "project name"],
    "Folder Name": ["foldername", "folder name"],
    "Org ID": ["orgid", "org id"],
    "Environment": ["environment name", "environment", "environement", "runtime environment"],
    "Environment ID": ["environmentid", "environment id"],
    "Cores Used": ["coresused", "cores used"],
    "Start Time": ["starttime", "start time", "job start time (utc)"],
    "End Time": ["endtime", "end time", "job end time (utc)"],
    "Metered Value": ["meteredvalue", "metered value", "volume (gbs)"],
    "Utilization (Bytes)": ["utilization(bytes)", "utilization (bytes)"],
    "Metering Date (UTC)": ["metering date (utc)"],
    "Date": ["date"],
    "Audit Time": ["audittime", "audit time"],
    "OBM Task Time(s)": ["obmtasktime(s)", "obm task time(s)"],
}
# Headers that only task-usage logs have.
TASK_HEADERS = {
    "task object name", "cores used", "obm task time(s)", "folder name", "project name", "audit time",
}
BYTES_PER_GB = 1024**3
END_OF_DAY = " 23:59:59"
START_OF_DAY = " 00:00:00"

_STANDARD_BY_SPELLING = {s: std for std, spellings in HEADER_SPELLINGS.items() for s in spellings}
RAW_ONLY = ("Utilization (Bytes)", "Metering Date (UTC)", "Date")


def standard_name(header: str) -> str:
    """Standard column of a header; an unknown header keeps its trimmed text."""
    return _STANDARD_BY_SPELLING.get(header.strip().lower(), header.strip())


def file_name_log_type(file_name: str | None) -> str | None:
    """Log type a file name suggests, if any."""
    stem = "".join(ch for ch in PurePosixPath(file_name or "").stem.lower() if ch.isalnum())
    looks_bulk = "massingest" in stem or (stem.endswith("mi") and len(stem) > 2)
    return BULK if looks_bulk else None


def detect_log_type(headers: Sequence[str], file_name: str | None = None) -> str:
    """Log type of a file. Headers decide where they show exactly one kind; else the file name,
    and without a hint there the weaker header signs."""
    seen = {str(h).strip().lower() for h in headers}
    utilization = bool(seen & {"utilization(bytes)", "utilization (bytes)"})
    bulk_shape = ("volume (gbs)" in seen and bool(seen & {"job name", "agent name"})) or (utilization and "date" in seen)
    metered_task = {"task id", "metered value"} <= seen and "job name" not in seen
    task_shape = bool(seen & TASK_HEADERS) or metered_task
    if bulk_shape != task_shape:
        return BULK if bulk_shape else TASK
    hint = file_name_log_type(file_name)
    if hint:
        return hint
    renamed_bulk = {"agent name", "metered value", "task run id"} <= seen
    return BULK if bulk_shape or (renamed_bulk and not task_shape) else TASK


def file_org(assigned: str | None, log_type: str) -> str:
    """Organization label of a file: bulk logs carry the suffix, task logs do not."""
    org = assigned if assigned is not None else "Unknown"
    if log_type == BULK and not org.strip().endswith(BULK_SUFFIX):
        return (org.strip() or "Unknown") + BULK_SUFFIX
    if log_type == TASK and org.strip().endswith(BULK_SUFFIX):
        return org.strip().removesuffix(BULK_SUFFIX).strip() or org
    return org


def standard_cells(raw: DataFrame, headers: Sequence[str]) -> tuple[DataFrame, set[str]]:
    """Raw text columns, named by position, to one text column per standard name. Where two
    headers mean the same column, the first that has a value counts."""
    sources: dict[str, list[Column]] = {}
    for column, header in zip(raw.columns, headers):
        sources.setdefault(standard_name(header), []).append(F.col(column))
    wanted = [*STANDARD_COLUMNS, *RAW_ONLY]
    nothing = F.lit(None).cast("string")
    cells = {std: F.coalesce(*sources[std]) if std in sources else nothing for std in wanted}
    extra = raw.columns[len(headers):]
    return raw.select(*extra, *[c.alias(std) for std, c in cells.items()]), set(sources) & set(wanted)


def fill_bulk_cells(cells: DataFrame, present: set[str]) -> DataFrame:
    """Completes bulk-ingestion cells. ``present`` names the standard columns the file has; the
    steps build on each other in this order."""

    def with_day(df: DataFrame, source: str) -> DataFrame:
        dated = with_timestamps(df, {"_day": F.col(source)})
        return dated.withColumn("_day", F.date_format("_day", "yyyy-MM-dd"))

    have = set(present)
    if "Date" in have:
        cells = with_day(cells, "Date")
        to_fill = is_missing(F.col("End Time")) & ~is_missing(F.col("Date"))
        start = F.when(to_fill & is_missing(F.col("Start Time")), F.concat("_day", F.lit(START_OF_DAY)))
        end = F.when(to_fill, F.concat("_day", F.lit(END_OF_DAY)))
        cells = cells.withColumns({
            "Start Time": F.when(to_fill & is_missing(F.col("Start Time")), start).otherwise(F.col("Start Time")),
            "End Time": F.when(to_fill, end).otherwise(F.col("End Time")),
        }).drop("_day")
        have.add("End Time")
    if "Utilization (Bytes)" in have:
        volume = (number(F.col("Utilization (Bytes)")) / BYTES_PER_GB).cast("string")
        unset = is_missing(F.col("Metered Value")) | (text_number_or_zero(F.col("Metered Value")) == 0)
        cells = cells.withColumn("Metered Value", F.when(unset, volume).otherwise(F.col("Metered Value")))
    if "Task Run ID" in have:
        cells = cells.withColumn("Task ID", fill_missing(F.col("Task ID"), F.col("Task Run ID")))
    elif "Task ID" in have:
        cells = cells.withColumn("Task Run ID", F.col("Task ID"))
    if "Task Name" in have:
        cells = cells.withColumn("Task Type", fill_missing(F.col("Task Type"), F.col("Task Name")))

    status = fill_missing(F.col("Status"), F.lit("Completed"))
    if "End Time" in have:
        still_open = is_missing(F.col("End Time"))
        status = F.when(still_open, F.lit("Running")).otherwise(status)
        end = F.col("End Time")
        if "Metering Date (UTC)" in have:
            cells = with_day(cells, "Metering Date (UTC)")
            metered_day = F.concat("_day", F.lit(END_OF_DAY))
            end = F.when(still_open & ~is_missing(F.col("Metering Date (UTC)")), metered_day).otherwise(end)
        return cells.withColumns({"Status": status, "End Time": end}).drop("_day")
    return cells.withColumn("Status", status)


def typed_rows(cells: DataFrame, run_date: dt.date) -> DataFrame:
    """Text cells to typed columns under our names. The run date is the day of the import."""
    imported = F.lit(run_date)
    kept = [c for c in cells.columns if c not in STANDARD_COLUMNS and c not in RAW_ONLY]
    cells = with_timestamps(cells, {"_end": F.col("End Time"), "_audit": F.col("Audit Time")})
    cells = with_full_start(cells, "_start", F.col("Start Time"), [F.col("_audit"), F.col("_end")], imported)
    typed = {
        "start_time": F.col("_start"),
        "end_time": F.col("_end"),
        "audit_time": F.col("_audit"),
        "metered_value": number(F.col("Metered Value")),
        "cores_used": number(F.col("Cores Used")),
        "run_date": imported,
    }
    computed = ("ipus", "cost")
    columns = [
        typed.get(ours, F.col(std)).alias(ours) for std, ours in STANDARD_COLUMNS.items() if ours not in computed
    ]
    return cells.select(*kept, *columns)


def price(df: DataFrame, pricing: Pricing = Pricing(), factor: float | None = None) -> DataFrame:
    """Units and cost from the metered value; also re-prices loaded rows with other factors."""
    priced = df.withColumn("ipus", P.units(F.col("metered_value"), pricing, override=factor))
    return priced.withColumn("cost", P.cost(F.col("ipus"), pricing))


def standard_frame(df: DataFrame) -> DataFrame:
    """Rows under the standard titles, in report order."""
    return df.select(*[F.col(ours).alias(std) for std, ours in STANDARD_COLUMNS.items() if ours in df.columns])


def assign_orgs(df: DataFrame) -> DataFrame:
    """Makes the suffix of ``org`` agree with ``log_type`` (a row-wise form of the file rule)."""
    is_bulk = F.trim("log_type") == BULK
    org = F.when(is_bulk, bulk_org(F.col("org"))).when(is_bulk_org(F.col("org")), base_org(F.col("org"))).otherwise(F.col("org"))
    return df.withColumn("org", org)


def to_tasks(df: DataFrame) -> DataFrame:
    """Priced rows as history rows: second precision, amounts at 6 places, blanks as NULL, hash
    and date columns. Carries extra columns along."""
    names = [f.name for f in TASKS_SCHEMA if f.name in df.columns]
    extra = [c for c in df.columns if c not in TASKS_SCHEMA.names and c not in STANDARD_COLUMNS.values()]
    out = {}
    for f in TASKS_SCHEMA:
        kind = f.dataType.simpleString()
        if f.name in names and f.name not in ("row_hash", "end_date", "end_month"):
            c = F.col(f.name)
            if kind == "string":
                c = F.nullif(c.cast("string"), F.lit(""))
            elif kind == "timestamp":
                c = F.date_trunc("second", c)
            elif kind == "double":
                c = F.bround(F.nanvl(c, F.lit(None).cast("double")), 6)
            out[f.name] = c
    rows = df.select(*extra, *[c.alias(n) for n, c in out.items()])
    return rows.withColumns({
        "row_hash": row_hash(),
        "end_date": F.to_date("end_time"),
        "end_month": F.to_date(F.date_trunc("month", "end_time")),
    })


def to_rename() -> Column:
    """Whether a row is a bulk row whose organization lacks the suffix."""
    rename = (F.col("log_type") == BULK) & (F.trim("org") != "") & ~F.col("org").endswith(BULK_SUFFIX)
    return F.coalesce(rename, F.lit(False))


def _bulk_units(pricing: Pricing) -> Column:
    return F.round(F.coalesce("metered_value", F.lit(0.0)) * F.lit(pricing.bulk_factor), 8)


def priced_otherwise(pricing: Pricing = Pricing()) -> Column:
    """Whether a row is a bulk row that is priced with another factor."""
    off = F.abs(F.coalesce("ipus", F.lit(0.0)) - _bulk_units(pricing)) > 1e-7
    return F.coalesce((F.col("log_type") == BULK) & F.col("metered_value").isNotNull() & off, F.lit(False))


def retag_bulk_rows(tasks: DataFrame, pricing: Pricing = Pricing(), again: bool | None = None) -> DataFrame:
    """Brings older history up to date: bulk rows get the organization suffix and a new hash, and
    if any bulk row is priced with another factor, all bulk rows are priced again. ``again`` says so
    where tasks are a part of the history."""
    renamed = tasks.withColumn("_rename", to_rename())
    renamed = renamed.withColumn("org", F.when(F.col("_rename"), bulk_org(F.col("org"))).otherwise(F.col("org")))
    renamed = renamed.withColumn("row_hash", F.when(F.col("_rename"), row_hash()).otherwise(F.col("row_hash"))).drop("_rename")
    off = F.lit(again) if again is not None else tasks.agg(F.coalesce(F.bool_or(priced_otherwise(pricing)), F.lit(False))).scalar()
    cost = F.round(F.coalesce("metered_value", F.lit(0.0)) * F.lit(pricing.bulk_factor) * F.lit(pricing.unit_cost), 6)
    reprice = (F.col("log_type") == BULK) & off
    return renamed.withColumns({
        "ipus": F.when(reprice, _bulk_units(pricing)).otherwise(F.col("ipus")),
        "cost": F.when(reprice, cost).otherwise(F.col("cost")),
    })
