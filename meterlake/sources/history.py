"""The task history: Parquet files by end month, the list of those that count, and the audit log.

A change (an addition, a deletion, a re-tagging) writes its rows into a folder of its own, by month,
beside what is there. Then it publishes one small file, a version: which folders and months count
from now on, how many rows each has, and the event for the audit log. Readers follow the newest
version. So a change that dies at any point leaves the old state, rows and log alike, and its folder
is in no list; `remove_unlisted` takes such folders away. Row totals come from the list. One writer
at a time; a second one that comes to the same version number fails.

A batch is written out as it comes, by month and without a shuffle, so that the log files are parsed
once and a lost executor costs no more than its tasks. Then only hashes are shuffled, to find the
rows that are repeated: months without any count as they were written, months of which all rows are
stored already go, and only the others are written again."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators.dedup import one_per_hash, repeated_hashes
from meterlake.operators.filters import TaskFilter
from meterlake.operators.ingest import priced_otherwise, retag_bulk_rows, to_rename, to_tasks
from meterlake.operators.series import date_summary
from meterlake.schema import BULK, EVENTS_SCHEMA, TASKS_SCHEMA, Pricing
from meterlake.sources import files

# Texts of the audit log.
ADDED_PREFIX = "Added date range(s): "
OLD_ADDED_PREFIX = "; added date range(s): "
DELETED_NOTE = "Historical rows deleted by date range"
RETAGGED_NOTE = "Bulk rows brought up to date"

#: Of a column whose values do not repeat, a dictionary would be made and thrown away in each file.
FORMAT = {"compression": "zstd"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("row_hash", "task_run_id")}

NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a NULL partition value


@dataclass(frozen=True)
class AppendResult:
    rows_added: int
    total_rows: int
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    added_ranges: str | None = None


@dataclass(frozen=True)
class Version:
    """Rows of every month that counts, by change; the calendar and the changes bound the list.
    ``whole`` names the changes of which all months count."""

    number: int
    parts: dict[str, dict[str, int]]
    whole: frozenset[str]

    @property
    def total(self) -> int:
        return sum(n for months in self.parts.values() for n in months.values())

    def without(self, months: set[str]) -> Version:
        left = {c: {m: n for m, n in ms.items() if m not in months} for c, ms in self.parts.items()}
        whole = frozenset(c for c in self.whole if left[c] == self.parts[c])
        return Version(self.number, {c: ms for c, ms in left.items() if ms}, whole)

    def added(self, change: str, months: dict[str, int]) -> Version:
        return Version(self.number, {**self.parts, change: months}, self.whole | {change}) if months else self


def data_path(root: str) -> str:
    return f"{root}/data"


def versions_path(root: str) -> str:
    return f"{root}/versions"


def current_version(spark: SparkSession, root: str) -> Version:
    numbers = [n for n in files.names(spark, versions_path(root)) if n.endswith(".json") and not n.startswith(("_", "."))]
    if not numbers:
        return Version(0, {}, frozenset())
    stored = json.loads(files.read_text(spark, f"{versions_path(root)}/{numbers[-1]}"))
    return Version(stored["version"], stored["parts"], frozenset(stored["whole"]))


def _publish(spark: SparkSession, root: str, version: Version, event: dict | None) -> None:
    """Makes a version the newest one, with the event that it is recorded by."""
    number = version.number + 1
    row = {"version": number, "parts": version.parts, "whole": sorted(version.whole), "event": event}
    files.publish_text(spark, f"{versions_path(root)}/{number:020d}.json", json.dumps(row, default=str) + "\n")


def read_history(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, current_version(spark, root))


def _read(spark: SparkSession, root: str, version: Version) -> DataFrame:
    paths = []
    for change, months in version.parts.items():
        folder = f"{data_path(root)}/change={change}"
        paths += [folder] if change in version.whole else [f"{folder}/end_month={m}" for m in months]
    if not paths:
        return spark.createDataFrame([], TASKS_SCHEMA)
    return spark.read.schema(TASKS_SCHEMA).option("basePath", data_path(root)).parquet(*paths).select(*TASKS_SCHEMA.names)


def read_changes(spark: SparkSession, root: str, changes: list[str]) -> DataFrame:
    """All rows that some changes wrote, with the name of the change; also of months that do not count
    any more."""
    folders = [f"{data_path(root)}/change={c}" for c in changes]
    schema = T.StructType([*TASKS_SCHEMA.fields, T.StructField("change", T.StringType())])
    return spark.read.schema(schema).option("basePath", data_path(root)).parquet(*folders)


def write_change(df: DataFrame, root: str, gathered: bool = True) -> tuple[str, DataFrame]:
    """Writes rows by month as a new change; returns its name and its rows. Rebalancing gathers small
    months and splits a hot one over files; rows that are not ``gathered`` are not shuffled, and every
    task writes files of its own."""
    change = f"c{uuid.uuid4().hex}"
    if gathered:
        df = df.select(*TASKS_SCHEMA.names).hint("rebalance", F.col("end_month"))
    return change, _written(df, f"{data_path(root)}/change={change}")


def _written(df: DataFrame, folder: str) -> DataFrame:
    """Adds rows to the folder of a change and reads the folder. A task sorts its rows by month, which
    takes a third of the time of a file open for each month."""
    spark = df.sparkSession
    with files.writing(spark):
        df.write.options(**FORMAT).partitionBy("end_month").mode("append").parquet(folder)
    rows = spark.read.schema(df.schema).option("basePath", folder.rpartition("/")[0]).parquet(folder)
    return rows.select(*df.columns)


def _without_repeated(
    spark: SparkSession, root: str, change: str, rows: DataFrame, counted: dict[str, int], stored: DataFrame, staging: str
) -> dict[str, int]:
    """Takes the rows of a change that is in no list yet out of it if their hash is stored, and all but
    one of those that share a hash; returns the rows of each month that are left.

    Only hashes are shuffled; of the rows, those of months of which a part is repeated. Their files
    are replaced by new ones in the same folders."""
    folder = f"{data_path(root)}/change={change}"
    with files.writing(spark):
        repeated_hashes(rows, stored).write.parquet(f"{staging}/repeated")
    again = spark.read.parquet(f"{staging}/repeated")
    found = again.groupBy("end_month").agg(F.sum("copies").alias("n"), F.count_if(~F.col("is_stored")).alias("left")).collect()  # the calendar bounds them
    found = {str(r.end_month) if r.end_month else NO_MONTH: r for r in found}
    left = {m: n for m, n in counted.items() if m not in found}
    mixed = [m for m, r in found.items() if r.left or r.n < counted[m]]
    old = [f"{folder}/end_month={m}/{name}" for m in mixed for name in files.names(spark, f"{folder}/end_month={m}")]
    if mixed:
        again = again.where(_in_months(mixed)).select(F.lower(F.hex("hash")).alias("row_hash"), "is_stored")
        some = rows.where(_in_months(mixed))
        once = some.join(again, "row_hash", "left_anti")
        least = one_per_hash(some.join(again.where("not is_stored"), "row_hash", "left_semi").select(*rows.columns))
        _written(once.select(*rows.columns).unionByName(least).hint("rebalance", F.col("end_month")), folder)
    for path in old:
        files.remove(spark, path)
    for m in found.keys() - set(mixed):
        files.remove(spark, f"{folder}/end_month={m}")
    if mixed:
        now = spark.read.schema(rows.schema).option("basePath", data_path(root)).parquet(*[f"{folder}/end_month={m}" for m in mixed])
        left |= _rows_by_month(now)
    if not left:
        files.remove(spark, folder)
    return left


def _rows_by_month(rows: DataFrame) -> dict[str, int]:
    counts = rows.groupBy("end_month").agg(F.count(F.lit(1)).alias("n")).collect()  # the calendar bounds them
    return {str(r.end_month) if r.end_month else NO_MONTH: r.n for r in counts}


def remove_unlisted(spark: SparkSession, root: str) -> list[str]:
    """Removes the folders of changes that the newest version does not list (changes that died, and
    ones whose months have all been replaced); for times without a writer or an old reader."""
    listed = current_version(spark, root).parts
    gone = [n for n in files.names(spark, data_path(root)) if n.removeprefix("change=") not in listed]
    for name in gone:
        files.remove(spark, f"{data_path(root)}/{name}")
    return gone


def _in_months(months: list[str]) -> Column:
    known = [dt.date.fromisoformat(m) for m in months if m != NO_MONTH]
    hit = F.col("end_month").isNull() if NO_MONTH in months else F.lit(False)
    return hit | F.col("end_month").isin(known) if known else hit  # the calendar bounds the list


def _by_day(df: DataFrame, path: str) -> DataFrame:
    """Rows counted by month and day, as a table: what summaries need of them. The day is that of the
    end time; rows without one have that of the start time."""
    days = {c: F.date_trunc("day", c) for c in ("start_time", "end_time")}
    days["start_time"] = F.when(F.col("end_time").isNull(), days["start_time"])
    with files.writing(df.sparkSession):
        df.groupBy("end_month", *[c.alias(n) for n, c in days.items()]).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _month_rows(by_day: DataFrame) -> dict[str, int]:
    rows = by_day.groupBy("end_month").agg(F.sum("n").alias("n")).collect()  # the calendar bounds them
    return {str(r.end_month) if r.end_month else NO_MONTH: r.n for r in rows}


def append_tasks(
    spark: SparkSession, root: str, batch: DataFrame, created_at: dt.datetime, batch_id: str | None = None
) -> AppendResult:
    """Adds the rows of a priced batch whose hash is not stored yet and logs the addition.

    The hash covers the end time, so a stored copy can only lie in the same month: only those
    months' hashes are read. Rows and event count together or not at all, so running a batch again
    adds what the first run did not, and records it once."""
    batch_id = batch_id or uuid.uuid4().hex
    staging = f"{root}/_staging/{batch_id}-{uuid.uuid4().hex}"
    rows = to_tasks(batch.withColumns({"batch_id": F.lit(batch_id), "created_at": F.lit(created_at)}))
    order = [c for c in ("source_file",) if c in rows.columns]  # the first to tell repeated rows apart by
    change, staged = write_change(rows.select(*order, *TASKS_SCHEMA.names), root, False)
    processed = _by_day(staged, f"{staging}/days")

    version = current_version(spark, root)
    touched = _month_rows(processed)
    stored = _read(spark, root, version).where(_in_months(list(touched)))
    months = _without_repeated(spark, root, change, staged, touched, stored, staging) if touched else {}
    after = version.added(change, months)
    rows_added, total = sum(months.values()), after.total
    if rows_added == 0:
        files.remove(spark, staging)
        files.remove(spark, f"{data_path(root)}/change={change}")
        return AppendResult(0, total)
    added_days = processed
    if months != touched:
        added_days = _by_day(_read(spark, root, Version(0, {change: months}, frozenset())), f"{staging}/added")
    whole, new = date_summary(processed).first(), date_summary(added_days).first()
    result = AppendResult(
        rows_added, total, whole.start_date if whole else None, whole.end_date if whole else None, new.label if new else None,
    )
    note = ADDED_PREFIX + result.added_ranges if result.added_ranges else None
    event = _event("ADD", result.start_date, result.end_date, rows_added, total, note, created_at, batch_id)
    _publish(spark, root, after, event)
    files.remove(spark, staging)
    return result


def kept_rows(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    """Rows that a delete leaves: all for which the filter is not true, also where it is NULL."""
    return tasks.where(~F.coalesce(f.predicate(tasks), F.lit(False)))


def _replaced(spark: SparkSession, root: str, version: Version, months: list[str], rows: DataFrame) -> Version:
    """The version in which rows stand for all that the months had before."""
    change, written = write_change(rows, root)
    return version.without(set(months)).added(change, _rows_by_month(written))


def delete_tasks(spark: SparkSession, root: str, f: TaskFilter, created_at: dt.datetime) -> tuple[int, int]:
    """Deletes matching rows and returns (deleted, remaining). Only months with a deleted row are
    written anew, without it; a month without kept rows is in no list any more."""
    version = current_version(spark, root)
    history = _read(spark, root, version)
    hit = [str(r.end_month) if r.end_month else NO_MONTH for r in f.apply(history).select("end_month").distinct().collect()]
    after = _replaced(spark, root, version, hit, kept_rows(history.where(_in_months(hit)), f)) if hit else version
    start, end = dt.date.fromisoformat(str(f.start)), dt.date.fromisoformat(str(f.end))
    deleted = version.total - after.total
    _publish(spark, root, after, _event("DELETE", start, end, deleted, after.total, DELETED_NOTE, created_at))
    return deleted, after.total


def retag_tasks(spark: SparkSession, root: str, created_at: dt.datetime, pricing: Pricing = Pricing()) -> tuple[int, int]:
    """Brings stored bulk rows up to date (see `retag_bulk_rows`); returns (changed, remaining).

    Only months with a row to change are written anew. A renamed row whose new hash another row of
    the month has goes, as it would when it is delivered again; of several renamed rows with one
    hash, one stays."""
    version = current_version(spark, root)
    history = _read(spark, root, version)
    off, bulk = priced_otherwise(pricing), F.coalesce(F.col("log_type") == BULK, F.lit(False))
    counts = history.groupBy("end_month").agg(F.count_if(to_rename()).alias("rename"), F.count_if(bulk).alias("bulk"), F.count_if(off).alias("off")).collect()
    again = any(r.off for r in counts)
    touched = [r for r in counts if r.rename or (again and r.bulk)]
    if not touched:
        return 0, version.total
    months = [str(r.end_month) if r.end_month else NO_MONTH for r in touched]
    rows = history.where(_in_months(months)).withColumn("_renamed", to_rename())
    rows = retag_bulk_rows(rows, pricing, again)
    same = rows.where("not _renamed").drop("_renamed")
    kept, same = write_change(same, root, False)
    change, renamed = write_change(rows.where("_renamed").drop("_renamed"), root, False)
    counted, staging = _rows_by_month(renamed), f"{root}/_staging/{uuid.uuid4().hex}"
    left = _without_repeated(spark, root, change, renamed, counted, same, staging) if counted else {}
    after = version.without(set(months)).added(kept, _rows_by_month(same)).added(change, left)
    files.remove(spark, staging)
    changed = sum(r.bulk if again else r.rename for r in touched)
    _publish(spark, root, after, _event("RETAG", None, None, changed, after.total, RETAGGED_NOTE, created_at))
    return changed, after.total


def _event(
    action: str, start: dt.date | None, end: dt.date | None, affected: int | None, remaining: int | None, note: str | None,
    created_at: dt.datetime, cause: str | None = None,
) -> dict:
    values = (cause or uuid.uuid4().hex, action, start, end, affected, remaining, note, created_at)
    return dict(zip(EVENTS_SCHEMA.names, values, strict=True))


def record_event(
    spark: SparkSession, root: str, action: str, start: dt.date | None, end: dt.date | None,
    affected: int | None, remaining: int | None, note: str | None, created_at: dt.datetime,
) -> None:
    """Logs an event that changes no rows."""
    _publish(spark, root, current_version(spark, root), _event(action, start, end, affected, remaining, note, created_at))


def read_events(spark: SparkSession, root: str, action: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit log, newest first."""
    if not files.names(spark, versions_path(root)):
        return spark.createDataFrame([], EVENTS_SCHEMA)
    texts = {"start_date", "end_date", "created_at"}
    fields = ", ".join(f"{f.name} {'string' if f.name in texts else f.dataType.simpleString()}" for f in EVENTS_SCHEMA)
    stored = spark.read.schema(f"version long, event struct<{fields}>").json(versions_path(root)).where("event is not null")
    event_id = F.concat_ws("-", F.lpad(F.col("version").cast("string"), 20, "0"), "event.event_id")  # in order of recording
    columns = {f.name: F.col(f"event.{f.name}").cast(f.dataType) for f in EVENTS_SCHEMA} | {"event_id": event_id}
    return list_events(stored.select(*[c.alias(n) for n, c in columns.items()]), action, limit)


def list_events(events: DataFrame, action: str | None = None, limit: int | None = None) -> DataFrame:
    if action:
        events = events.where(F.col("action") == action)
    events = events.orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.limit(limit) if limit is not None else events


def events_display(events: DataFrame) -> DataFrame:
    """Audit rows with the processed range as text and the added ranges taken from the note."""
    first, last = F.col("start_date").cast("string"), F.col("end_date").cast("string")
    processed = F.when(first != last, F.concat(first, F.lit(" to "), last)).otherwise(first)
    note = F.coalesce("note", F.lit(""))

    def after(prefix: str) -> Column:
        return F.substring(note, F.instr(note, prefix) + len(prefix), F.length(note))

    ranges = (
        F.when(note.contains(ADDED_PREFIX), after(ADDED_PREFIX))
        .when(note.contains(OLD_ADDED_PREFIX), after(OLD_ADDED_PREFIX))
        .otherwise(F.lit(""))
    )
    return events.select(
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        processed.alias("processed_date_range"),
        ranges.alias("added_date_ranges"),
        "affected_rows", "remaining_rows", "note",
    )
