"""Totals and distinct counts of a stored history, kept up to date change by change.

The history is a list of changes and the months of theirs that count. Every change gets cells of
its own, made once from its rows: amounts by day and value of each dimension, and bitmaps (of few
ids, lists) of the numbers of its task ids. Totals of the history are sums over the cells of the months that are
listed. So an addition costs the cells of its own rows, and a deletion takes the cells of the months
that it replaces out of the list: nothing is subtracted, and bitmaps, which could not be, need not
be. Bitmaps are there by day and by month; a range takes whole months by month and the days at its
ends by day, so a distinct count over years reads few of them.

A task id's number comes from a dictionary that only grows. A run writes new ids, then cells, then
publishes one small file that lists both; a run that dies leaves numbers unused and folders that no
file lists. One writer at a time, as for the history. Amounts depend on the prices, so a store holds
those of one pricing."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import env_base, label, log_type_label, org_label
from meterlake.functions.pricing import WEIGHT, exact_sum, shown, usage
from meterlake.operators.filters import Day, as_date
from meterlake.operators.numbering import numbered
from meterlake.schema import Pricing
from meterlake.sources import files, history

#: Dimensions by name; "all" has the one value NULL.
DIMENSIONS = ("all", "org", "environment", "project_name", "agent_name", "log_type", "task_type", "status")
SPANS = ("day", "month")
#: From so many places in a bucket on, a bitmap takes less room than the list.
FEW = 1024
#: Rows that a task brings into all dimensions, as far as months and places can be told apart.
TASK_ROWS = 100_000
PLACE_BITS = 15
#: Aggregates of lists sort their rows once, in place of hashing the first 128 groups and sorting the rest in each step.
SORTED = {"spark.sql.execution.useObjectHashAggregateExec": "false"}
IDS = "task_id string, number long"
SUMS = "day date, dimension string, value string, ipus decimal(38,8), cost decimal(38,8), run_weight long, change string, end_month date"
BITS = "day date, dimension string, value string, bucket long, places array<int>, bits binary, change string, end_month date, span string"


@dataclass(frozen=True)
class CellVersion:
    """The run that holds the cells of each change, and the runs that added task ids."""

    number: int
    changes: dict[str, str]
    ids: list[str]


def cells_path(root: str, pricing: Pricing) -> str:
    return f"{root}/cells/{pricing.task_factor}-{pricing.bulk_factor}-{pricing.unit_cost}"


def current_cells(spark: SparkSession, path: str) -> CellVersion:
    numbers = [n for n in files.names(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith(("_", "."))]
    if not numbers:
        return CellVersion(0, {}, [])
    stored = json.loads(files.read_text(spark, f"{path}/versions/{numbers[-1]}"))
    return CellVersion(stored["version"], stored["changes"], stored["ids"])


def _by_dimension(rows: DataFrame, *others: str) -> DataFrame:
    """Every row once for each dimension, which has its place in the list for a name."""
    pairs = [F.struct(F.lit(i).alias("dimension"), (F.lit(None) if d == "all" else F.col(d)).cast("string").alias("value")) for i, d in enumerate(DIMENSIONS)]
    return rows.select(*others, F.inline(F.array(*pairs)))


def _named(cells: DataFrame, **names: Sequence[str]) -> DataFrame:
    """Names in the place of their places in a list: keys are shuffled and compared while they are short."""
    return cells.withColumns({c: F.get(F.array(*map(F.lit, listed)), F.col(c)) for c, listed in names.items()})


def _ids(spark: SparkSession, path: str, runs: list[str]) -> DataFrame:
    return spark.read.schema(IDS).parquet(*[f"{path}/ids/run={r}" for r in runs]) if runs else spark.createDataFrame([], IDS)


def _listed_places(met: DataFrame) -> DataFrame:
    """Lists of the distinct places in a part of a bucket, by change, dimension and value, for each day and
    its month.

    Rows that are dealt out by change, month, bucket and part hold all that such a list is made of, so it
    takes no further shuffle to multiply them by dimension, and one sort for both aggregates."""
    keys = ["change", "end_month", "bucket", "part", "dimension", "value"]
    entries = _by_dimension(met, "change", "end_month", "day", "bucket", "part", "number")
    place = F.bitmap_bit_position("number").cast("int")
    days = entries.groupBy(*keys, "day").agg(F.collect_set(place).alias("places"))
    months = days.groupBy(*keys).agg(F.collect_list(F.struct(F.lit(0).alias("span"), "day", F.array_sort("places").alias("places"))).alias("days"))
    month = F.struct(F.lit(1).alias("span"), F.col("end_month").alias("day"), F.array_sort(F.array_distinct(F.flatten("days.places"))).alias("places"))
    return months.select("change", "end_month", "bucket", "dimension", "value", F.inline(F.concat("days", F.array(month))))


def _packed(listed: DataFrame, keys: list[str]) -> DataFrame:
    """Lists of few places as they are, of many as a bitmap of 4 KB. A bucket has 32,768 places, which
    bounds a list."""
    few = listed.where(F.size("places") < FEW).withColumn("bits", F.lit(None).cast("binary"))
    many = listed.where(F.size("places") >= FEW).select(*keys, "bucket", F.explode("places").alias("place"))
    bits = many.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return few.unionByName(bits.withColumn("places", F.lit(None).cast("array<int>")))


def update_cells(spark: SparkSession, root: str, pricing: Pricing = Pricing()) -> list[str]:
    """Makes the cells of the changes that have none yet; returns those changes. Rows without an end
    date are in no range and in no cell."""
    path = cells_path(root, pricing)
    now, listed = current_cells(spark, path), history.current_version(spark, root)
    missing = sorted(set(listed.parts) - set(now.changes))
    if not missing:
        return []
    run = uuid.uuid4().hex
    rows = history.read_changes(spark, root, missing).where("end_date is not null").withColumnRenamed("end_date", "day")

    known = _ids(spark, path, now.ids)
    first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("first")).scalar()
    new = rows.select("task_id").where("task_id is not null").distinct().join(known, "task_id", "left_anti")
    with files.writing(spark):
        numbered(new, "task_id", first).write.parquet(f"{path}/ids/run={run}")
    ids = _ids(spark, path, [*now.ids, run])

    rows = rows.withColumn("change", (F.array_position(F.array(*map(F.lit, missing)), F.col("change")) - 1).cast("int"))
    used = usage(rows, pricing)
    priced = rows.withColumns({"ipus": used.ipus, "cost": used.cost})
    keys = ["change", "end_month", "day", "dimension", "value"]
    sums = _by_dimension(priced, "change", "end_month", "day", "ipus", "cost").groupBy(*keys).agg(
        exact_sum(F.col("ipus")).alias("ipus"), exact_sum(F.col("cost")).alias("cost"), F.count(F.lit(1)).alias(WEIGHT)
    )
    sums = _named(sums, change=missing, dimension=DIMENSIONS)
    with files.writing(spark):
        sums.hint("rebalance", F.col("end_month")).write.partitionBy("change", "end_month").parquet(f"{path}/sums/run={run}")

    counted = [n for c in missing for n in listed.parts[c].values()]
    last = ids.agg(F.max("number")).first()[0] or 0
    split = max(counted) * (1 << PLACE_BITS) // (max(last, 1 << PLACE_BITS) * TASK_ROWS)  # a month's rows may lie in one bucket
    part = F.bitmap_bit_position("number").bitwiseAND(F.lit((1 << min(split.bit_length(), PLACE_BITS)) - 1))
    met = rows.join(ids, "task_id").withColumns({"bucket": F.bitmap_bucket_number("number"), "part": part})
    met = met.select(*[c for c in met.columns if c in (*DIMENSIONS, "change", "end_month", "day", "bucket", "part", "number")])
    met = met.repartitionByRange(1 + sum(counted) // TASK_ROWS, "change", "end_month", "bucket", "part")
    staging = f"{root}/_staging/cells-{run}"
    lists = _listed_places(met)
    with files.writing(spark, SORTED):
        lists.write.option("compression", "zstd").parquet(staging)
    packed = _packed(spark.read.schema(lists.schema).parquet(staging), [*keys, "span"])
    packed = _named(packed, change=missing, dimension=DIMENSIONS, span=SPANS)
    order = ["change", "end_month", "span"]
    with files.writing(spark):
        packed.sortWithinPartitions(*order, "dimension", "value", "day", "bucket").write.option("compression", "zstd").partitionBy(*order).parquet(f"{path}/bits/run={run}")
    files.remove(spark, staging)

    changes = {c: r for c, r in now.changes.items() if c in listed.parts} | {c: run for c in missing}
    state = {"version": now.number + 1, "changes": changes, "ids": [*now.ids, run]}
    files.publish_text(spark, f"{path}/versions/{now.number + 1:020d}.json", json.dumps(state) + "\n")
    return missing


def _listed(spark: SparkSession, root: str, path: str, table: str, schema: str, months: tuple[dt.date, dt.date]) -> DataFrame:
    """Cells of the listed months that a range touches. The list of folders is bounded by the
    calendar and the changes; a change without cells is an error."""
    made, paths = current_cells(spark, path).changes, []
    for change, counted in history.current_version(spark, root).parts.items():
        if change not in made:
            raise LookupError(f"change {change} has no cells; call update_cells first")
        folder = f"{path}/{table}/run={made[change]}/change={change}"
        paths += [f"{folder}/end_month={m}" for m in counted if m != history.NO_MONTH and months[0] <= dt.date.fromisoformat(m) <= months[1]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*paths)


def _read(spark: SparkSession, root: str, start: Day, end: Day, dimension: str, pricing: Pricing, table: str, schema: str) -> DataFrame:
    if dimension not in DIMENSIONS:
        raise ValueError(f"no dimension {dimension!r}")
    first, last = as_date(start), as_date(end)
    cells = _listed(spark, root, cells_path(root, pricing), table, schema, (first.replace(day=1), last.replace(day=1)))
    return cells.where(F.col("dimension") == dimension)


def day_cells(spark: SparkSession, root: str, start: Day, end: Day, dimension: str, pricing: Pricing = Pricing()) -> DataFrame:
    """Sums by day and raw value: day, value, ipus, cost, run_weight."""
    cells = _read(spark, root, start, end, dimension, pricing, "sums", SUMS).where(F.col("day").between(as_date(start), as_date(end)))
    return cells.groupBy("day", "value").agg(*[F.sum(c).cast(t).alias(c) for c, t in (("ipus", "decimal(38,8)"), ("cost", "decimal(38,8)"), (WEIGHT, "long"))])


def id_bitmaps(spark: SparkSession, root: str, start: Day, end: Day, dimension: str, pricing: Pricing = Pricing()) -> DataFrame:
    """Bitmaps that make up a range: those of its whole months and of the days of the others."""
    first, last = as_date(start), as_date(end)
    whole = (F.col("end_month") >= F.lit(first)) & (F.last_day("end_month") <= F.lit(last))
    part = (F.col("span") == "day") & F.col("day").between(first, last)
    return _read(spark, root, first, last, dimension, pricing, "bits", BITS).where(F.when(whole, F.col("span") == "month").otherwise(part))


def unique_tasks(bitmaps: DataFrame, key: Column) -> DataFrame:
    """Exact number of distinct task ids for each key (a column named ``key``)."""
    listed = bitmaps.where("places is not null").select(key.alias("key"), "bucket", F.explode("places").alias("place"))
    made = listed.groupBy("key", "bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    stored = bitmaps.where("bits is not null").select(key.alias("key"), "bucket", "bits")
    merged = made.unionByName(stored).groupBy("key", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("unique_tasks"))


LABELS = {
    "all": lambda: F.lit("all"), "org": lambda: org_label(F.col("value")), "environment": lambda: env_base(F.col("value")),
    "project_name": lambda: label(F.col("value"), "-"), "log_type": lambda: log_type_label(F.col("value")),
}


def cell_stats(
    spark: SparkSession, root: str, start: Day, end: Day, dimension: str, pricing: Pricing = Pricing(), exact_unique: bool = True
) -> DataFrame:
    """Totals and distinct task ids of a range by the label of a dimension (agents, task types and
    statuses as they are stored), most units first. Without ``exact_unique`` the counts of the raw
    values under one label are added up."""
    labelled = LABELS.get(dimension, lambda: F.col("value"))
    sums = day_cells(spark, root, start, end, dimension, pricing).groupBy(labelled().alias("key")).agg(
        F.sum(WEIGHT).alias("task_count"), shown(F.sum("ipus")).alias("total_ipus"), shown(F.sum("cost")).alias("total_cost")
    )
    bitmaps = id_bitmaps(spark, root, start, end, dimension, pricing)
    if exact_unique:
        unique = unique_tasks(bitmaps, labelled())
    else:
        raw = unique_tasks(bitmaps, F.col("value")).withColumnRenamed("key", "value")
        unique = raw.groupBy(labelled().alias("key")).agg(F.sum("unique_tasks").alias("unique_tasks"))
    met = sums.join(unique.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    return met.withColumn("unique_tasks", F.coalesce("unique_tasks", F.lit(0).cast("long"))).orderBy(F.desc("total_ipus"), "key")


def cell_daily_stats(spark: SparkSession, root: str, start: Day, end: Day, dimension: str = "all", pricing: Pricing = Pricing()) -> DataFrame:
    """Totals by day and label of a dimension."""
    labelled = LABELS.get(dimension, lambda: F.col("value"))
    return day_cells(spark, root, start, end, dimension, pricing).groupBy(F.col("day").alias("date"), labelled().alias("key")).agg(
        F.sum(WEIGHT).alias("task_count"), shown(F.sum("ipus")).alias("total_ipus"), shown(F.sum("cost")).alias("total_cost")
    ).orderBy("date", "key")
