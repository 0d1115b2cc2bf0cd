"""Row identity, de-duplication and full-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.identity import row_hash

COPIES_PER_TASK_ROW = 10_000


def with_row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("row_hash", row_hash())


def one_per_hash(df: DataFrame) -> DataFrame:
    """One row per row_hash: the smallest by the other columns in their order, so that the result
    does not depend on how the files were split. Only hashes are shuffled to find those that repeat;
    an aggregate, not a window, then reduces their rows before the shuffle however many there are."""
    others = [c for c in df.columns if c != "row_hash"]
    again = df.groupBy("row_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("row_hash")
    least = df.join(again, "row_hash", "left_semi").groupBy("row_hash").agg(F.min(F.struct(*others)).alias("kept"))
    return df.join(again, "row_hash", "left_anti").unionByName(least.select("row_hash", "kept.*")).select(*df.columns)


def not_stored(staged: DataFrame, stored_hashes: DataFrame) -> DataFrame:
    return staged.join(stored_hashes.select("row_hash"), "row_hash", "left_anti")


def repeated_hashes(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The hashes that rows share with each other or with stored ones: hash (binary), copies (rows that
    have it), is_stored, end_month (of the rows). No more than hashes and months is shuffled."""
    here = rows.select(F.unhex("row_hash").alias("hash"), "end_month", F.lit(1).alias("here"))
    there = stored.select(F.unhex("row_hash").alias("hash"), F.lit(None).cast("date").alias("end_month"), F.lit(0).alias("here"))
    counted = here.unionByName(there).where("hash is not null").groupBy("hash").agg(
        F.sum("here").alias("copies"), F.bool_or(F.col("here") == 0).alias("is_stored"), F.max("end_month").alias("end_month")
    )
    return counted.where("copies > 1 or (copies = 1 and is_stored)")


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Every copy of rows that occur more than once, comparing all columns (NULLs are equal) but the
    file a row came from.

    Equal rows are counted, which shrinks a hot group before the shuffle, and written out again in
    slices, so that no task holds or emits a whole group."""
    columns = [c for c in df.columns if c != "source_file"]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    slices = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK_ROW))
    sliced = counted.select("*", F.explode(slices).alias("_slice")).repartition(*columns, "_slice")
    size = F.least(F.col("_n") - F.col("_slice") * COPIES_PER_TASK_ROW, F.lit(COPIES_PER_TASK_ROW)).cast("int")
    return sliced.select(*columns, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")
