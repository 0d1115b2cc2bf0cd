"""Exact quantiles without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _bucket(value: Column) -> Column:
    """Order-preserving bucket of about 0.1 % relative width; depends on the value only."""
    size = (F.floor(F.log(F.abs(value)) * 1000) + 800_000).cast("long")
    bucket = F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)
    # never NULL, and known to be: both uses of the counts then have one plan and share its shuffle
    return F.coalesce(bucket, F.lit(0).cast("long"))


#: Equal parts that a bucket with a wanted rank is split into before its values are ranked.
PARTS = 4096


def _upto(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``upto``: the rows of a key up to and with each step of ``order``."""
    in_order = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("n").over(in_order))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per column: ``metric, q25, q50, …``.

    Rows are first reduced to counts per distinct value. Running counts over the buckets tell
    which buckets hold the wanted ranks. Those are split into equal parts between their least and
    greatest value, so that amounts close together are spread as well, and only the values of the
    parts that hold a wanted rank are ranked one by one.
    """
    counts = (
        long_form(df, columns)
        .groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", _bucket(F.col("value")))
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("all_rows") - 1)

    def holds(upto: Column, before: Column) -> Column:
        hits = [(F.floor(position(p)) < upto) & (F.ceil(position(p)) >= before) for p in probs]
        return reduce(lambda x, y: x | y, hits)

    buckets = _upto(
        counts.groupBy("metric", "bucket").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")),
        ["metric"], "bucket",
    ).withColumn("all_rows", F.sum("n").over(Window.partitionBy("metric")))
    before = F.col("upto") - F.col("n")
    wanted = buckets.where(holds(F.col("upto"), before)).select("metric", "bucket", before.alias("before"), "all_rows", "low", "high")

    # halves, since the width of a bucket of very large values may be infinite
    width = F.col("high") / 2 - F.col("low") / 2
    part = F.when(width > 0, F.floor((F.col("value") / 2 - F.col("low") / 2) / width * PARTS)).otherwise(0)
    near = counts.join(wanted, ["metric", "bucket"]).select(
        "metric", "bucket", F.coalesce(part, F.lit(0)).cast("long").alias("part"), "value", "n", "before", "all_rows"
    )
    keys = ["metric", "bucket"]
    parts = _upto(
        near.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("all_rows").alias("all_rows")), keys, "part"
    ).withColumn("upto", F.col("upto") + F.col("before"))
    wanted_parts = parts.where(holds(F.col("upto"), F.col("upto") - F.col("n"))).select(
        *keys, "part", (F.col("upto") - F.col("n")).alias("before")
    )
    ranked = _upto(near.drop("before").join(wanted_parts, [*keys, "part"]), [*keys, "part"], "value").withColumn(
        "upto", F.col("upto") + F.col("before")
    )

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    picks = []
    for p in probs:
        low, high = value_at(F.floor(position(p))), value_at(F.ceil(position(p)))
        share = F.max(position(p) - F.floor(position(p)))
        picks.append((low + (high - low) * share).alias(f"q{round(p * 100)}"))
    return ranked.groupBy("metric").agg(*picks)
