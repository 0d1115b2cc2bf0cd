import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterlake.functions.pricing import exact_sum


def total(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum(F.col("x")).alias("t")).first().t


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([float("nan"), 1e11, 1.0], "100000000001"), ([1e12, 0.1, -1e12], "0.1"), ([None, 2.5], "2.5"), ([], "0"), ([-5.5, 2.25], "-3.25"),
        ([1e20, 1.0, -1e20], "1"), ([2.0**63, 2.0**63, 0.125], str(2**64 + Decimal("0.125"))), ([9e10, 0.00000001], "90000000000.00000001"),
    ],
)
def test_amounts_of_every_size(spark, values, want):
    assert total(spark, values) == Decimal(want)
    assert total(spark, values[::-1]) == Decimal(want)


def test_many_large_amounts(spark):
    rows = spark.range(2_000_000).select(F.lit(8e10).alias("x"))
    assert rows.agg(exact_sum(F.col("x")).alias("t")).first().t == Decimal(160_000_000_000_000_000)


def test_order_does_not_matter(spark):
    r = random.Random(1)
    values = [r.choice([1, -1]) * 10 ** r.uniform(-6, 17) for _ in range(500)]
    first = total(spark, values)
    r.shuffle(values)
    assert total(spark, values) == first


def test_infinite_amounts_are_an_error(spark):
    with pytest.raises(Exception, match="infinite"):
        total(spark, [1.0, float("inf")])
