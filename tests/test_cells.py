import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import values
from meterlake.functions import cells as K
from meterlake.functions import labels as B
from meterlake.functions import pricing as P
from meterlake.schema import Pricing

TIMES = {
    "2024-06-05 10:11": (2024, 6, 5, 10, 11),
    "2024/6/5 1:02:03": (2024, 6, 5, 1, 2, 3),
    "2024-06-05T10:11:12Z": (2024, 6, 5, 10, 11, 12),
    "2024-06-05  10:11:12.5": (2024, 6, 5, 10, 11, 12, 500000),
    " 2024-06-05 ": (2024, 6, 5),
    "05/06/2024": (2024, 6, 5),
    "01/13/2024": (2024, 1, 13),
    "5.6.2024 23:59": (2024, 6, 5, 23, 59),
    "05/06/24 7:08": (2024, 6, 5, 7, 8),
    "05/06/98": (1998, 6, 5),
    "05-Jun-2024 10:11": (2024, 6, 5, 10, 11),
    "June 5, 2024": (2024, 6, 5),
    "05/06/2024 12:05 AM": (2024, 6, 5, 0, 5),
    "05/06/2024 12:05:06 pm": (2024, 6, 5, 12, 5, 6),
    "05/06/2024 1:05 PM": (2024, 6, 5, 13, 5),
    "Jun 5, 2024 1:05 PM": (2024, 6, 5, 13, 5),
    "03-Jan-24": (2024, 1, 3),
    "3 Jan 24 5:00": (2024, 1, 3, 5),
    "3-Jan-98": (1998, 1, 3),
    "03-Jan-2024 10:11:12.123": (2024, 1, 3, 10, 11, 12, 123000),
    "3/January/2024 10:11": (2024, 1, 3, 10, 11),
    "2024.01.03": (2024, 1, 3),
    "20240103": (2024, 1, 3),
    "20240103 10:11": (2024, 1, 3, 10, 11),
    "Sept 3, 2024": (2024, 9, 3),
    "September 3 2024": (2024, 9, 3),
    "03/01/2024 00:30 AM": (2024, 1, 3, 0, 30),
    "20241303": None,
    "2024.5": None,
    "05/06/2024 13:05 PM": None,
    "31/31/2024": None,
    "2024-13-41": None,
    "NaT": None,
    "none": None,
    "": None,
    "soon": None,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "text string")
    got = dict(values(K.with_timestamps(df, {"at": F.col("text")}), "text", "at"))
    want = {t: v and dt.datetime(*v) for t, v in TIMES.items()} | {None: None}
    assert got == want


def test_each_step_of_a_timestamp_is_worked_out_once(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(K.timestamp(F.col("text")).alias("at"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(K._MONTH_DAY) == 1 and plan.count(K._COMPACT) == 2  # with and without letters


def test_month_names_around_clocks_and_no_letters(spark):
    texts = {"1 Sept 24 1 PM": (2024, 9, 1, 13), "Mon, 2nd Jan 2024 12 am": (2024, 1, 2), "20240131T": (2024, 1, 31), "2/13/70 7:08": (1970, 2, 13, 7, 8), "1/2/2024x": None}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert dict(values(K.with_timestamps(df, {"at": F.col("text")}), "text", "at")) == {t: v and dt.datetime(*v) for t, v in texts.items()}


def test_parsing_is_dealt_over_the_tasks(spark, tmp_path):
    from meterlake.plans.ingestion import parse_timestamps

    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp"
    rows = [(i, 1 + i % 3, i, dt.datetime(2000, 1, 1 + i % 28)) for i in range(200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sizes = parse_timestamps(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in sizes) == [50] * 4


def test_full_start(spark):
    rows = [
        ("10:11:12", "05/06/2024", "2024-06-07 01:00"), ("10:11", "NaT", "2024-06-07 01:00"), ("9:08:07.5", None, None),
        ("2024-06-05 10:11", "01/01/2020", None), (None, "01/01/2020", None),
    ]
    df = spark.createDataFrame(rows, "start string, audit string, end string")
    df = K.with_timestamps(df, {"a": F.col("audit"), "e": F.col("end")})
    df = K.with_full_start(df, "at", F.col("start"), [F.col("a"), F.col("e")], F.lit(dt.date(2024, 7, 1)))
    assert [r[0] for r in values(df, "at")] == [
        dt.datetime(2024, 6, 5, 10, 11, 12), dt.datetime(2024, 6, 7, 10, 11), dt.datetime(2024, 7, 1, 9, 8, 7, 500000),
        dt.datetime(2024, 6, 5, 10, 11), None,
    ]


@pytest.mark.parametrize("text, value", [
    ("12abc", None), ("nan", None), ("", None), (" 12 ", 12.0), ("1e3", 1000.0), ("-.5", -0.5), ("1d", None), (None, None), ("3.", 3.0),
])
def test_numbers(spark, text, value):
    assert values(spark.createDataFrame([(text,)], "t string"), K.number(F.col("t"))) == [(value,)]


def test_missing_words(spark):
    df = spark.createDataFrame([(t,) for t in (None, " ", "NA", " NaT ", "None", "nan", "x", "null")], "t string")
    assert [r[0] for r in values(df, K.is_missing(F.col("t")))] == [True] * 6 + [False] * 2


def test_prices(spark):
    df = spark.createDataFrame([(10.0, "Mass Ingestion"), (10.0, " Mass Ingestion "), (10.0, None), (float("nan"), "Task Usage"), (None, "")],
                               "metered_value double, log_type string")
    p = Pricing()
    assert [r[0] for r in values(df, P.units(F.col("metered_value"), p))] == [1.0, 1.0, 1.6, 0.0, 0.0]
    assert values(df.limit(1), P.units(F.col("metered_value"), p, override=0.5)) == [(5.0,)]
    assert values(df.limit(1), P.cost(F.lit(1.6), p)) == [(57.664,)]
    assert values(df.limit(1), P.cost(F.lit(1.6), Pricing(unit_cost=2.0))) == [(3.2,)]
    assert p.factor_for("Mass Ingestion") == 0.1 and p.factor_for(None) == 0.16


def test_effective_amounts(spark):
    df = spark.createDataFrame([(2.0, 9.0, 10.0, None), (2.0, None, 10.0, None), (None, None, 10.0, "Mass Ingestion"), (None, None, None, None)],
                               "ipus double, cost double, metered_value double, log_type string")
    p = Pricing()
    assert values(df, P.eff_ipus(p), F.round(P.eff_cost(p), 6)) == [(2.0, 9.0), (2.0, 72.08), (1.0, 36.04), (0.0, 0.0)]


def test_labels(spark):
    df = spark.createDataFrame([("A Mass Ingestion",), (" A ",), ("",), (None,)], "o string")
    assert values(df, B.base_org(F.col("o")), B.bulk_org(F.col("o"))) == [
        ("A", "A Mass Ingestion"), ("A", "A Mass Ingestion"), ("Unknown", "Unknown Mass Ingestion"), ("Unknown", "Unknown Mass Ingestion")]
    env = spark.createDataFrame([("E - AWS - old",), (" E ",), (" ",), (None,), ("Student Life",)], "e string")
    assert [r[0] for r in values(env, B.env_base(F.col("e")))] == ["E", "E", "Unknown", "Unknown", "Student Life"]


def test_display(spark):
    df = spark.createDataFrame([(dt.date(2026, 6, 5), dt.date(2026, 6, 5)), (dt.date(2026, 6, 5), dt.date(2026, 7, 12)), (None, None)], "a date, b date")
    assert values(df, B.display_range(F.col("a"), F.col("b")), B.iso_range(F.col("a"), F.col("b"))) == [
        ("June 5, 2026", "2026-06-05"), ("June 5, 2026 to July 12, 2026", "2026-06-05 to 2026-07-12"), ("", None)]
    v = spark.createDataFrame([(110.0, 100.0), (103.0, 100.0), (50.0, 100.0), (5.0, 0.0), (0.0, 0.0)], "c double, p double")
    assert values(v, B.percent_change(F.col("c"), F.col("p")), B.trend(F.col("c"), F.col("p"))) == [
        ("+10.0%", "up (+10%)"), ("+3.0%", "roughly flat"), ("-50.0%", "down (-50%)"), ("new", "new activity"), ("n/a", "flat")]
    assert values(v.limit(1), B.arrow(F.lit(-1234.5)), B.arrow(F.lit(0.0), 0)) == [("↓ 1,234.50", "↑ 0")]
