import datetime as dt
import glob
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import values
from meterlake.operators import ingest
from meterlake.operators.filters import TaskFilter
from meterlake.operators.numbering import numbered
from meterlake.operators.stats import org_stats
from meterlake.plans.views import tasks_tpch
from meterlake.sources import cell_store, files, history

NOW = dt.datetime(2024, 7, 1, 8)
RANGES = [("1996-01-15", "1996-01-20"), ("1996-02-01", "1996-02-29"), ("1996-01-31", "1996-03-31"), ("1980-01-01", "1981-01-01")]


@pytest.fixture(scope="module")
def priced(spark, sf, tmp_path_factory):
    """Rows of three months, some without a task id."""
    rows = tasks_tpch(spark, sf).withColumn("task_id", F.when(F.col("status") != "P", F.col("task_id")))
    path = str(tmp_path_factory.mktemp("priced"))
    ingest.price(rows).where("end_date between '1996-01-10' and '1996-03-20'").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored(spark, priced, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    history.append_tasks(spark, root, priced.where("end_date < '1996-03-01'"), NOW)
    cell_store.update_cells(spark, root)
    history.append_tasks(spark, root, priced.where("end_date >= '1996-02-20'"), NOW)
    history.delete_tasks(spark, root, TaskFilter("1996-02-10", "1996-02-14"), NOW)
    cell_store.update_cells(spark, root)
    return root


def expected(spark, root, start, end):
    return sorted(values(org_stats(history.read_history(spark, root), TaskFilter(start, end)), "org", "task_count", "total_ipus", "total_cost", "unique_tasks"))


def from_cells(spark, root, start, end):
    return sorted(values(cell_store.cell_stats(spark, root, start, end, "org"), "key", "task_count", "total_ipus", "total_cost", "unique_tasks"))


@pytest.mark.parametrize("days", RANGES)
def test_cells_equal_the_rows(spark, stored, days):
    assert from_cells(spark, stored, *days) == expected(spark, stored, *days)


def test_same_cells_as_of_a_fresh_history(spark, stored, tmp_path):
    fresh = str(tmp_path / "fresh")
    history.append_tasks(spark, fresh, history.read_history(spark, stored), NOW)
    cell_store.update_cells(spark, fresh)
    for dimension in ("all", "environment"):
        assert sorted(map(str, values(cell_store.day_cells(spark, fresh, *RANGES[2], dimension)))) == sorted(map(str, values(cell_store.day_cells(spark, stored, *RANGES[2], dimension))))


def test_bitmaps_and_lists_count_alike(spark, priced, tmp_path, monkeypatch):
    monkeypatch.setattr(cell_store, "FEW", 3)
    root = str(tmp_path)
    history.append_tasks(spark, root, priced, NOW)
    cell_store.update_cells(spark, root)
    bits = cell_store.id_bitmaps(spark, root, *RANGES[2], "org")
    assert bits.where("bits is not null").count() > 0 and bits.where("places is not null").count() > 0
    assert from_cells(spark, root, *RANGES[2]) == expected(spark, root, *RANGES[2])


def test_task_ids_are_numbered_before_rows_are_multiplied(spark, priced, tmp_path, monkeypatch):
    root, seen, whole = str(tmp_path), [], cell_store._by_dimension
    history.append_tasks(spark, root, priced.where("end_date < '1996-02-05'"), NOW)

    def by_dimension(rows, *others):
        seen.append({"number", "task_id"} & set(others))
        return whole(rows, *others)

    monkeypatch.setattr(cell_store, "_by_dimension", by_dimension)
    cell_store.update_cells(spark, root)
    assert seen == [set(), {"number"}]


def test_a_run_that_dies_leaves_the_old_cells(spark, priced, tmp_path, monkeypatch):
    root = str(tmp_path)
    history.append_tasks(spark, root, priced.where("end_date < '1996-02-15'"), NOW)
    cell_store.update_cells(spark, root)
    old = cell_store.current_cells(spark, cell_store.cells_path(root, cell_store.Pricing()))
    history.append_tasks(spark, root, priced, NOW)
    with pytest.raises(LookupError):
        cell_store.cell_stats(spark, root, *RANGES[2], "org")

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(files, "publish_text", dies)
        with pytest.raises(OSError):
            cell_store.update_cells(spark, root)
    assert cell_store.current_cells(spark, cell_store.cells_path(root, cell_store.Pricing())) == old
    assert len(cell_store.update_cells(spark, root)) == 1 and cell_store.update_cells(spark, root) == []
    assert from_cells(spark, root, *RANGES[2]) == expected(spark, root, *RANGES[2])


def test_empty_history(spark, tmp_path):
    assert cell_store.update_cells(spark, str(tmp_path)) == []
    assert from_cells(spark, str(tmp_path), *RANGES[0]) == []


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted(values(numbered(df, "k", 5))) == [(i, i + 5) for i in range(1000)]
    assert values(numbered(df.where("k < 0"), "k")) == []


def test_keys_are_short_before_the_shuffle_and_named_in_the_cells(spark, priced, tmp_path, monkeypatch):
    root, seen, packed = str(tmp_path), [], cell_store._packed

    def spied(rows, keys):
        seen.append(dict(rows.dtypes))
        return packed(rows, keys)

    monkeypatch.setattr(cell_store, "_packed", spied)
    for part in ("end_date < '1996-02-01'", "end_date >= '1996-02-01'"):
        history.append_tasks(spark, root, priced.where(part), NOW)
    made = cell_store.update_cells(spark, root)
    assert [(t["change"], t["dimension"], t["span"]) for t in seen] == [("int", "int", "int")]
    cells = spark.read.parquet(f"{cell_store.cells_path(root, cell_store.Pricing())}/bits")
    assert {r.dimension for r in cells.select("dimension").distinct().collect()} == set(cell_store.DIMENSIONS)
    assert {tuple(r) for r in cells.select("change", "span").distinct().collect()} == {(c, s) for c in made for s in ("day", "month")}


def test_rows_are_shuffled_once_before_they_are_multiplied_for_lists(spark, priced):
    met = priced.where("task_id is not null").withColumnsRenamed({"end_date": "day"}).select(
        *cell_store.DIMENSIONS[1:], "day", F.to_date(F.date_trunc("month", "day")).alias("end_month"), F.length("status").cast("int").alias("change"), F.col("task_id").cast("long").alias("number"),
    )
    met = met.withColumns({"bucket": F.bitmap_bucket_number("number"), "part": F.bitmap_bit_position("number").bitwiseAND(F.lit(0).cast("long"))}).repartitionByRange(3, "change", "end_month", "bucket", "part")
    with files.writing(spark, cell_store.SORTED):
        plan = cell_store._listed_places(met)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate inline(array(")]
    assert "Exchange" not in above and above.count("Sort [") == 1


def test_a_month_in_one_bucket_is_dealt_to_many_tasks(spark, priced, tmp_path, monkeypatch):
    dealt, whole = [], cell_store._listed_places

    def listed(met):
        dealt.append(met.select("part", F.spark_partition_id().alias("task")).distinct().collect())
        return whole(met)

    monkeypatch.setattr(cell_store, "TASK_ROWS", 20)
    monkeypatch.setattr(cell_store, "_listed_places", listed)
    root = str(tmp_path)
    history.append_tasks(spark, root, priced.where("end_date < '1996-02-01'"), NOW)
    cell_store.update_cells(spark, root)
    assert len({r.part for r in dealt[0]}) > 1 and len({r.task for r in dealt[0]}) > 1
    assert from_cells(spark, root, *RANGES[0]) == expected(spark, root, *RANGES[0])
    assert from_cells(spark, root, "1996-01-01", "1996-01-31") == expected(spark, root, "1996-01-01", "1996-01-31")


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    def shuffled():
        return {f for top in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()) for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data")}

    df = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n"))
    before = shuffled()
    with files.writing(spark):
        df.write.parquet(str(tmp_path / "t"))
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(next(iter(files.FREED))) == "false"


def test_history_files_have_no_dictionary_of_what_should_not_repeat(spark, priced, tmp_path):
    history.append_tasks(spark, str(tmp_path), priced.withColumns({"task_run_id": F.lit("a run"), "task_type": F.lit("a type")}), NOW)
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in tmp_path.glob("data/**/*.parquet")]
    coded = {(c.path_in_schema, c.has_dictionary_page) for g in groups if g.num_rows > 9 for c in map(g.column, range(g.num_columns))}
    assert ("task_type", True) in coded and not {("task_run_id", True), ("row_hash", True)} & coded


def test_rows_without_task_ids_have_sums(spark, priced, tmp_path):
    root = str(tmp_path)
    history.append_tasks(spark, root, priced.withColumn("task_id", F.lit(None).cast("string")), NOW)
    cell_store.update_cells(spark, root)
    assert cell_store.day_cells(spark, root, *RANGES[2], "all").count() > 0
    assert files.names(spark, f"{root}/_staging") == []
