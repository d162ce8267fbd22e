import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.session import work_dir
from blockloom.sources import committed


def test_a_repeated_run_replaces_its_rows(spark):
    path = work_dir(spark, "t")
    committed.commit(spark.range(3), path, "a")
    committed.commit(spark.range(10, 12), path, "b/2024-01-01 00:00")
    committed.commit(spark.range(5), path, "a")
    assert rows(committed.read(spark, path)) == [(i,) for i in (0, 1, 10, 11, 2, 3, 4)]
    assert rows(committed.read(spark, path, version=2)) == [(0,), (1,), (10,), (11,), (2,)]


def test_what_was_not_published_is_not_there(spark):
    path = work_dir(spark, "t")
    assert committed.snapshot(spark, path) == []
    with pytest.raises(ValueError):
        committed.read(spark, path)
    committed.stage(spark.range(3), path, "a")  # killed before it was published
    assert committed.snapshot(spark, path) == []
    committed.commit(spark.range(4), path, "a")
    broken = spark.range(100).withColumn("id", F.expr("if(id = 99, raise_error('stop'), id)").cast("long"))
    with pytest.raises(Exception, match="stop"):
        committed.commit(broken, path, "a")
    assert committed.read(spark, path).count() == 4


def test_once(spark):
    path = work_dir(spark, "t")
    assert committed.commit(spark.range(3), path, "0", once=True)
    assert not committed.commit(spark.range(9), path, "0", once=True)
    assert committed.read(spark, path).count() == 3


def test_partitions_new_columns_and_empty_runs(spark):
    path = work_dir(spark, "t")
    committed.commit(spark.range(4).withColumn("part", F.col("id") % 2), path, "a", ["part"])
    committed.commit(spark.range(4, 6).withColumns({"part": F.lit(7).cast("long"), "note": F.lit("n")}), path, "b", ["part"])
    committed.commit(spark.range(0).withColumns({"part": F.lit(7).cast("long"), "note": F.lit("n")}), path, "c", ["part"])
    got = committed.read(spark, path)
    assert rows(got.select("id", "part", "note")) == [(0, 0, None), (1, 1, None), (2, 0, None), (3, 1, None), (4, 7, "n"), (5, 7, "n")]
    assert got.filter("part = 7").count() == 2


def test_compaction_keeps_the_rows(spark):
    path = work_dir(spark, "t")
    for k in range(4):
        committed.commit(spark.range(10 * k, 10 * k + 3), path, str(k))
    before = rows(committed.read(spark, path))
    assert committed.compact(spark, path) == 4
    assert len(committed.snapshot(spark, path)) == 1 and rows(committed.read(spark, path)) == before
    assert not committed.commit(spark.range(1), path, "2", once=True)
    with pytest.raises(ValueError):
        committed.commit(spark.range(1), path, "2")
    committed.commit(spark.range(90, 91), path, "4")
    assert committed.compact(spark, path, merge=lambda df: df.filter("id < 90")) == 2
    assert rows(committed.read(spark, path)) == before
