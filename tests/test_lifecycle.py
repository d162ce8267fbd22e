from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.functions.crypto import encrypt
from blockloom.operators import lifecycle
from blockloom.session import work_dir
from blockloom.sources import committed

AS_OF = "2024-06-30 00:00:00"


def test_block_shaping(spark):
    schema = "blockchain string, block_height long, slot long, hash string, blockhash string, timestamp timestamp, transaction_count long"
    now = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [
            ("ethereum", 5, None, "h5", None, now, 3),
            ("ethereum", 5, None, "h5", None, now, 4),
            ("solana", 0, 7, "", "s7", now, 0),
            ("solana", None, 8, None, "s8", None, 1),
            ("solana", None, None, "x", None, now, 1),
        ],
        schema,
    )
    out = lifecycle.normalize_blocks(df)
    assert rows(out.select("block_number", "block_hash", "transaction_count")) == [(5, "h5", 3), (7, "s7", 0)]
    assert rows(lifecycle.new_blocks(out, out.filter("block_number = 5")).select("block_hash")) == [("s7",)]
    assert rows(lifecycle.derive_block_metrics(out).select("block_number", "metric_type", "value")) == [(5, "tps", 3.0), (7, "tps", 0.0)]


def test_metrics_in_range(spark):
    df = spark.createDataFrame([("tps", datetime(2024, 1, d), float(d)) for d in (3, 1, 2, 9)] + [("gas", datetime(2024, 1, 2), 0.0)], "metric_type string, timestamp timestamp, value double")
    got = lifecycle.metrics_in_range(df, "tps", "2024-01-01", "2024-01-03")
    assert [r["value"] for r in got.collect()] == [1.0, 2.0, 3.0]


def test_landing(spark):
    path = work_dir(spark, "land")
    df = spark.createDataFrame([(1, '{"model":"m","predictions":[1]}'), (2, '{"model":"m"}')], "id long, body string")
    assert not lifecycle.land_raw(df, "ai_models", "body", path, "20240101_000000")
    assert not lifecycle.land_raw(df.limit(0), "ai_models", "body", path, "20240101_000000")
    assert lifecycle.land_raw(df.filter("id = 1"), "ai_models", "body", path, "20240101_000000")
    assert spark.read.json(f"{path}/category=raw/subcategory=ai_models/ingest_ts=20240101_000000").count() == 1
    with pytest.raises(ValueError):
        lifecycle.land_raw(df, "features", "body", path, "x")


def test_zone_check(spark):
    df = spark.createDataFrame([("raw", "sensors"), ("raw", "features"), ("junk", "x"), (None, None)], "category string, subcategory string")
    assert [r["valid"] for r in lifecycle.zone_check(df).collect()] == [True, False, False, False]


def test_envelope_and_read_back(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, None)], "id long, at timestamp")
    out = lifecycle.envelope(df, "kind", AS_OF, ["id"], keys=("id",), ts=F.col("at")).orderBy("id")
    first, second = out.collect()
    assert first["payload"] == '{"id":1}' and '"version":"1.0"' in first["metadata"]
    assert second["timestamp"] == datetime(2024, 6, 30)
    key = F.lit("0123456789abcdef").cast("binary")
    stored = out.withColumn("payload", encrypt(F.col("payload"), key))
    assert lifecycle.latest_processed(stored, "2024-01-01", "2024-12-31", key).first()["payload"] == '{"id":2}'
    assert lifecycle.latest_processed(stored, "2025-01-01", "2025-12-31", key).count() == 0
    other = F.lit("fedcba9876543210").cast("binary")
    assert lifecycle.latest_processed(stored, "2024-01-01", "2024-12-31", other).first()["payload"] is None
    blank = out.withColumn("payload", F.lit(""))
    assert lifecycle.latest_processed(blank, "2024-01-01", "2024-12-31").count() == 0


def table(spark):
    data = [(1, datetime(2024, 5, 1), False), (2, datetime(2024, 5, 20), None), (3, datetime(2024, 6, 29), False), (4, datetime(2024, 4, 1), True)]
    return spark.createDataFrame(data, "id long, timestamp timestamp, compressed boolean")


def test_archive_and_restore(spark):
    root = work_dir(spark, "arch")
    df = table(spark)
    plan = lifecycle.archive_plan(df, "t", AS_OF).first()
    assert (plan["n_rows"], plan["start_time"], plan["end_time"]) == (2, datetime(2024, 5, 1), datetime(2024, 5, 20))
    lifecycle.archive_write(df, "t", AS_OF, f"{root}/archive", f"{root}/live")
    live, archived = spark.read.parquet(f"{root}/live"), spark.read.parquet(f"{root}/archive")
    assert [r["id"] for r in live.filter("compressed").orderBy("id").collect()] == [1, 2, 4]
    assert sorted(r["id"] for r in archived.collect()) == [1, 2]
    # A second run finds nothing more to archive.
    assert lifecycle.archive_plan(live, "t", AS_OF).first()["n_rows"] == 0
    left = df.filter("id >= 3")
    back = lifecycle.archive_restore(left, archived, "id", "2024-05-01", "2024-05-10")
    assert sorted(r["id"] for r in back.collect()) == [1, 3, 4]
    twice = lifecycle.archive_restore(back, archived, "id", "2024-05-01", "2024-05-30")
    assert sorted(r["id"] for r in twice.collect()) == [1, 2, 3, 4]


def test_months(spark):
    path = work_dir(spark, "months")
    for _ in range(2):
        lifecycle.write_by_month(table(spark), path, "first")
    assert committed.read(spark, path).filter("month = '2024_05'").count() == 2
    lifecycle.write_by_month(table(spark), path, "second")
    assert committed.read(spark, path).filter("month = '2024_05'").count() == 4
    assert rows(lifecycle.rows_per_month(table(spark))) == [("2024_04", 1), ("2024_05", 2), ("2024_06", 1)]


def test_backups(spark):
    root = work_dir(spark, "backup")
    df = spark.createDataFrame([("a", None), ("b", 2)], "id string, n long")
    first = lifecycle.write_backup(df, root, "full", "2024-01-01T00:00:00")
    second = lifecycle.write_backup(df.limit(1), root, "full", "2024-03-01T00:00:00")
    lifecycle.write_backup(df.limit(1), root, "full", "2024-03-01T00:00:00")
    schema = "id string, n long"
    assert rows(lifecycle.restore_backup(spark, [f"{root}/none", root], first, schema)) == rows(df)
    assert lifecycle.restore_backup(spark, [root], "full_never", schema) is None
    catalog = lifecycle.read_catalog(spark, root)
    assert [r["backup_id"] for r in lifecycle.list_backups(catalog).collect()] == [second, first]
    plan = lifecycle.retention_plan(catalog, 60, "2024-03-01 12:00:00")
    assert rows(plan.select("age_days", "expired")) == [(0, False), (60, False)]
    late = lifecycle.retention_plan(catalog, 59, "2024-03-01 12:00:00")
    assert rows(late.select("expired")) == [(False,), (True,)]
    assert lifecycle.purge_backups(late, root) == 1
    assert [r["backup_id"] for r in lifecycle.read_catalog(spark, root).collect()] == [second]
    assert lifecycle.restore_backup(spark, [root], first, schema) is None


@pytest.mark.parametrize(
    "days,storage,policy,action",
    [
        (30, "local", None, "none"),
        (31, "local", "hot_storage", "none"),
        (90, "local", "hot_storage", "none"),
        (91, "local", "warm_storage", "archive"),
        (91, "archive", "warm_storage", "none"),
        (365, "archive", "warm_storage", "none"),
        (366, "archive", "cold_storage", "s3_glacier"),
        (400, "s3_glacier", "cold_storage", "none"),
        (None, "local", None, "none"),
    ],
)
def test_tiers(spark, days, storage, policy, action):
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(days)) if days else F.lit(None).cast("timestamp")
    item = spark.range(1).select(created.alias("created_at"), F.lit(storage).alias("storage_class"))
    row = lifecycle.lifecycle_plan(item, AS_OF).first()
    assert (row["policy"], row["action"]) == (policy, action)


def test_tier_moves_and_deletes(spark):
    path = work_dir(spark, "tiers")
    items = spark.createDataFrame([(1, datetime(2020, 1, 1), "local"), (2, datetime(2024, 6, 1), "local"), (3, datetime(2024, 1, 1), "local")], "id long, created_at timestamp, storage_class string")
    policies = [("keep", 100, "archive"), ("drop", 1000, "delete")]
    for _ in range(2):
        lifecycle.lifecycle_apply(lifecycle.lifecycle_plan(items, AS_OF, policies), path, AS_OF)
    out = committed.read(spark, path)
    assert rows(out.select("id", "storage_class")) == [(2, "local"), (3, "archive")]
    assert out.filter("moved_at is not null").count() == 1


def test_repeated_runs_change_nothing(spark):
    root = work_dir(spark, "repeat")
    good = spark.createDataFrame([('{"sensor_id":1,"timestamp":"t","readings":{}}',)], "body string")
    for _ in range(2):
        assert lifecycle.land_raw(good, "sensors", "body", f"{root}/raw", "2024-01-01")
    assert lifecycle.land_raw(good, "sensors", "body", f"{root}/raw", "2024-01-02")
    assert spark.read.json(f"{root}/raw").count() == 2
    assert not lifecycle.land_raw(good.limit(0), "sensors", "body", f"{root}/raw", "2024-01-03")

    data = [(1, datetime(2020, 1, 1), False), (2, datetime(2020, 2, 1), False), (3, datetime(2024, 6, 1), False)]
    df = spark.createDataFrame(data, "id long, timestamp timestamp, compressed boolean")
    for _ in range(2):
        lifecycle.archive_write(df, "t", "2024-06-02", f"{root}/archive", f"{root}/live")
    lifecycle.archive_write(df, "other", "2024-06-02", f"{root}/archive", f"{root}/live2")
    archived, live = spark.read.parquet(f"{root}/archive"), spark.read.parquet(f"{root}/live")
    assert archived.count() == 4 and live.count() == 3
    back = lifecycle.archive_restore(live.filter("id <> 2"), archived, "id", "2019-01-01", "2021-01-01", table="t")
    assert rows(back.select("id", "compressed")) == [(1, False), (2, False), (3, False)]
