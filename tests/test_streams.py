import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import audit, lifecycle, monitor
from blockloom.session import work_dir
from blockloom.sources import committed
from blockloom.streaming import stateful, streams, uniques

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, series string, value double"


@pytest.fixture()
def landed(spark):
    """Two files, read one per micro-batch: the second continues the first."""
    path = work_dir(spark, "in")

    def data(start, stop):
        return [(i, T0 + timedelta(seconds=4 * i), "a" if i % 3 else "b", float(i % 7)) for i in range(start, stop)]

    for part in ((0, 40), (40, 90)):
        spark.createDataFrame(data(*part), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return streams.sample_stream(spark, path, SCHEMA, max_files=1)


def beat():
    return F.col("event_id") < 0


def shuffled(spark, data, files, seed=3):
    """Files of rows in no order, then a heartbeat a day later."""
    path, order = work_dir(spark, "in"), random.Random(seed).sample(data, len(data))
    for k in range(files):
        spark.createDataFrame(order[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    last = (-1, max(row[1] for row in data) + timedelta(days=2), None, None)
    spark.createDataFrame([last], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def alerts(n, step=4):
    return [(i, T0 + timedelta(seconds=step * (i - i % 2)), "abc"[i * i % 3], float(i % 7)) for i in range(n)]


KEYS = ["series", "window_start"]


def test_windows_equal_the_batch_form(spark):
    out, data = work_dir(spark, "out"), alerts(200)
    path = shuffled(spark, data, 5)
    for name, files in (("one", 1), ("two", 2), ("all", 100)):
        samples = streams.sample_stream(spark, path, SCHEMA, max_files=files).filter(~beat())
        totals = streams.window_totals(samples, ["series"], "ts", F.lit(1), delay="1 day")
        streams.run_upserts(totals, f"{out}/{name}", f"{out}/c{name}", KEYS, merge_every=2)
        newest = streams.newest_rows(spark, f"{out}/{name}", KEYS)
        batch = spark.createDataFrame(data, SCHEMA)
        assert rows(streams.tumbling_tps(newest, ["series"])) == rows(monitor.tumbling_rate(batch, ["series"], "ts", F.lit(1)))
        sliding = monitor.sliding(batch, ["series"], "ts", {"n": ("sum", F.lit(1))})
        expected = sliding.select("series", F.timestamp_seconds("window_end").alias("window_end"), (F.col("n") / 300.0).alias("tps"))
        assert rows(streams.sliding_tps(newest, ["series"])) == rows(expected)


def test_a_repeated_micro_batch_changes_nothing(spark):
    path = work_dir(spark, "out")
    handle = streams.upsert_to(path)
    first = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 2.0)], "series string, window_start long, total double")
    later = spark.createDataFrame([("a", 1, 3.0)], first.schema)
    handle(first, 0)
    handle(later, 1)
    expected = [("a", 1, 3.0), ("b", 1, 2.0)]
    assert rows(streams.newest_rows(spark, path, KEYS)) == expected
    handle(first, 0)  # replayed
    assert rows(streams.newest_rows(spark, path, KEYS)) == expected
    committed.stage(first.withColumn("_version", F.lit(2).cast("long")), path, "000000000002")  # cut off before its commit
    assert rows(streams.newest_rows(spark, path, KEYS)) == expected
    handle(first, 2)
    assert rows(streams.newest_rows(spark, path, KEYS)) == [("a", 1, 5.0), ("b", 1, 2.0)]


@pytest.mark.parametrize("files", [1, 2, 100])
def test_debounce_in_event_time(spark, files):
    out, data = work_dir(spark, "out"), alerts(150)
    path = shuffled(spark, data, 6)
    samples = streams.sample_stream(spark, path, SCHEMA, max_files=files)
    streams.run_to_table(stateful.debounce(samples, "series", "ts", 10, "1 day", beat()), f"{out}/t", f"{out}/c")
    batch = monitor.debounce(spark.createDataFrame(data, SCHEMA), ["series"], "ts", 10)
    assert rows(spark.read.parquet(f"{out}/t").select("series", "ts")) == rows(batch.select("series", "ts"))


@pytest.mark.parametrize("files", [1, 100])
def test_lockout_in_event_time(spark, files):
    out, data, failed = work_dir(spark, "out"), alerts(150), F.col("value") > 1
    path = shuffled(spark, data, 6)
    samples = streams.sample_stream(spark, path, SCHEMA, max_files=files)
    streams.run_to_table(stateful.lockout(samples, "series", "ts", failed, delay="1 day", heartbeat=beat()), f"{out}/t", f"{out}/c")
    batch = audit.lockout(spark.createDataFrame(data, SCHEMA), "series", ["ts", "event_id"], "ts", failed)
    columns = ["event_id", "consecutive_failures", "locked", "locked_until"]
    assert rows(spark.read.parquet(f"{out}/t").select(columns)) == rows(batch.select(columns))


def test_lockout_forgets_users_that_stay_away(spark):
    out = work_dir(spark, "out")
    data = [(i, T0 + timedelta(seconds=s), "u", 2.0) for i, s in enumerate((0, 10, 200, 210, 220, 500))]
    path = shuffled(spark, data, 2)
    samples = streams.sample_stream(spark, path, SCHEMA, max_files=1)
    locked = stateful.lockout(samples, "series", "ts", F.col("value") > 1, delay="1 day", heartbeat=beat(), forget=100)
    query = streams.run_to_table(locked, f"{out}/t", f"{out}/c")
    got = spark.read.parquet(f"{out}/t").orderBy("event_id").select("consecutive_failures", "locked").collect()
    assert [tuple(r) for r in got] == [(1, False), (2, False), (1, False), (2, False), (3, True), (1, False)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_state_is_bounded_by_the_delay(spark):
    """Keys come and go; what is held after each micro-batch are rows of the last minutes only."""
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    for k in range(12):
        data = [(40 * k + i, T0 + timedelta(minutes=5 * k, seconds=i), f"k{k}-{i % 20}", 1.0) for i in range(40)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    fired = stateful.debounce(stream(spark, path), "series", "ts", 10, "1 minute")
    query = streams.run_to_table(fired, f"{out}/t", f"{out}/c")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # At most two files of 20 keys: each a waiting list, an alarm, a last time and a timer's entries.
    assert len(held) >= 12 and max(held) <= 2 * 20 * 8 and held[-1] <= 20 * 8
    assert spark.read.parquet(f"{out}/t").count() == 11 * 40  # a second alert comes 20 s later; the last file still waits


def test_rows_later_than_the_delay_are_dropped(spark):
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    for at in (0, 600, 1, 1200):
        spark.createDataFrame([(at, T0 + timedelta(seconds=at), "a", 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    streams.run_to_table(stateful.debounce(stream(spark, path), "series", "ts", 10, "1 minute"), f"{out}/t", f"{out}/c")
    assert [r["ts"] for r in spark.read.parquet(f"{out}/t").orderBy("ts").collect()] == [T0, T0 + timedelta(seconds=600)]


def test_uniques_have_no_time_limit(spark):
    path, out = work_dir(spark, "in"), work_dir(spark, "out")
    files = [[(i, day, f"h{i % 40}") for i in range(60)] for day in (0, 90, 200)] + [[(99, 300, "new"), (98, 300, None)], [(97, 400, None)]]
    def land(data):
        frame = spark.createDataFrame([(i, T0 + timedelta(days=day), key, 0.0) for i, day, key in data], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(path)
    for data in files[:3]:
        land(data)
    run = lambda: uniques.unique_stream(stream(spark, path), "series", ["ts", "event_id"], f"{out}/t", f"{out}/c", buckets=4, merge_every=2)
    run()
    for data in files[3:]:
        land(data)
    run()  # a restart goes on where the last run ended
    got = rows(uniques.read_uniques(spark, f"{out}/t").select("series", "event_id", "ts"))
    expected = [(f"h{i}", i, T0) for i in range(40)] + [("new", 99, T0 + timedelta(days=300)), (None, 98, T0 + timedelta(days=300))]
    assert got == sorted(expected, key=repr)


def test_uniques_after_a_crash(spark):
    path = work_dir(spark, "keys")
    frame = spark.createDataFrame([(i, T0, f"k{i % 5}", 0.0) for i in range(20)], SCHEMA)
    more = spark.createDataFrame([(100 + i, T0, f"k{i}", 0.0) for i in range(9)], SCHEMA)
    assert uniques.keep_unseen(frame, "0", "series", ["ts", "event_id"], path, 2)
    # Cut off after the filters, before the rows were published.
    fresh = uniques.unseen(more, "series", ["ts", "event_id"], path, 2)
    committed.stage(fresh, f"{path}/rows", "1")
    committed.commit(uniques.filters(fresh, "series"), f"{path}/filters", "1")
    assert uniques.keep_unseen(more, "1", "series", ["ts", "event_id"], path, 2)
    assert not uniques.keep_unseen(more, "1", "series", ["ts", "event_id"], path, 2)
    assert rows(uniques.read_uniques(spark, path).select("event_id", "series")) == [(0, "k0"), (1, "k1"), (105, "k5"), (106, "k6"), (107, "k7"), (108, "k8"), (2, "k2"), (3, "k3"), (4, "k4")]


def test_filters_know_what_was_added(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(0).alias("_bucket"))
    bits = uniques.filters(keys, "key")
    probe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id").crossJoin(bits)
    known = probe.filter(F.forall(uniques._positions(F.col("key")), lambda at: uniques._is_set(F.col("bits"), at)))
    found = {r["id"] for r in known.select("id").collect()}
    assert set(range(2000)) <= found and len(found) < 2000 + 4000 * 0.02


def test_alert_callback_once_per_sample(spark, landed):
    seen = []
    streams.alert_on(
        stream(spark, landed), "a", "series", "value", 5.0, lambda df, i: seen.extend(r["event_id"] for r in df.collect()), work_dir(spark, "c")
    )
    expected = [i for i in range(90) if i % 3 and i % 7 > 5]
    assert sorted(seen) == expected


def test_backup_worker(spark, landed):
    root = work_dir(spark, "b")
    streams.backup_worker(stream(spark, landed), root, "samples", "2024-01-02", f"{root}/c")
    names = [r["backup_id"] for r in lifecycle.list_backups(lifecycle.read_catalog(spark, root)).collect()]
    assert len(names) == 2
    assert sum(lifecycle.restore_backup(spark, [root], n, SCHEMA).count() for n in names) == 90


def test_poll_runs_until_stopped(spark, landed):
    seen = []
    query = streams.poll(stream(spark, landed), lambda df, i: seen.append(df.count()), work_dir(spark, "c"), seconds=1)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(seen) == 90


def test_quality_per_micro_batch(spark):
    root = work_dir(spark, "q")
    schema = "id long, timestamp string, blocks array<struct<number: long, hash: string, timestamp: timestamp, transactions: array<struct<hash: string>>>>, metrics struct<n: long>, transaction_metrics struct<total_transactions: long>"
    good = (1, "t", [(1, "h", T0, [("x",)])], (1,), None)
    bad = (2, "t", [(1, None, None, [(None,), (None,)])], None, None)
    for row in (good, bad):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    touched = spark.sparkContext.accumulator(0)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    source = source.withColumn("id", F.pandas_udf(touch_series(touched), "long")("id"))
    figures = {}
    streams.ingest_with_quality(source, "ingest", "2024-01-01", f"{root}/t", f"{root}/c", figures.__setitem__)
    assert [r["id"] for r in streams.accepted(spark, f"{root}/t").collect()] == [1]
    table = streams.quality_table(spark, f"{root}/t", "id")
    scores = {r["id"]: r["score"] for r in table.collect()}
    assert table.columns == ["id", "timestamp", "stage", "score", "report"] and set(scores) == {1, 2}
    assert {k: (f["rows"], f["passed"]) for k, f in figures.items()} == {0: (1, 1), 1: (1, 0)}
    assert [figures[k]["mean_score"] for k in (0, 1)] == [scores[1], scores[2]]
    assert touched.value == 2  # every document was computed once


def touch_series(touched):
    def run(ids: pd.Series) -> pd.Series:
        touched.add(len(ids))
        return ids

    return run
