import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import audit, monitor
from blockloom.operators.observe import Timings, observed

T0 = datetime(2024, 1, 1)
REQUEST = "ts timestamp, endpoint string, model string, status string, latency double"


def at(minutes, status="success", latency=1.0):
    return (T0 + timedelta(minutes=minutes), "e", "m", status, latency)


def test_counts_and_histogram(spark):
    df = spark.createDataFrame([at(0), at(1, "error", 0.1), at(2, latency=0.005), at(3, latency=99.0)], REQUEST)
    assert rows(monitor.request_counts(df)) == [("e", "m", "error", 1), ("e", "m", "success", 3)]
    got = {r["le"]: r["requests"] for r in monitor.latency_histogram(df).collect()}
    assert (got["0.005"], got["0.1"], got["0.75"], got["1.0"], got["10.0"], got["+Inf"]) == (1, 2, 2, 3, 3, 4)


def test_totals_and_running_average(spark):
    df = spark.createDataFrame([(1, 2, 25, 1.0), (2, 3, 30, 4.0)], "id long, n long, tokens long, latency double")
    assert rows(monitor.inference_totals(df, "n", "tokens", "latency")) == [(5, 55, 1.0)]
    assert rows(monitor.batch_stats(df, "n")) == [(2.5, 2, 3)]
    out = monitor.running_avg_latency(df, [], ["id"], "n", "latency")
    assert [r["avg_latency"] for r in out.orderBy("id").collect()] == [0.5, 1.0]


def test_last_and_rolling_means(spark):
    df = spark.range(15).select("id", F.col("id").cast("double").alias("v"))
    assert monitor.last_mean(df, ["id"], "v").first()[0] == 9.5
    got = [r["rolling_mean"] for r in monitor.rolling_mean(df, [], ["id"], "v").orderBy("id").collect()]
    assert got[0] == 0.0 and got[9] == 4.5 and got[14] == 9.5


def test_rates(spark):
    df = spark.createDataFrame([at(0), at(0.5), at(1)], REQUEST)
    assert [r["tps"] for r in monitor.tumbling_rate(df, [], "ts", F.lit(1)).orderBy("window_start").collect()] == [2 / 60, 1 / 60]
    out = monitor.sliding(df, [], "ts", {"n": ("sum", F.lit(1))}).orderBy("window_end").collect()
    assert [r["n"] for r in out] == [2, 3, 3, 3, 3, 1]


def test_error_rate_must_hold(spark):
    # One request per minute: errors from minute 10 to 19, with no data at all after minute 24.
    df = spark.createDataFrame([at(m, "error" if 10 <= m < 20 else "success") for m in range(25)], REQUEST)
    out = monitor.error_rate_alert(df).orderBy("window_end").collect()
    start = int(out[0]["window_end"]) - 60
    firing = [(r["window_end"] - start) // 60 for r in out if r["firing"]]
    held = [(r["window_end"] - start) // 60 for r in out if r["sustained"]]
    assert firing == list(range(11, 25)) and held == list(range(15, 25))


def test_gap_breaks_a_sustained_alert(spark):
    steps = spark.createDataFrame([(60 * m, True) for m in (1, 2, 3, 5, 6, 7, 8, 9)], "window_end long, bad boolean")
    out = monitor.sustained(steps, [], F.col("bad"))
    assert [r["window_end"] // 60 for r in out.filter("sustained").collect()] == [9]


def test_p95_and_rate_alerts(spark):
    df = spark.createDataFrame([at(0, latency=float(v)) for v in range(1, 22)], REQUEST)
    out = monitor.p95_latency_alert(df)
    assert {r["p95"] for r in out.collect()} == {20.0} and out.filter("sustained").count() == 1
    assert monitor.request_rate(df, threshold=0.05).filter("firing").count() == 5
    assert monitor.request_rate(df).filter("firing").count() == 0


def test_gauges_and_counters(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=m), "g", v) for i, (m, v) in enumerate([(0, 14.0), (1, 15.0), (2, 3.0), (20, 4.0)])], "id long, ts timestamp, s string, v double")
    assert monitor.gauge_alert(df, ["s"], "ts", "v", 14.0).filter("firing").count() == 1
    assert monitor.gauge_alert(df, ["s"], "ts", "v", 14.0, inclusive=True).filter("firing").count() == 2
    out = monitor.counter_increase(df, ["s"], ["ts", "id"], "ts", "v", minutes=5, step=5).orderBy("window_end").collect()
    # 14 -> 15 is 1, the drop to 3 is a reset worth 3, then 1
    assert [r["increase"] for r in out] == [4.0, 1.0]


def test_resample(spark):
    df = spark.createDataFrame([("cpu", T0 + timedelta(minutes=m), v) for m, v in [(0, 9.0), (61, 1.0), (64, 3.0), (70, 5.0)]], "s string, ts timestamp, v double")
    out = monitor.metric_resample(df, ["s"], "ts", "v", "2024-01-01 02:00:00")
    assert [r["average"] for r in out.orderBy("window_start").collect()] == [2.0, 5.0]
    assert rows(monitor.first_point(out, "s", ["cpu", "disk"])) == [("cpu", 2.0), ("disk", 0.0)]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([("a", 15.0), ("a", 15.1), ("b", 99.0)], "s string, v double")
    assert rows(monitor.threshold_alerts(df, "a", "s", "v", 15.0)) == [("a", 15.1)]


@pytest.mark.parametrize(
    "role,permission,allowed",
    [("admin", "can_train", True), ("engineer", "can_deploy", False), ("ghost", "can_monitor", False), (None, "can_use_models", True), (None, "can_monitor", False), ("analyst", "can_monitor", True)],
)
def test_permissions(spark, role, permission, allowed):
    df = spark.createDataFrame([(role, permission)], "role string, permission string")
    assert audit.authorized(df, F.col("role"), F.col("permission")).count() == int(allowed)


def test_revoked_tokens(spark):
    events = spark.createDataFrame([("a",), ("b",), ("c",)], "token string")
    listed = spark.createDataFrame([("a", datetime(2024, 2, 1)), ("b", datetime(2023, 1, 1)), ("a", datetime(2024, 3, 1))], "token string, exp timestamp")
    assert rows(audit.unrevoked(events, listed, "token", "2024-01-01")) == [("b",), ("c",)]


def test_lockout(spark):
    pattern = "fffsfffff"
    df = spark.createDataFrame([("u", i, T0 + timedelta(seconds=i), c == "f") for i, c in enumerate(pattern)] + [("v", 99, T0, True)], "u string, i long, ts timestamp, failed boolean")
    out = audit.lockout(df, "u", ["ts", "i"], "ts", F.col("failed")).filter("u = 'u'").orderBy("i").collect()
    assert [r["consecutive_failures"] for r in out] == [1, 2, 3, 0, 1, 2, 3, 4, 5]
    assert [r["locked"] for r in out] == [False, False, True, False, False, False, True, True, True]
    assert out[2]["locked_until"] == T0 + timedelta(seconds=302) and out[3]["locked_until"] is None


def test_observation_and_timings(spark):
    df, seen = observed(spark.range(7), "rows", n=F.count(F.lit(1)), top=F.max("id"))
    df.collect()
    assert seen.get == {"n": 7, "top": 6}
    timings = Timings()

    @timings.measure
    def work():
        return 5

    assert work() == work() == 5 and timings.summary()["work"]["calls"] == 2


def test_small_latencies_are_not_rounded_away(spark):
    df = spark.createDataFrame([(i, "k", i, 1, 0.004) for i in range(10)], "id long, k string, ts long, n long, latency double")
    assert monitor.last_mean(df, ["id"], "latency").first()[0] == pytest.approx(0.004)
    ran = monitor.running_avg_latency(df, ["k"], ["id"], "n", "latency")
    assert all(r.avg_latency == pytest.approx(0.004) for r in ran.collect())
    requests = df.select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("ts"), "latency")
    alerts = monitor.p95_latency_alert(requests, threshold=0.003).collect()
    assert alerts and all(r.firing and r.p95 == pytest.approx(0.004) for r in alerts)


@pytest.mark.parametrize(("minutes", "step"), [(5, 2), (5, 1), (4, 2), (1, 3), (15, 5)])
def test_sliding_windows_of_any_length_and_step(spark, minutes, step):
    at = [0, 59, 60, 170, 300, 301, 1000, 1001, 1500]
    df = spark.createDataFrame([(s,) for s in at], "s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.window_end: r.n for r in monitor.sliding(df, [], "ts", {"n": ("sum", F.lit(1))}, minutes, step).collect()}
    ends = range(0, 4000, step * 60)
    want = {e: sum(e - minutes * 60 <= s < e for s in at) for e in ends}
    assert got == {e: n for e, n in want.items() if n}


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.95, 1.0])
def test_window_quantile_is_exact(spark, quantile):
    rng = random.Random(12)
    odd = [0.0, -0.0, -1.5, 1e-300, 1e300, float("inf"), float("-inf"), 2.0, 2.0, 2.0000000001, None]
    data = [(rng.randrange(0, 2000), rng.choice(odd) if rng.random() < 0.3 else rng.lognormvariate(0, 0.02)) for _ in range(3000)]
    df = spark.createDataFrame(data, "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v")
    got = {r["window_end"]: r["q"] for r in monitor.window_quantile(df, "ts", "v", quantile, "q").collect()}
    expected = {}
    for end in range(60, 2401, 60):
        values = sorted(v for s, v in data if end - 300 <= s < end and v is not None)
        if values:
            at = quantile * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            expected[end] = low if low == high else low + (high - low) * (at - math.floor(at))
    assert got.keys() == expected.keys()
    assert all(got[k] == expected[k] or math.isnan(got[k]) and math.isnan(expected[k]) for k in got)


def test_window_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "ts timestamp, v double")
    assert monitor.window_quantile(df, "ts", "v", 0.95, "q").collect() == []
