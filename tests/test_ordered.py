"""Ordered scans against plain Python, with one key that holds most rows."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import monitor, ordered
from blockloom.operators.ordered import Running

START = datetime(2024, 1, 1)


def skewed(n=600, seed=1, spread=4000):
    """(key, second, id, value): two thirds of the rows under one key, many equal times."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.67 else f"k{rnd.randrange(6)}", rnd.randrange(spread), i, rnd.randrange(1000)) for i in range(n)]


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "k string, s long, id long, v long")


@pytest.mark.parametrize("kind", ["sum", "min", "max", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_running(frame, kind, inclusive, backward):
    out = ordered.scan(frame, ["k"], ["s", "id"], [Running("r", kind, F.col("v"), inclusive, backward)])
    expected = {}
    fold = {"sum": sum, "min": min, "max": max, "last": lambda xs: xs[-1]}[kind]
    for group in by_key(skewed()).values():
        seq = group[::-1] if backward else group
        for i, row in enumerate(seq):
            seen = [r[3] for r in seq[: i + inclusive]]
            expected[row[2]] = fold(seen) if seen else None
    assert {r["id"]: r["r"] for r in out.collect()} == expected


def test_running_skips_nulls_and_keeps_null_keys(spark):
    data = [(None, 1, 5), (None, 2, None), ("a", 1, None), ("a", 2, 7), ("a", 3, None)]
    df = spark.createDataFrame(data, "k string, s long, v long")
    out = ordered.scan(df, ["k"], ["s"], [Running("r", "last", F.col("v")), Running("n", "sum", F.lit(1))])
    assert rows(out.select("k", "s", "r", "n")) == sorted(
        [(None, 1, 5, 1), (None, 2, 5, 2), ("a", 1, None, 1), ("a", 2, 7, 2), ("a", 3, 7, 3)], key=repr
    )


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "k string, s long, v long")
    assert ordered.number_rows(df, ["k"], ["s"]).count() == 0


def test_unknown_kind(frame):
    with pytest.raises(ValueError):
        ordered.scan(frame, ["k"], ["s", "id"], [Running("r", "median", F.col("v"))])


def test_number_rows_without_keys(frame):
    out = ordered.number_rows(frame, [], ["s", "id"])
    expected = {r[2]: i + 1 for i, r in enumerate(sorted(skewed(), key=lambda r: (r[1], r[2])))}
    assert {r["id"]: r["row_no"] for r in out.collect()} == expected


def test_rolling_rows_across_chunks(frame):
    out = ordered.rolling_rows(frame, ["k"], ["s", "id"], 5, [("total", F.sum("v"))], chunk=7)
    expected = {}
    for group in by_key(skewed()).values():
        for i, row in enumerate(group):
            expected[row[2]] = sum(r[3] for r in group[max(0, i - 4) : i + 1])
    assert {r["id"]: r["total"] for r in out.collect()} == expected


def test_trailing_range(spark, frame):
    timed = frame.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("s")))
    out = ordered.trailing_range(timed, ["k"], "ts", F.col("v"), 300_000_000)
    got = {(r["k"], int(r["ts"].replace(tzinfo=timezone.utc).timestamp()) - 1704067200): (r["sum"], r["n"], r["min"], r["max"]) for r in out.collect()}
    expected = {}
    for key, group in by_key(skewed()).items():
        for row in group:
            seen = [r[3] for r in group if row[1] - 300 <= r[1] <= row[1]]
            expected[(key, row[1])] = (sum(seen), len(seen), min(seen), max(seen))
    assert got == expected


def test_trailing_stats_flat_range(spark):
    df = spark.createDataFrame([("a", START, 0.5), ("a", START + timedelta(minutes=5), 0.5)], "k string, ts timestamp, v double")
    out = monitor.trailing_stats(df, ["k"], "ts", "v").orderBy("ts").select("samples", "mean", "lower", "upper")
    assert [tuple(r) for r in out.collect()] == [(1, 0.5, 0.0, 1.5), (2, 0.5, 0.0, 1.5)]


@pytest.mark.parametrize("n", [1, 2, 5, 250])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    data = [(rnd.choice("ab"), rnd.randrange(40) / 4) for _ in range(n)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    out = ordered.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, moments=True)
    for r in out.collect():
        values = [v for k, v in data if k == r["k"] and v is not None]
        assert [r["p50"], r["p95"], r["p0"], r["p100"]] == pytest.approx(np.percentile(values, [50, 95, 0, 100]))
        assert (r["n"], r["min"], r["max"]) == (len(values), min(values), max(values))
        assert r["mean"] == pytest.approx(np.mean(values))


def test_as_of(spark):
    rnd = random.Random(3)
    points = [("hot", rnd.randrange(500), i) for i in range(200)] + [("b", 10, 1)]
    probes = [("hot", rnd.randrange(600)) for _ in range(100)] + [("b", 9), ("b", 10), ("none", 5)]

    def at(df):
        return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")

    out = ordered.as_of(
        at(spark.createDataFrame(points, "k string, s long, n long")),
        at(spark.createDataFrame(probes, "k string, s long")),
        ["k"],
        "ts",
        "n",
    ).select("k", F.unix_timestamp("ts").alias("s"), "n")
    expected = set()
    for key, s in set(probes):
        best = max(((ps, pn) for pk, ps, pn in points if pk == key and ps <= s), default=(0, 0))
        expected.add((key, s, best[1]))
    assert {tuple(r) for r in out.collect()} == expected


def brute_debounce(data, seconds):
    fired = set()
    for key in {k for k, _ in data}:
        last = None
        for s in sorted(s for k, s in data if k == key):
            if last is None or s - last >= seconds:
                fired.add((key, s))
                last = s
    return fired


@pytest.mark.parametrize("spread,seconds", [(3000, 10), (300, 10), (100000, 10), (900, 60), (40, 100)])
def test_debounce(spark, spread, seconds):
    data = [(k, s) for k, s, _, _ in skewed(500, seed=spread, spread=spread)]
    df = spark.createDataFrame(data, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    out = monitor.debounce(df, ["k"], "ts", seconds).select("k", F.unix_timestamp("ts"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_debounce(data, seconds))


def test_debounce_of_keys_of_other_types(spark):
    data = [(None if i % 5 == 0 else START + timedelta(days=i % 3), i % 2 == 0, 7 * i) for i in range(400)]
    df = spark.createDataFrame(data, "k timestamp, flag boolean, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = monitor.debounce(df.withColumn("extra", F.lit(1)), ["k", "flag"], "ts", 100)
    expected = brute_debounce([((str(k), flag), s) for k, flag, s in data], 100)
    assert sorted((str(r["k"]), r["flag"], r["s"]) for r in out.withColumn("s", F.unix_timestamp("ts")).collect()) == sorted((*k, s) for k, s in expected)


def test_debounce_of_one_long_session(spark):
    """No gap anywhere: every block's alerts depend on the block before."""
    rng, n = random.Random(4), 300_000
    times, at = [], 0
    for _ in range(n):
        at += rng.choice((1, 1, 2, 3))
        times.append(at)
    df = spark.createDataFrame(pd.DataFrame({"s": times})).select(F.lit("k").alias("k"), F.timestamp_seconds("s").alias("ts")).repartition(16)
    out = monitor.debounce(df, ["k"], "ts", 10).select(F.unix_timestamp("ts"))
    assert sorted(r[0] for r in out.collect()) == sorted(s for _, s in brute_debounce([("k", s) for s in times], 10))


def test_debounce_without_keys(spark):
    data = [("x", s) for _, s, _, _ in skewed(100, seed=9, spread=500)]
    df = spark.createDataFrame(data, "k string, s long").select(F.timestamp_seconds("s").alias("ts"))
    out = monitor.debounce(df, [], "ts", 10)
    assert sorted(r[0] for r in out.select(F.unix_timestamp("ts")).collect()) == sorted(s for _, s in brute_debounce(data, 10))


def test_debounce_of_nothing(spark):
    df = spark.createDataFrame([], "k string, ts timestamp")
    assert monitor.debounce(df, ["k"], "ts").count() == 0


def test_rolling_over_more_rows_than_a_chunk(spark):
    df = spark.range(25_000).select(F.lit("k").alias("k"), F.col("id"))
    out = ordered.rolling_rows(df, ["k"], ["id"], 20_000, [("n", F.count("*")), ("low", F.min("id"))])
    assert out.filter("n <> least(id + 1, 20000) OR low <> greatest(id - 19999, 0)").count() == 0
    assert out.count() == 25_000
