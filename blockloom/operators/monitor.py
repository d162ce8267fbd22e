"""Request-log metrics, trailing and sliding windows, and alert rules.

Sliding windows count per minute first and spread the minute rows over the windows they fall in,
so the expansion acts on at most one row per key and minute, not on the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from blockloom.functions.scalars import ratio
from blockloom.operators.ordered import BLOCK, Running, number_rows, rolling_rows, scan, to_blocks, trailing_range
from blockloom.session import written

# Default histogram bounds in seconds: fixed values.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))

MINUTE = 60


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint", "model", "status").agg(F.count("*").alias("requests"))


def latency_histogram(requests: DataFrame, buckets=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts per endpoint and model, in one pass over the log."""
    cells = [F.count_if(F.col("latency") <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    counted = requests.groupBy("endpoint", "model").agg(*cells)
    rows = F.array(
        *[
            F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"), F.col(f"b{i}").alias("requests"))
            for i, b in enumerate(buckets)
        ]
    )
    return counted.select("endpoint", "model", F.inline(rows))


def inference_totals(batches: DataFrame, size: str, tokens: str, latency: str) -> DataFrame:
    """Requests, tokens and mean latency per request over all batches."""
    return batches.agg(
        F.sum(size).alias("total_requests"),
        F.sum(tokens).alias("total_tokens"),
        ratio(F.sum(F.col(latency)), F.sum(size)).alias("avg_latency"),
    )


def batch_stats(batches: DataFrame, size: str) -> DataFrame:
    return batches.agg(
        ratio(F.sum(size), F.count(size)).alias("avg_batch_size"),
        F.min(size).alias("min_batch_size"),
        F.max(size).alias("max_batch_size"),
    )


def last_mean(samples: DataFrame, order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the last `n` samples."""
    newest = samples.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.agg(ratio(F.sum(F.col(value)), F.count(value)).alias("mean"))


def running_avg_latency(batches: DataFrame, keys: list[str], order: list[str], size: str, latency: str) -> DataFrame:
    """Mean latency per request over all batches so far."""
    ran = scan(
        batches,
        keys,
        order,
        [Running("_latency", "sum", F.col(latency)), Running("_requests", "sum", F.col(size))],
    )
    return ran.withColumn("avg_latency", ratio(F.col("_latency"), F.col("_requests"))).drop("_latency", "_requests")


def rolling_mean(samples: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """Mean of the last `n` samples up to each sample."""
    exact = samples.withColumn("_v", F.col(value))
    out = rolling_rows(exact, keys, order, n, [("_sum", F.sum("_v")), ("_n", F.count("_v"))])
    return out.withColumn("rolling_mean", ratio(F.col("_sum"), F.col("_n"))).drop("_v", "_sum", "_n")


def trailing_stats(samples: DataFrame, keys: list[str], ts: str, value: str, minutes: int = 5) -> DataFrame:
    """Mean and plot range of the last `minutes` minutes at each distinct sample time.

    The range adds a tenth of the spread on both sides (1.0 when flat) and does not go below 0.
    """
    stats = trailing_range(samples, keys, ts, F.col(value), minutes * 60 * 1_000_000)
    low, high = F.col("min").cast("double"), F.col("max").cast("double")
    margin = F.when(F.col("min") == F.col("max"), F.lit(1.0)).otherwise((high - low) * 0.1)
    return stats.select(
        *keys,
        ts,
        F.col("n").alias("samples"),
        ratio(F.col("sum"), F.col("n")).alias("mean"),
        low.alias("min"),
        high.alias("max"),
        F.greatest(F.lit(0.0), low - margin).alias("lower"),
        (high + margin).alias("upper"),
    )


# Tumbling and sliding rates


def _step(ts: str, seconds: int) -> Column:
    return (F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("bigint")


def tumbling_rate(samples: DataFrame, keys: list[str], ts: str, amount: Column, seconds: int = MINUTE) -> DataFrame:
    """Amount per second in fixed windows."""
    return (
        samples.groupBy(*keys, _step(ts, seconds).alias("_at"))
        .agg((F.sum(amount) / F.lit(float(seconds))).alias("tps"))
        .select(*keys, F.timestamp_seconds("_at").alias("window_start"), "tps")
    )


def sliding(samples: DataFrame, keys: list[str], ts: str, aggregates: dict[str, tuple[str, Column]], minutes: int = 5, step: int = 1) -> DataFrame:
    """Aggregates over windows of `minutes` every `step` minutes, one row per window with data.

    `aggregates` maps a name to (sum | min | max, column). Windows are [end - minutes, end), with ends at
    multiples of `step`. Rows are merged per slot first, the longest that no window cuts.
    """
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    slot, apart = gcd(minutes, step) * MINUTE, step * MINUTE
    each = samples.groupBy(*keys, _step(ts, slot).alias("_at")).agg(
        *[folds[kind](column).alias(name) for name, (kind, column) in aggregates.items()]
    )
    first = (F.ceil((F.col("_at") + slot) / apart) * apart).cast("bigint")
    last = F.col("_at") + minutes * MINUTE
    spread = each.filter(first <= last).withColumn("window_end", F.explode(F.sequence(first, last, F.lit(apart).cast("bigint"))))
    return spread.groupBy(*keys, "window_end").agg(*[folds[kind](name).alias(name) for name, (kind, _) in aggregates.items()])


def sustained(steps: DataFrame, keys: list[str], firing: Column, minutes: int = 5, step: int = 1) -> DataFrame:
    """Add `sustained`: `firing` held at each of the last `minutes` steps; a missing step breaks it.

    Each firing step is credited to the steps that look back on it, so no ordered window is needed.
    """
    needed = minutes // step
    flagged = steps.withColumn("firing", F.coalesce(firing, F.lit(False)))
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(needed - 1)), lambda i: F.col("window_end") + i * step * 60))
    credit = flagged.filter("firing").select(*keys, ahead.alias("window_end")).groupBy(*keys, "window_end").agg(
        F.count("*").alias("_held")
    )
    return (
        flagged.join(credit, [*keys, "window_end"], "left")
        .withColumn("sustained", F.coalesce(F.col("_held") == needed, F.lit(False)))
        .drop("_held")
    )


def error_rate_alert(requests: DataFrame, ts: str = "ts", threshold: float = 0.1) -> DataFrame:
    """Share of failed requests in 5-minute windows each minute, and whether it stayed high for 5 minutes."""
    counts = {
        "errors": ("sum", F.when(F.col("status") == "error", 1).otherwise(0)),
        "requests": ("sum", F.lit(1)),
    }
    rated = sliding(requests, [], ts, counts).withColumn("error_rate", ratio(F.col("errors"), F.col("requests")))
    return sustained(rated, [], F.col("error_rate") > threshold)


def p95_latency_alert(requests: DataFrame, ts: str = "ts", threshold: float = 2.0) -> DataFrame:
    """Exact 95th percentile of latency in 5-minute windows each minute."""
    p95 = window_quantile(requests, ts, "latency", 0.95, "p95")
    return sustained(p95, [], F.col("p95") > threshold)


_TOP = 1 << 40  # bin of NaN; infinities lie just below and as far down


def _bin(value: Column) -> Column:
    """A number's bin: bins keep the order of numbers and are 1/64 of a power of e wide."""
    size = F.abs(value)
    depth = F.floor(F.log(F.when(size > 0, size)) * 64).cast("long") + F.lit(1 << 30)
    finite = F.when(value == 0, F.lit(0)).when(value > 0, depth).otherwise(-depth)
    infinite = F.when(value > 0, F.lit(_TOP - 1)).otherwise(F.lit(1 - _TOP))
    return F.when(F.isnan(value), F.lit(_TOP)).when(size == float("inf"), infinite).otherwise(finite).cast("long")


def window_quantile(samples: DataFrame, ts: str, value: str, quantile: float, name: str, minutes: int = 5, step: int = 1) -> DataFrame:
    """Exact interpolated quantile of `value` in sliding windows: (window_end, `name`).

    A first pass counts bins per minute, a sketch that merges by adding: its rows, not the log's, are spread over the
    windows and tell in which bin each window's quantile lies and how far down. A second pass reads only samples of
    such bins and finds the sample at that place by numbering them, without a group per value or per window.
    """
    number = samples.filter(F.col(value).isNotNull()).select(F.col(ts).alias("_ts"), F.col(value).cast("double").alias("_value"))
    binned = number.withColumn("_bin", _bin(F.col("_value")))
    sketch = sliding(binned, ["_bin"], "_ts", {"_n": ("sum", F.lit(1))}, minutes, step)

    # The two neighbours of the quantile, by rank from 0; a window has at most as many rows here as bins.
    below = Window.partitionBy("window_end").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sketch.withColumns({"_before": F.coalesce(F.sum("_n").over(below), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("window_end"))})
    at = F.lit(float(quantile)) * (F.col("_all") - 1)
    inside = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    places = ranked.select(
        "window_end",
        "_bin",
        (at - F.floor(at)).alias("_share"),
        F.when(inside(F.floor(at)), F.floor(at) - F.col("_before")).alias("_low"),
        F.when(inside(F.ceil(at)), F.ceil(at) - F.col("_before")).alias("_high"),
    ).filter("_low IS NOT NULL OR _high IS NOT NULL")
    places = written(places, "places")

    # Samples of a wanted bin, for each window that wants it: at most two bins a window.
    length = minutes * MINUTE
    slot = gcd(minutes, step) * MINUTE
    slots = F.sequence(F.col("window_end") - length, F.col("window_end") - slot, F.lit(slot).cast("long"))
    wanted = places.select("window_end", "_bin", F.explode(slots).alias("_slot"))
    rows = binned.select(_step("_ts", slot).alias("_slot"), "_bin", "_value").join(wanted, ["_slot", "_bin"])
    numbered = number_rows(rows.select("window_end", "_bin", "_value"), ["window_end", "_bin"], ["_value"], "_place")
    found = numbered.join(places, ["window_end", "_bin"])
    pick = lambda rank: F.max(F.when(F.col("_place") - 1 == F.col(rank), F.col("_value")))
    ends = found.groupBy("window_end").agg(pick("_low").alias("_a"), pick("_high").alias("_b"), F.max("_share").alias("_share"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")
    return ends.select("window_end", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(name))


def request_rate(requests: DataFrame, ts: str = "ts", threshold: float = 1000.0) -> DataFrame:
    """Requests per second over 5 minutes, each minute."""
    counted = sliding(requests, [], ts, {"requests": ("sum", F.lit(1))})
    rated = counted.withColumn("rate", F.col("requests") / F.lit(300.0))
    return sustained(rated, [], F.col("rate") > threshold)


def gauge_alert(samples: DataFrame, keys: list[str], ts: str, value: str, threshold: float, inclusive: bool = False) -> DataFrame:
    """Highest gauge value per minute against a limit, and whether it stayed there for 5 minutes."""
    per_minute = sliding(samples, keys, ts, {"gauge": ("max", F.col(value))}, minutes=1)
    firing = F.col("gauge") >= threshold if inclusive else F.col("gauge") > threshold
    return sustained(per_minute, keys, firing)


def counter_increase(samples: DataFrame, keys: list[str], order: list[str], ts: str, value: str, minutes: int = 15, step: int = 5) -> DataFrame:
    """Increase of a counter per sliding window; a drop is a reset and counts from 0."""
    ran = scan(samples, keys, order, [Running("_previous", "last", F.col(value), inclusive=False)])
    rise = F.when(F.col("_previous").isNull(), F.lit(0)).when(
        F.col(value) < F.col("_previous"), F.col(value)
    ).otherwise(F.col(value) - F.col("_previous"))
    out = sliding(ran, keys, ts, {"increase": ("sum", rise)}, minutes=minutes, step=step)
    return out.withColumn("firing", F.col("increase") > 0)


def threshold_alerts(samples: DataFrame, metric: str, series: str, value: str, threshold: float) -> DataFrame:
    """Samples of one metric above a limit; works on batches and streams."""
    return samples.filter((F.col(series) == metric) & (F.col(value) > threshold))


def metric_resample(samples: DataFrame, keys: list[str], ts: str, value: str, as_of: str, hours: int = 1, seconds: int = 300) -> DataFrame:
    """Means per 5 minutes over the last `hours` hours."""
    now = F.lit(as_of).cast("timestamp")
    recent = samples.filter((F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(ts) <= now))
    return (
        recent.groupBy(*keys, _step(ts, seconds).alias("_at"))
        .agg(ratio(F.sum(F.col(value)), F.count(value)).alias("average"))
        .select(*keys, F.timestamp_seconds("_at").alias("window_start"), "average")
    )


def first_point(resampled: DataFrame, series: str, names: list[str]) -> DataFrame:
    """The first mean of each asked metric, 0 where there is none."""
    cells = []
    for name in names:
        first = F.min(F.when(F.col(series) == name, F.struct("window_start", "average")))["average"]
        cells.append(F.struct(F.lit(name).alias("metric"), F.coalesce(first, F.lit(0.0)).alias("value")))
    return resampled.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


# Debounce


def debounce(alerts: DataFrame, keys: list[str], ts: str, seconds: int = 10) -> DataFrame:
    """Times at which an alert fires when it may fire again only `seconds` after it last fired.

    Which alerts fire depends on the one that fired last, so this is no window, but over any stretch of a key's alerts it
    is a function from "last fired before" to "last fired after". Alerts are range-partitioned by (keys, time); each
    stretch that reaches over a block's end gives its function, as the few pieces in which it is constant; the
    functions of a key are composed in order; then each stretch is walked once from what it was handed. At most
    two stretches a block are composed, so what the driver gathers and broadcasts is a number per stretch.
    """
    gap = seconds * 1_000_000
    points = alerts.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).filter("_at IS NOT NULL").distinct()
    blocks = to_blocks(points, keys, ["_at"]).select(*keys, "_at", BLOCK)
    key_fields = [blocks.schema[k] for k in keys]
    pieces = StructType(
        [*key_fields, StructField("_first", LongType()), *[StructField(c, ArrayType(LongType())) for c in ("_starts", "_lasts")]]
    )
    entries = StructType([*key_fields, StructField("_first", LongType()), StructField("_last", LongType())])
    functions = blocks.mapInArrow(_stretch_functions(gap, pieces), pieces)
    ordered = functions.repartition(*keys) if keys else functions.coalesce(1)
    handed = ordered.sortWithinPartitions(*keys, "_first").mapInArrow(_compose(gap, len(keys), entries), entries)
    # Arrow values on both sides, so that keys of any type compare equal.
    known = {(tuple(row[:-2]), row[-2]): row[-1] for row in zip(*[c.to_pylist() for c in handed.toArrow().columns], strict=True)}
    fired = StructType([*key_fields, StructField("_at", LongType())])
    out = blocks.mapInArrow(_fire(gap, blocks.sparkSession.sparkContext.broadcast(known), fired), fired)
    return out.select(*keys, F.timestamp_micros("_at").alias(ts))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, np.ndarray]]:
    """(block, key, times) of adjacent rows that share block and key; a long stretch comes in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *key_columns, times, block = batch.columns
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for column in (*key_columns, block):
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        values = times.to_numpy()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield block[start].as_py(), tuple(c[start].as_py() for c in key_columns), values[start:end]


def _arrow_rows(records: Iterator[tuple], kind: StructType, size: int = 5000) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(kind)
    while held := list(islice(records, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _stretch_functions(gap: int, kind: StructType):
    """For the first and the last stretch of each block: its function from last fired before to last fired after.

    `lasts[i]` holds for all values before that allow a start at `starts[i]` but at none earlier.
    """

    def function(times: np.ndarray) -> tuple[int, list[int], list[int]]:
        n = len(times)
        to = np.searchsorted(times, times + gap)
        end = np.where(to < n, to, np.arange(n))
        while not np.array_equal(further := end[end], end):  # doubles the steps taken
            end = further
        reach = min(int(to[0]), n - 1) + 1  # alerts that may be the first to fire
        lasts, starts = times[end[:reach]], times[:reach]
        keep = np.append(lasts[1:] != lasts[:-1], True)
        return int(times[0]), starts[keep].tolist(), lasts[keep].tolist()

    def records(batches):
        at, held, begins = None, [], True
        for block, key, times in _stretches(batches):
            if at != (block, key):
                ends = at is not None and at[0] != block
                if held and (begins or ends):
                    yield (*at[1], *function(np.concatenate(held)))
                begins = at is None or ends
                at, held = (block, key), []
            held.append(times)
        if held:
            yield (*at[1], *function(np.concatenate(held)))

    return lambda batches: _arrow_rows(records(batches), kind)


def _compose(gap: int, n_keys: int, kind: StructType):
    """What each stretch is handed, from the functions of its key in order."""

    def records(batches):
        key, last = None, None
        for batch in batches:
            for *its, first, starts, lasts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (its,):
                    key, last = (its,), None
                yield (*its, first, last)
                at = 0 if last is None else int(np.searchsorted(starts, last + gap))
                last = lasts[at] if at < len(lasts) else last

    return lambda batches: _arrow_rows(records(batches), kind)


def _fire(gap: int, known: Broadcast, kind: StructType):
    """Walk every stretch from what it was handed."""

    def records(batches):
        at, last = None, None
        for block, key, times in _stretches(batches):
            if at != (block, key):
                within = at is not None and at[0] == block
                # Only a block's first stretch can go on from an earlier one, and that one was handed a value.
                last = None if within else known.value[key, int(times[0])]
                at = (block, key)
            i = 0 if last is None else int(np.searchsorted(times, last + gap))
            while i < len(times):
                last = int(times[i])
                yield (*key, last)
                i = int(np.searchsorted(times, last + gap))

    return lambda batches: _arrow_rows(records(batches), kind)
