"""Streams over the events and documents tables, run until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.scalars import iso_text
from blockloom.plans.monitor_queries import DEBOUNCE, LOCKOUT, _floor, _spread
from blockloom.plans.quality_queries import DOCS, MEASURED
from blockloom.plans.registry import query
from blockloom.plans.standins import EVENTS_AS_OF, Tables
from blockloom.session import work_dir
from blockloom.streaming import stateful, streams, uniques

ISO = "'%Y-%m-%d %H:%M:%S.%f'"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t: Tables):
    # As a pattern, so that the table may be one file or a folder of files.
    stream = streams.sample_stream(t.spark, f"{t.sf_dir}/{{events.parquet}}", EVENTS)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


SLICES, LATEST = 4, 6 * 3600  # files of events by arrival, and by how many seconds an event may come late


def _late_events(t):
    """The events as a stream of files in the order of their arrival, which is not that of their times.

    Every event comes up to LATEST seconds late; a last file holds one row without an id, a heartbeat that closes the
    stream. One slice is a trigger. Returns the stream and the watermark's delay that this disorder needs.
    """
    root = work_dir(t.spark, "arrivals")
    events = t.spark.read.schema(EVENTS).parquet(f"{t.sf_dir}/events.parquet")
    late = F.pmod(F.hash("event_id"), F.lit(LATEST))
    first, last = events.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    length = (last - first + LATEST) // SLICES + 1
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + late - F.lit(first)
    events.withColumn("slice", F.floor(arrival / length).cast("int")).write.partitionBy("slice").parquet(f"{root}/slices")
    for k in range(SLICES):
        part = t.spark.read.schema(f"{EVENTS}, slice int").parquet(f"{root}/slices").filter(F.col("slice") == k).drop("slice")
        part.write.mode("append").parquet(f"{root}/in")
    files = len(t.spark.read.schema(EVENTS).parquet(f"{root}/in").inputFiles())
    delay = length + LATEST
    beat = F.timestamp_seconds(F.lit(last + 2 * delay)).cast("timestamp_ntz")
    heartbeat = t.spark.range(1).select(beat.alias("ts")).select(
        *[(F.col("ts") if name == "ts" else F.lit(None).cast(kind)).alias(name) for name, kind in (c.split() for c in EVENTS.split(", "))]
    )
    heartbeat.write.mode("append").parquet(f"{root}/in")
    stream = streams.sample_stream(t.spark, f"{root}/in", EVENTS, max_files=max(1, files // SLICES))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{delay} seconds"


@query("stream_samples", "SELECT event_id, event_type AS series, value FROM events")
def _(t):
    root = work_dir(t.spark, "stream")
    samples = _events(t).select("event_id", F.col("event_type").alias("series"), "value")
    streams.run_to_table(samples, f"{root}/out", f"{root}/cp")
    return t.spark.read.parquet(f"{root}/out")


@query(
    "stream_tps_tumbling",
    f"""SELECT event_type, strftime(make_timestamp({_floor(60)} * 1000000), {ISO}) AS window_start, COUNT(*) / 60.0::DOUBLE AS tps
        FROM events GROUP BY ALL""",
)
def _(t):
    root = work_dir(t.spark, "stream")
    events, delay = _late_events(t)
    totals = streams.window_totals(events.filter("event_id IS NOT NULL"), ["event_type"], "ts", F.lit(1), delay=delay)
    streams.run_upserts(totals, f"{root}/out", f"{root}/cp", ["event_type", "window_start"])
    rates = streams.tumbling_tps(streams.newest_rows(t.spark, f"{root}/out", ["event_type", "window_start"]), ["event_type"])
    return rates.withColumn("window_start", iso_text(F.col("window_start")))


@query(
    "stream_tps_sliding",
    f"SELECT event_type, window_end, n / 300.0::DOUBLE AS tps FROM ({_spread('COUNT(*) AS n', 'event_type,', source='events')})",
)
def _(t):
    root = work_dir(t.spark, "stream")
    events, delay = _late_events(t)
    totals = streams.window_totals(events.filter("event_id IS NOT NULL"), ["event_type"], "ts", F.lit(1), delay=delay)
    streams.run_upserts(totals, f"{root}/out", f"{root}/cp", ["event_type", "window_start"], merge_every=2)
    rates = streams.sliding_tps(streams.newest_rows(t.spark, f"{root}/out", ["event_type", "window_start"]), ["event_type"])
    return rates.withColumn("window_end", F.unix_timestamp("window_end"))


@query("stream_unique_blocks", f"SELECT user_id, strftime(MIN(ts), {ISO}) AS ts FROM events GROUP BY user_id")
def _(t):
    root = work_dir(t.spark, "stream")
    # In the order of the table's times no key comes before its first event.
    events = t.spark.read.schema(EVENTS).parquet(f"{t.sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    events.select("user_id", "ts", "day").write.partitionBy("day").parquet(f"{root}/days")
    first, last = events.agg(F.min("day"), F.max("day")).first()
    middle = first + (last - first) / 2
    for part in (F.col("day") <= middle, F.col("day") > middle):
        t.spark.read.parquet(f"{root}/days").filter(part).drop("day").write.mode("append").parquet(f"{root}/in")
    files = len(t.spark.read.parquet(f"{root}/in").inputFiles())
    stream = streams.sample_stream(t.spark, f"{root}/in", "user_id bigint, ts timestamp_ntz", max_files=max(1, files // 2))
    uniques.unique_stream(stream, "user_id", ["ts"], f"{root}/out", f"{root}/cp")
    return uniques.read_uniques(t.spark, f"{root}/out").withColumn("ts", iso_text(F.col("ts")))


@query("stream_threshold_alerts", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 15")
def _(t):
    root = work_dir(t.spark, "stream")

    def callback(batch, batch_id):
        batch.select("event_id", "value").write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    streams.alert_on(_events(t), "click", "event_type", "value", 15.0, callback, f"{root}/cp")
    return t.spark.read.parquet(f"{root}/out").select("event_id", "value")


@query(
    "stream_debounce",
    f"{DEBOUNCE} SELECT series, strftime(ts, {ISO}) AS ts FROM fired",
    ("samples",),
)
def _(t):
    root = work_dir(t.spark, "stream")
    events, delay = _late_events(t)
    beat = F.col("event_id").isNull()
    high = events.filter(beat | (F.col("value") > 5)).withColumnRenamed("event_type", "series")
    fired = stateful.debounce(high, "series", "ts", 3600, delay, beat)
    streams.run_to_table(fired, f"{root}/out", f"{root}/cp")
    return t.spark.read.parquet(f"{root}/out").withColumn("ts", iso_text(F.col("ts")))


@query(
    "stream_lockout",
    f"""WITH {LOCKOUT} SELECT event_id, user_id::VARCHAR AS user_id, consecutive_failures, consecutive_failures >= 3 AS locked,
        CASE WHEN consecutive_failures >= 3 THEN strftime(ts + INTERVAL 300 SECONDS, {ISO}) END AS locked_until FROM s""",
)
def _(t):
    root = work_dir(t.spark, "stream")
    events, delay = _late_events(t)
    beat = F.col("event_id").isNull()
    tries = events.filter(beat | F.col("event_type").isin("error", "signup"))
    out = stateful.lockout(tries, "user_id", "ts", F.col("event_type") == "error", delay=delay, heartbeat=beat)
    streams.run_to_table(out, f"{root}/out", f"{root}/cp")
    return t.spark.read.parquet(f"{root}/out").withColumn("locked_until", iso_text(F.col("locked_until")))


@query("stream_quality", f"WITH {MEASURED} SELECT doc_id, 'ingest' AS stage, score FROM measured", DOCS)
def _(t):
    root = work_dir(t.spark, "stream")
    # Land the nested documents, then ingest them as a stream.
    documents = t.chain_documents.drop("lang")
    documents.write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(documents.schema).parquet(f"{root}/in")
    streams.ingest_with_quality(stream, "ingest", EVENTS_AS_OF, f"{root}/out", f"{root}/cp")
    return streams.quality_table(t.spark, f"{root}/out", "doc_id").select("doc_id", "stage", "score")


@query("stream_backup", "SELECT event_id, user_id, value FROM events")
def _(t):
    root = work_dir(t.spark, "stream")
    queued = _events(t).select("event_id", "user_id", "value")
    streams.backup_worker(queued, f"{root}/backups", "events", "2024-01-31", f"{root}/cp")
    snapshots = f"{root}/backups/data/*"
    return t.spark.read.schema("event_id bigint, user_id bigint, value double").json(snapshots)
