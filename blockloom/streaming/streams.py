"""Structured Streaming forms of the operators.

Event time is a TIMESTAMP (session zone UTC). Windows use a watermark; the per-micro-batch steps
run the batch operators on each appended set of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators import lifecycle, quality
from blockloom.operators.monitor import sliding, threshold_alerts
from blockloom.sources import committed

WATERMARK = "10 minutes"


def sample_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New files of samples; `max_files` bounds a micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def watermarked(stream: DataFrame, ts: str, delay: str = WATERMARK) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window_totals(stream: DataFrame, keys: list[str], ts: str, amount: Column, seconds: int = 60, delay: str = WATERMARK) -> DataFrame:
    """Sums of `amount` in fixed windows: (keys, window_start, total)."""
    return (
        watermarked(stream, ts, delay)
        .groupBy(F.window(ts, f"{seconds} seconds"), *keys)
        .agg(F.sum(amount).alias("total"))
        .select(*keys, F.col("window.start").alias("window_start"), "total")
    )


VERSION = "_version"


def upsert_to(path: str, merge_every: int = 100, keys: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler for `foreachBatch` that commits what a micro-batch changed, once.

    The micro-batch is the run's name and the version of its rows. One that is repeated finds its entry in the ledger
    and changes nothing; one that was cut off between write and commit is not in the ledger and is written again.
    With `keys`, every `merge_every` micro-batches older versions are merged away.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn(VERSION, F.lit(batch_id).cast("long"))
        done = committed.commit(changed, path, f"{batch_id:012d}", once=True)
        if done and keys and batch_id % merge_every == merge_every - 1:
            committed.compact(batch.sparkSession, path, merge=lambda rows: _newest(rows, keys))

    return handle


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key; combines map-side."""
    rest = [c for c in rows.columns if c not in keys and c != VERSION]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(VERSION, *rest)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in (*rest, VERSION)])


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The committed state of a table of upserts."""
    return _newest(committed.read(spark, path), keys).drop(VERSION)


def tumbling_tps(totals: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """Amount per second of window totals."""
    return totals.select(*keys, "window_start", (F.col("total") / F.lit(float(seconds))).alias("tps"))


def sliding_tps(totals: DataFrame, keys: list[str], minutes: int = 5, step: int = 1) -> DataFrame:
    """Amount per second over the last minutes, every step, from totals per minute: minutes are spread, not rows."""
    spread = sliding(totals, keys, "window_start", {"total": ("sum", F.col("total"))}, minutes, step)
    return spread.select(*keys, F.timestamp_seconds("window_end").alias("window_end"), (F.col("total") / F.lit(minutes * 60.0)).alias("tps"))


def run_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], merge_every: int = 100) -> StreamingQuery:
    """Process what is there in update mode; `newest_rows` reads the result. Returns the ended query."""
    handle = upsert_to(path, merge_every, keys)
    query = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and append it to parquet files below `path`; the ended query, for its progress."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """A long-running query with one micro-batch every `seconds`; stop it or wait with a timeout."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )


def alert_on(stream: DataFrame, metric: str, series: str, value: str, threshold: float, callback: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand the samples above a limit to `callback`, once per sample."""
    high = threshold_alerts(stream, metric, series, value, threshold)
    high.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def ingest_with_quality(
    stream: DataFrame, stage: str, as_of: str, path: str, checkpoint: str, on_figures: Callable[[int, dict], None] | None = None
) -> None:
    """Measure every document once and commit it, with its quality, as part of its micro-batch's run.

    Rows that pass the gate and rows that do not lie in folders of one table; `accepted` and `quality_table` read
    it. The figures of a micro-batch (rows, passed, mean score) are observed on the way of that one write.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        graded = F.struct(
            F.lit(as_of).cast("timestamp").alias("timestamp"),
            F.lit(stage).alias("stage"),
            quality.score().alias("score"),
            quality.report().alias("report"),
        )
        measured = quality.measure(batch)
        rows = measured.select(*batch.columns, graded.alias(QUALITY), quality.gate().alias(PASSED))
        seen = Observation()
        observed = rows.observe(
            seen, F.count("*").alias("rows"), F.count_if(PASSED).alias("passed"), F.avg(f"{QUALITY}.score").alias("mean_score")
        )
        if committed.commit(observed, path, f"{batch_id:012d}", [PASSED], once=True) and on_figures:
            on_figures(batch_id, seen.get)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


QUALITY, PASSED = "_quality", "_passed"


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The ingested documents that passed the gate."""
    return committed.read(spark, path).filter(PASSED).drop(QUALITY, PASSED)


def quality_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Quality rows of all ingested documents; their other columns are not read."""
    return committed.read(spark, path).select(*keys, f"{QUALITY}.*")


def backup_worker(stream: DataFrame, root: str, kind: str, as_of: str, checkpoint: str) -> None:
    """Each micro-batch of queued records becomes one snapshot, named by the micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            lifecycle.write_backup(batch, root, kind, as_of, part=batch_id)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
