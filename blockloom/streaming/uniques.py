"""Unique keys of a stream without a time limit and without state in the stream.

Keys that were seen lie in the output table itself. Each is assigned to a bucket, and each bucket has a Bloom
filter of 32,768 bits. A micro-batch is probed against the filters of its buckets: a key that the filter does not know is
new, and only keys that it may know are looked up in the table. Then the filters are extended and the new rows are
committed as the micro-batch's run. A crash in between leaves bits too many, never too few, and a
repeated micro-batch finds its run and does nothing. More keys than planned for (about 3,000 a bucket) make filters
say "maybe" more often and lookups larger; the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources import committed

BUCKETS = 1024
BITS = 32_768  # of a bitmap as the aggregate functions make it
PROBES = 6


def _positions(key: Column) -> Column:
    """Places of a key's bits, by double hashing."""
    step = F.xxhash64(F.lit("step"), key).bitwiseOR(F.lit(1))
    first = F.pmod(F.xxhash64(F.lit("first"), key), F.lit(BITS))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(first + i * F.pmod(step, F.lit(BITS)), F.lit(BITS)))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1


def filters(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits) of rows with a `_bucket`."""
    spread = keys.select(F.col("_bucket"), F.explode(_positions(F.col(key))).alias("_at"))
    return spread.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def unseen(rows: DataFrame, key: str, order: list[str], path: str, buckets: int = BUCKETS) -> DataFrame:
    """One row, the first by `order`, of every key of `rows` that the table at `path` lacks, with its `_bucket`."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in order and c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(
        key, *[F.col("_first")[c].alias(c) for c in (*order, *rest) if c != key]
    )
    placed = first.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if not committed.snapshot(spark, f"{path}/rows"):
        return placed
    known = committed.read(spark, f"{path}/filters").groupBy("_bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    maybe = F.forall(_positions(F.col(key)), lambda at: _is_set(F.col("bits"), at))
    probed = placed.join(known, "_bucket", "left").withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("bits")
    seen = committed.read(spark, f"{path}/rows").select(F.col("_bucket").alias("_its"), F.col(key).alias("_key"))
    same = (F.col("_bucket") == F.col("_its")) & F.col(key).eqNullSafe(F.col("_key"))
    # A key that is surely new has no partner below, so it is kept out of the lookup.
    looked_up = probed.filter("_maybe").join(seen, same, "left_anti")
    return probed.filter("NOT _maybe").unionByName(looked_up).drop("_maybe")


def keep_unseen(batch: DataFrame, run: str, key: str, order: list[str], path: str, buckets: int = BUCKETS) -> bool:
    """Commit the new keys of a micro-batch as run `run`; false if that was done before."""
    spark = batch.sparkSession
    if any(entry.run == run for entry in committed.entries(spark, f"{path}/rows")):
        return False
    fresh = unseen(batch, key, order, path, buckets).sortWithinPartitions("_bucket")
    folder = committed.stage(fresh, f"{path}/rows", run)
    staged = spark.read.schema(fresh.schema).parquet(f"{path}/rows/{folder}")
    committed.commit(filters(staged, key), f"{path}/filters", run)
    committed.publish(spark, f"{path}/rows", run, folder, fresh.schema)
    return True


def unique_stream(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str, buckets: int = BUCKETS, merge_every: int = 100) -> None:
    """Run what is there; `read_uniques` gives the rows. Runs are merged now and then, so that readers open few folders."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = keep_unseen(batch, f"{batch_id:012d}", key, order, path, buckets)
        if done and batch_id % merge_every == merge_every - 1:
            committed.compact(batch.sparkSession, f"{path}/rows")
            committed.compact(
                batch.sparkSession,
                f"{path}/filters",
                merge=lambda df: df.groupBy("_bucket").agg(F.bitmap_or_agg("bits").alias("bits")),
            )

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def read_uniques(spark: SparkSession, path: str) -> DataFrame:
    return committed.read(spark, f"{path}/rows").drop("_bucket")
