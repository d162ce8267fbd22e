"""Landing, envelopes, block shaping, retention, tiering, archive and backup."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.crypto import decrypt
from blockloom.functions.scalars import age_days, cutoff, first_nonempty, first_truthy
from blockloom.operators.validate import SOURCE_RULES
from blockloom.schemas import TIER_POLICIES
from blockloom.session import written
from blockloom.sources import committed
from blockloom.sources.files import check_zone, valid_zone

ARCHIVE_AFTER_DAYS = 30


# Shaping for the block tables


def normalize_blocks(raw: DataFrame) -> DataFrame:
    """Rows for the blocks table: number and hash from either chain's field, required fields
    present, one row per hash (the one with the lowest number, then the earliest time)."""
    shaped = raw.withColumns(
        {
            "block_number": first_truthy(F.col("block_height"), F.col("slot")),
            "block_hash": first_nonempty(F.col("hash"), F.col("blockhash")),
        }
    ).filter("block_number is not null and block_hash is not null and timestamp is not null and transaction_count is not null")
    rest = ["blockchain", "transaction_count"]
    best = F.min(F.struct("block_number", "timestamp", *rest))
    return shaped.groupBy("block_hash").agg(best.alias("b")).select("block_hash", "b.*")


def new_blocks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming blocks whose hash is not stored yet."""
    return incoming.join(stored.select("block_hash"), "block_hash", "left_anti")


def derive_block_metrics(blocks: DataFrame) -> DataFrame:
    """One `tps` metric per stored block, equal to its raw transaction count."""
    return blocks.select(
        "block_number",
        F.lit("tps").alias("metric_type"),
        F.col("transaction_count").cast("double").alias("value"),
        "timestamp",
    )


def metrics_in_range(metrics: DataFrame, metric_type: str, start: str, end: str) -> DataFrame:
    """Metrics of one type with start <= timestamp <= end, in time order."""
    between = F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return metrics.filter((F.col("metric_type") == metric_type) & between).orderBy("timestamp")


# Landing and envelopes


def land_raw(records: DataFrame, source_type: str, body: str, path: str, ingest_ts: str) -> bool:
    """Put JSON records of one source in its raw zone; false, and nothing written, when there
    are none or one is invalid.

    What is checked is what is written: the records are computed once. A repeated run of the same source
    and `ingest_ts` replaces what the first one wrote.
    """
    check_zone("raw", source_type)
    checked = written(records.withColumn("_valid", F.coalesce(SOURCE_RULES[source_type](F.col(body)), F.lit(True))), "landing")
    if not checked.agg(F.bool_and("_valid")).first()[0]:  # null without records
        return False
    kept = checked.drop("_valid").withColumns(
        {"category": F.lit("raw"), "subcategory": F.lit(source_type), "ingest_ts": F.lit(ingest_ts)}
    )
    own_folders = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    own_folders.partitionBy("category", "subcategory", "ingest_ts").json(path)
    return True


def lineage_lookup(names: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lineage records of the given stored names."""
    return names.join(lineage, "stored_name")


def zone_check(items: DataFrame) -> DataFrame:
    return items.withColumn("valid", valid_zone(F.col("category"), F.col("subcategory")))


def envelope(records: DataFrame, data_type: str, as_of: str, payload: list[str], keys: tuple[str, ...] = (), ts: Column | None = None, version: Column | None = None) -> DataFrame:
    """Payload and metadata as JSON text; the time defaults to `as_of`, the version to 1.0."""
    now = F.lit(as_of).cast("timestamp")
    when = now if ts is None else F.coalesce(ts, now)
    fixed = F.lit("1.0") if version is None else F.coalesce(version, F.lit("1.0"))
    options = {"ignoreNullFields": "false"}
    metadata = F.struct(
        F.lit(data_type).alias("data_type"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"), fixed.alias("version")
    )
    return records.select(
        *keys,
        F.to_json(F.struct(*payload), options).alias("payload"),
        F.to_json(metadata, options).alias("metadata"),
        when.alias("timestamp"),
    )


def latest_processed(processed: DataFrame, start: str, end: str, key: Column | None = None) -> DataFrame:
    """The newest non-empty record of a time range, decrypted when a key is given."""
    between = F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    newest = processed.filter(between).orderBy(F.desc("timestamp")).limit(1)
    payload = F.col("payload") if key is None else decrypt(F.col("payload"), key)
    return newest.filter("payload is not null and payload <> ''").withColumn("payload", payload)


# Month partitions, archive and restore


def with_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("month", F.date_format(ts, "yyyy_MM"))


def _balanced(df: DataFrame, *folders: str) -> DataFrame:
    """Bring rows of a folder together before a partitioned write, so tasks do not each write a file
    to every folder; AQE splits a folder that is too large for one task and merges small ones."""
    return df.hint("rebalance", *folders)


def write_by_month(df: DataFrame, path: str, run: str, ts: str = "timestamp") -> None:
    """Commit a run to the table at `path`, in month folders; a repeated run replaces its own rows."""
    committed.commit(_balanced(with_month(df, ts), "month"), path, run, ["month"])


def rows_per_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return with_month(df, ts).groupBy("month").agg(F.count("*").alias("n"))


def is_old(as_of: str, ts: str = "timestamp", days: int = ARCHIVE_AFTER_DAYS) -> Column:
    return (F.col(ts) < cutoff(as_of, days)) & ~F.coalesce(F.col("compressed"), F.lit(False))


def archive_plan(df: DataFrame, table: str, as_of: str, ts: str = "timestamp") -> DataFrame:
    """What an archive run would move: range and row count."""
    return df.filter(is_old(as_of, ts)).agg(
        F.lit(table).alias("original_table"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count("*").alias("n_rows"),
    )


def archive_write(df: DataFrame, table: str, as_of: str, archive: str, live: str, ts: str = "timestamp") -> None:
    """Write old rows to the archive (zstd) and the table with its flags to `live`.

    The source is never overwritten: `live` is a new folder the caller swaps in. Archived rows lie in folders
    of their table and `as_of`, so a repeated run replaces its own rows and no others.
    """
    flagged = df.withColumn("_old", is_old(as_of, ts))
    old = with_month(flagged.filter("_old"), ts).drop("_old", "compressed").withColumns(
        {"original_table": F.lit(table), "archived_at": F.lit(as_of)}
    )
    folders = ("original_table", "archived_at", "month")
    archived = _balanced(old, *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    archived.option("compression", "zstd").partitionBy(*folders).parquet(archive)
    flagged.withColumn("compressed", F.coalesce("compressed", F.lit(False)) | F.col("_old")).drop("_old").write.mode(
        "overwrite"
    ).parquet(live)


def archive_restore(
    live: DataFrame, archived: DataFrame, key: str, start: str, end: str, ts: str = "timestamp", table: str | None = None
) -> DataFrame:
    """The table with the archived rows of a time range put back, each key once and no longer flagged.

    `table` picks one of the tables an archive holds.
    """
    between = F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    columns = live.columns
    wanted = archived.filter(between if table is None else between & (F.col("original_table") == table))
    wanted = wanted.withColumn("compressed", F.lit(False)).dropDuplicates([key])
    missing = wanted.join(live.select(key), key, "left_anti").select(*columns)
    back = wanted.select(key, F.lit(True).alias("_back"))
    unflagged = live.join(back, key, "left").withColumn("compressed", F.col("compressed") & F.col("_back").isNull())
    return unflagged.select(*columns).unionByName(missing)


# Backups


def backup_id(kind: str, at: str) -> str:
    """`{kind}_{yyyymmdd_HHMMSS}`: no colons, which folder names must not hold."""
    return f"{kind}_{datetime.fromisoformat(at):%Y%m%d_%H%M%S}"


def write_backup(df: DataFrame, root: str, kind: str, at: str, part: int | None = None) -> str:
    """A gzip JSON snapshot taken at `at` and its catalog row; returns the backup id.

    Data and catalog row are written to folders named by the id, so a repeated run replaces them.
    """
    name = backup_id(kind, at) + ("" if part is None else f"_{part}")
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(f"{root}/data/{name}")
    row = df.sparkSession.range(1).select(
        F.lit(name).alias("backup_id"), F.lit(kind).alias("data_type"), F.lit(at).cast("timestamp").alias("created_at")
    )
    row.write.mode("overwrite").json(f"{root}/catalog/id={name}")
    return name


def restore_backup(spark: SparkSession, roots: list[str], name: str, schema: str) -> DataFrame | None:
    """The snapshot from the first root that holds it, None if none does."""
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).json(f"{root}/data/{name}")
    return None


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("backup_id string, data_type string, created_at timestamp").json(f"{root}/catalog/*")


def list_backups(catalog: DataFrame) -> DataFrame:
    """Newest first."""
    return catalog.orderBy(F.desc("created_at"), "backup_id")


def retention_plan(catalog: DataFrame, retention_days: int, as_of: str) -> DataFrame:
    """Age of each backup in whole days and whether it is past retention."""
    age = age_days(F.col("created_at"), as_of)
    return catalog.withColumn("age_days", age).withColumn("expired", F.col("age_days") > retention_days)


def purge_backups(plan: DataFrame, root: str) -> int:
    """Delete the expired backups of a retention plan; returns how many.

    Ids stream to the driver a partition at a time, for folders can only be deleted from there.
    """
    spark = plan.sparkSession
    removed = 0
    for row in plan.filter("expired").select("backup_id").toLocalIterator():
        for folder in (f"{root}/data/{row['backup_id']}", f"{root}/catalog/id={row['backup_id']}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        removed += 1
    return removed


# Tiers


def lifecycle_plan(items: DataFrame, as_of: str, policies=TIER_POLICIES) -> DataFrame:
    """The policy with the longest retention an item has outlived, and what it means for the item.

    Policies are a short fixed list, so they become one expression: no join, items stay in place.
    """
    ordered = sorted(policies, key=lambda p: -p[1])
    age = age_days(F.col("created_at"), as_of)
    policy, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, days, storage in reversed(ordered):
        policy = F.when(F.col("age_days") > days, F.lit(name)).otherwise(policy)
        target = F.when(F.col("age_days") > days, F.lit(storage)).otherwise(target)
    moves = F.col("target_class").isin("archive", "s3_glacier", "delete") & (
        F.col("target_class") != F.coalesce("storage_class", F.lit("local"))
    )
    return (
        items.withColumn("age_days", age)
        .withColumn("policy", policy)
        .withColumn("target_class", target)
        .withColumn("action", F.when(moves, F.col("target_class")).otherwise("none"))
    )


def lifecycle_apply(plan: DataFrame, path: str, as_of: str) -> None:
    """Commit the items to `storage_class=` folders as planned; deleted items are left out.

    The run is named by `as_of`: applying a day's plan again replaces what it moved before.
    """
    moved = F.col("action") != "none"
    kept = (
        plan.filter("action <> 'delete'")
        .withColumn("storage_class", F.when(moved, F.col("target_class")).otherwise(F.col("storage_class")))
        .withColumn("moved_at", F.when(moved, F.lit(as_of).cast("timestamp")))
        .drop("policy", "target_class", "action", "age_days")
    )
    committed.commit(_balanced(kept, "storage_class"), path, as_of, ["storage_class"])
