"""Block shaping, landing, retention, tiering, archive, backup and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.crypto import encrypt, key_column
from blockloom.functions.scalars import iso_text
from blockloom.operators import lifecycle
from blockloom.plans.registry import query
from blockloom.plans.standins import AS_OF, EVENTS_AS_OF
from blockloom.schemas import ZONES
from blockloom.session import work_dir
from blockloom.sources import committed, files

ISO = "'%Y-%m-%d %H:%M:%S.%f'"
_AGE = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch({{}})) / 86400)::BIGINT"
_OLD = f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
# Rows already archived once carry the flag: those of one order status.
_FLAG = "o_orderstatus = 'P'"


def _raw_blocks(t):
    """Blocks of both chains as their sources deliver them, every block twice."""
    eth = F.col("blockchain") == "ethereum"
    raw = t.blocks.select(
        "blockchain",
        F.when(eth, F.col("block_number")).otherwise(F.lit(0)).alias("block_height"),
        F.when(~eth, F.col("slot")).alias("slot"),
        F.when(eth, F.col("block_hash")).otherwise(F.lit("")).alias("hash"),
        F.when(~eth, F.col("block_hash")).alias("blockhash"),
        "timestamp",
        F.when(F.col("transaction_count") > 0, F.col("transaction_count")).alias("transaction_count"),
    )
    return raw.unionByName(raw)


@query(
    "normalize_blocks",
    """SELECT block_hash, block_number, blockchain, transaction_count FROM blocks
       WHERE transaction_count > 0 AND NOT (blockchain = 'ethereum' AND block_number = 0)""",
    ("blocks",),
)
def _(t):
    return lifecycle.normalize_blocks(_raw_blocks(t)).select("block_hash", "block_number", "blockchain", "transaction_count")


@query(
    "new_blocks",
    "SELECT block_hash, block_number FROM headers WHERE blockchain <> 'ethereum'",
    ("headers",),
)
def _(t):
    stored = t.headers.filter(F.col("blockchain") == "ethereum")
    return lifecycle.new_blocks(t.headers, stored).select("block_hash", "block_number")


@query(
    "derive_block_metrics",
    f"""SELECT block_number, 'tps' AS metric_type, transaction_count::DOUBLE AS value, strftime(timestamp, {ISO}) AS timestamp FROM blocks""",
    ("blocks",),
)
def _(t):
    return lifecycle.derive_block_metrics(t.blocks).withColumn("timestamp", iso_text(F.col("timestamp")))


@query(
    "metrics_in_range",
    f"""SELECT block_number, value, strftime(timestamp, {ISO}) AS timestamp FROM (
        SELECT block_number, transaction_count::DOUBLE AS value, timestamp FROM blocks)
        WHERE timestamp BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31'""",
    ("blocks",),
)
def _(t):
    metrics = lifecycle.derive_block_metrics(t.blocks)
    out = lifecycle.metrics_in_range(metrics, "tps", "1995-01-01", "2001-12-31")
    return out.select("block_number", "value", iso_text(F.col("timestamp")).alias("timestamp"))


@query(
    "land_raw",
    "SELECT source_type AS subcategory, 'raw' AS category, record_id FROM landed WHERE source_type = 'external' AND body <> '{}'",
    ("landed",),
)
def _(t):
    path = work_dir(t.spark, "zones")
    external = t.landed.filter(F.col("source_type") == "external")
    refused = lifecycle.land_raw(external, "external", "body", path, "20240131_000000")
    good = external.filter(F.col("body") != "{}")
    if refused or not lifecycle.land_raw(good, "external", "body", path, "20240131_000001"):
        raise ValueError("landing went wrong")
    return t.spark.read.schema("record_id bigint, category string, subcategory string, ingest_ts string").json(path).select(
        "subcategory", "category", "record_id"
    )


@query(
    "lineage_lookup",
    """SELECT 'part-' || o_orderkey AS stored_name, o_orderpriority AS source, o_custkey AS owner FROM orders
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(t):
    def stored(key: str):
        return F.concat(F.lit("part-"), F.col(key).cast("string")).alias("stored_name")

    lineage = t.orders.select(stored("o_orderkey"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("owner"))
    names = t.lineitem.filter("l_returnflag = 'R'").select(stored("l_orderkey")).distinct()
    return lifecycle.lineage_lookup(names, lineage)


@query(
    "envelope_records",
    f"""SELECT event_id, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS payload,
        '{{"data_type":"events","processed_at":"2024-01-31T00:00:00","version":"' ||
        CASE WHEN event_type = 'view' THEN '1.0' ELSE event_type END || '"}}' AS metadata,
        strftime(CASE WHEN event_type = 'error' THEN TIMESTAMP '{EVENTS_AS_OF}' ELSE ts END, {ISO}) AS timestamp FROM events""",
)
def _(t):
    out = lifecycle.envelope(
        t.events,
        "events",
        EVENTS_AS_OF,
        ["user_id", "event_type"],
        keys=("event_id",),
        ts=F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")),
        version=F.when(F.col("event_type") != "view", F.col("event_type")),
    )
    return out.withColumn("timestamp", iso_text(F.col("timestamp")))


@query(
    "latest_processed",
    f"""SELECT '{{"event_id":' || event_id || '}}' AS payload, strftime(ts, {ISO}) AS timestamp FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' ORDER BY ts DESC LIMIT 1""",
)
def _(t):
    t.spark.conf.set("spark.blockloom.key.demo", "0123456789abcdef")
    key = key_column(t.spark, "demo")
    stored = lifecycle.envelope(t.events, "events", EVENTS_AS_OF, ["event_id"], ts=F.col("ts").cast("timestamp"))
    stored = stored.withColumn("payload", encrypt(F.col("payload"), key))
    out = lifecycle.latest_processed(stored, "2024-01-01", "2024-01-31", key)
    return out.select("payload", iso_text(F.col("timestamp")).alias("timestamp"))


@query("rows_per_month", "SELECT strftime(timestamp, '%Y_%m') AS month, COUNT(*) AS n FROM headers GROUP BY 1", ("headers",))
def _(t):
    path = work_dir(t.spark, "months")
    for _ in range(2):  # a repeated run changes nothing
        lifecycle.write_by_month(t.headers, path, "headers")
    # The month column comes from the folder names.
    return committed.read(t.spark, path).groupBy("month").agg(F.count("*").alias("n"))


def _archivable(t):
    return t.orders.select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        (F.col("o_orderstatus") == "P").alias("compressed"),
    )


@query(
    "archive_plan",
    f"""SELECT 'orders' AS original_table, strftime(MIN(o_orderdate), {ISO}) AS start_time,
        strftime(MAX(o_orderdate), {ISO}) AS end_time, COUNT(*) AS n_rows FROM orders WHERE {_OLD} AND NOT {_FLAG}""",
)
def _(t):
    plan = lifecycle.archive_plan(_archivable(t), "orders", AS_OF)
    return plan.withColumns({c: iso_text(F.col(c)) for c in ("start_time", "end_time")})


@query(
    "archive_write",
    f"""SELECT 'archive' AS side, o_orderkey, true AS compressed FROM orders WHERE {_OLD} AND NOT {_FLAG}
        UNION ALL SELECT 'live', o_orderkey, {_FLAG} OR {_OLD} FROM orders""",
)
def _(t):
    root = work_dir(t.spark, "archive")
    lifecycle.archive_write(_archivable(t), "orders", AS_OF, f"{root}/archive", f"{root}/live")
    archived = t.spark.read.parquet(f"{root}/archive").select(F.lit("archive").alias("side"), "o_orderkey", F.lit(True).alias("compressed"))
    live = t.spark.read.parquet(f"{root}/live").select(F.lit("live").alias("side"), "o_orderkey", "compressed")
    return archived.unionByName(live)


@query(
    "archive_restore",
    f"""SELECT o_orderkey, o_totalprice, strftime(o_orderdate, {ISO}) AS timestamp FROM orders
        WHERE NOT ({_OLD} AND NOT {_FLAG}) OR o_orderdate >= TIMESTAMP '1996-01-01'""",
)
def _(t):
    root = work_dir(t.spark, "archive")
    lifecycle.archive_write(_archivable(t), "orders", AS_OF, f"{root}/archive", f"{root}/live")
    # Restore into a table that lost its archived rows.
    old = lifecycle.is_old(AS_OF)
    live = _archivable(t).filter(~old)
    archived = t.spark.read.parquet(f"{root}/archive")
    restored = lifecycle.archive_restore(live, archived, "o_orderkey", "1996-01-01", "2002-01-01")
    return restored.select("o_orderkey", "o_totalprice", iso_text(F.col("timestamp")).alias("timestamp"))


@query("backup_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    root = work_dir(t.spark, "backup")
    source = t.events.select("event_id", "user_id", "event_type", "value", "props")
    name = lifecycle.write_backup(source, root, "events", "2024-01-31T00:00:00")
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string"
    return lifecycle.restore_backup(t.spark, [root], name, schema)


def _catalog(t):
    created = F.col("o_orderdate").cast("timestamp")
    name = F.concat_ws("_", F.col("o_orderpriority"), F.date_format(created, "yyyyMMdd_HHmmss"), F.col("o_orderkey").cast("string"))
    return t.orders.select(name.alias("backup_id"), F.col("o_orderpriority").alias("data_type"), created.alias("created_at"))


_CATALOG = """catalog AS (SELECT concat_ws('_', o_orderpriority, strftime(o_orderdate, '%Y%m%d_%H%M%S'), o_orderkey) AS backup_id,
              o_orderpriority AS data_type, o_orderdate AS created_at FROM orders)"""


@query("list_backups", f"WITH {_CATALOG} SELECT backup_id, data_type, strftime(created_at, {ISO}) AS created_at FROM catalog")
def _(t):
    return lifecycle.list_backups(_catalog(t)).withColumn("created_at", iso_text(F.col("created_at")))


@query(
    "retention_plan",
    f"""WITH {_CATALOG} SELECT backup_id, {_AGE.format('created_at')} AS age_days, {_AGE.format('created_at')} > 365 AS expired FROM catalog""",
)
def _(t):
    return lifecycle.retention_plan(_catalog(t), 365, AS_OF).select("backup_id", "age_days", "expired")


def _items(t):
    return t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").alias("size"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "archive").otherwise("local").alias("storage_class"),
    )


_PLAN = f"""items AS (SELECT o_orderkey, {_AGE.format('o_orderdate')} AS age_days,
               CASE WHEN o_orderstatus = 'P' THEN 'archive' ELSE 'local' END AS storage_class FROM orders),
    policies AS (SELECT * FROM (VALUES ('hot_storage', 30, 'local'), ('warm_storage', 90, 'archive'), ('cold_storage', 365, 's3_glacier'))
                 v(policy, days, target_class)),
    plan AS (SELECT o_orderkey, age_days, storage_class, arg_max(policy, days) AS policy, arg_max(target_class, days) AS target_class
             FROM items LEFT JOIN policies ON age_days > days GROUP BY ALL),
    acted AS (SELECT *, CASE WHEN target_class IN ('archive', 's3_glacier', 'delete') AND target_class <> storage_class
              THEN target_class ELSE 'none' END AS action FROM plan)"""


@query("lifecycle_plan", f"WITH {_PLAN} SELECT o_orderkey, age_days, policy, target_class, action FROM acted")
def _(t):
    return lifecycle.lifecycle_plan(_items(t), AS_OF).select("o_orderkey", "age_days", "policy", "target_class", "action")


@query(
    "lifecycle_apply",
    f"""WITH {_PLAN} SELECT o_orderkey, CASE WHEN action = 'none' THEN storage_class ELSE action END AS storage_class,
        action <> 'none' AS moved FROM acted""",
)
def _(t):
    path = work_dir(t.spark, "tiers")
    plan = lifecycle.lifecycle_plan(_items(t), AS_OF)
    for _ in range(2):  # a repeated run changes nothing
        lifecycle.lifecycle_apply(plan, path, AS_OF)
    return committed.read(t.spark, path).select("o_orderkey", "storage_class", F.col("moved_at").isNotNull().alias("moved"))


@query(
    "inventory_sidecar",
    f"""SELECT 'f/' || o_orderkey AS path, 'n' AS name, o_totalprice AS size,
        strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END, {ISO}) AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'local' END AS storage_class FROM orders""",
)
def _(t):
    path = F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("path")
    at = F.col("o_orderdate").cast("timestamp")
    listing = t.orders.select(path, F.lit("n").alias("name"), F.col("o_totalprice").alias("size"), at.alias("modified_at"))
    sidecars = t.orders.filter("o_orderstatus = 'F'").select(
        path,
        (at - F.expr("INTERVAL 1 DAY")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_accessed"),
        F.lit("archive").alias("storage_class"),
    )
    return files.with_sidecars(listing, sidecars).select(
        "path", "name", "size", iso_text(F.col("created_at")).alias("created_at"), "storage_class"
    )


_ZONE_PATH = "'data/' || CASE WHEN event_type = 'error' THEN 'metadata/audit' WHEN event_type = 'view' THEN 'raw/sensors' ELSE 'raw/external' END || '/' || event_id"


@query("list_zone", f"SELECT path FROM (SELECT {_ZONE_PATH} AS path FROM events) WHERE path LIKE '%raw/%'")
def _(t):
    kind = F.col("event_type")
    zone = F.when(kind == "error", "metadata/audit").when(kind == "view", "raw/sensors").otherwise("raw/external")
    listing = t.events.select(F.concat_ws("/", F.lit("data"), zone, F.col("event_id").cast("string")).alias("path"))
    return files.in_zone(listing, "raw")


_VALID = " OR ".join(
    f"(category = '{c}' AND subcategory IN ({', '.join(repr(s) for s in members)}))" for c, members in ZONES.items()
)


@query(
    "zone_check",
    f"""SELECT event_id, category, subcategory, {_VALID} AS valid FROM (
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'metadata' ELSE 'raw' END AS category,
               CASE WHEN event_type IN ('error', 'view') THEN 'audit' ELSE 'sensors' END AS subcategory FROM events)""",
)
def _(t):
    kind = F.col("event_type")
    items = t.events.select(
        "event_id",
        F.when(kind == "error", "metadata").otherwise("raw").alias("category"),
        F.when(kind.isin("error", "view"), "audit").otherwise("sensors").alias("subcategory"),
    )
    return lifecycle.zone_check(items)
