"""Shaping of block documents and typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.compress import zlib_hex
from blockloom.functions.jsonkeys import has_keys
from blockloom.functions.scalars import ratio

COMPRESS_ABOVE = 1000  # characters

# Record kinds by the keys that identify them, first match wins: fixed values.
RECORD_KEYS = [
    ("llm_input", ("prompt", "parameters")),
    ("llm_output", ("response", "tokens")),
    ("model_metrics", ("latency", "tokens_per_second")),
    ("training_data", ("input", "output")),
]

NUMERIC_FIELDS = ("latency", "tokens_per_second", "memory_usage", "error_rate")


def block_metrics(documents: DataFrame) -> DataFrame:
    """Number, times and numbers of a document's blocks, in order."""
    return documents.withColumns(
        {
            "total_blocks": F.size("blocks").cast("bigint"),
            "block_times": F.transform("blocks", lambda b: b["timestamp"]),
            "block_numbers": F.transform("blocks", lambda b: b["number"]),
        }
    )


def transaction_metrics(documents: DataFrame) -> DataFrame:
    """Transactions of a document in total and per block; the document itself is kept."""
    total = F.aggregate(
        F.transform("blocks", lambda b: F.size(b["transactions"])), F.lit(0).cast("bigint"), lambda acc, n: acc + n
    )
    return documents.withColumn("total_transactions", total).withColumn(
        "avg_transactions_per_block", ratio(F.col("total_transactions"), F.size("blocks"))
    )


def flatten_transactions(documents: DataFrame, key: str) -> DataFrame:
    """One row per transaction of every block."""
    blocks = documents.select(key, F.explode("blocks").alias("block"))
    return blocks.select(key, F.col("block.number").alias("number"), F.explode("block.transactions").alias("tx")).select(
        key, "number", "tx.hash", "tx.from", "tx.to", "tx.value"
    )


def record_type(body: Column) -> Column:
    """Kind of a JSON record by the keys it holds, null when none fits."""
    return F.coalesce(*[F.when(has_keys(body, *keys), F.lit(kind)) for kind, keys in RECORD_KEYS])


def compress_long(text: Column) -> Column:
    """zlib as hex for long text, other text as it is."""
    return F.when(F.char_length(text) > COMPRESS_ABOVE, zlib_hex(text)).otherwise(text)


def shape_text(df: DataFrame, *columns: str) -> DataFrame:
    """Compress long text and flag it. Short values never reach the Python worker."""
    for name in columns:
        df = df.withColumn(f"{name}_compressed", F.coalesce(F.char_length(name) > COMPRESS_ABOVE, F.lit(False)))
        long_text = zlib_hex(F.when(F.col(f"{name}_compressed"), F.col(name)))
        df = df.withColumn(name, F.coalesce(long_text, F.col(name)))
    return df


def shape_json(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns to JSON text, nulls kept."""
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in columns})


def shape_numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def numeric_profile(df: DataFrame, *fields: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), minimum and maximum per field that has values."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    return (
        df.select(F.inline(cells))
        .filter(F.col("v").isNotNull())
        .groupBy("field")
        .agg(
            F.avg("v").alias("mean"),
            F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
    )


def format_evm_block(raw: DataFrame) -> DataFrame:
    """Raw EVM blocks: hex text for binary fields, epoch to timestamp, shaped transactions."""
    transactions = F.transform(
        "transactions",
        lambda t: F.struct(
            F.lower(F.hex(t["hash"])).alias("hash"),
            t["from"].alias("from"),
            t["to"].alias("to"),
            t["value"].alias("value"),
            t["gas"].alias("gas"),
            t["gasPrice"].alias("gas_price"),
            t["nonce"].alias("nonce"),
        ),
    )
    return raw.select(
        "number",
        F.lower(F.hex("hash")).alias("hash"),
        F.lower(F.hex("parentHash")).alias("parent_hash"),
        F.timestamp_seconds("timestamp").alias("timestamp"),
        transactions.alias("transactions"),
        F.col("gasUsed").alias("gas_used"),
        F.col("gasLimit").alias("gas_limit"),
        F.col("baseFeePerGas").alias("base_fee_per_gas"),
        F.lower(F.hex("extraData")).alias("extra_data"),
    )


def format_evm_hashes(raw: DataFrame) -> DataFrame:
    """The same for blocks that carry bare transaction hashes."""
    shaped = F.transform("transactions", lambda h: F.lower(F.hex(h)))
    return raw.withColumn("transactions", shaped).withColumn("timestamp", F.timestamp_seconds("timestamp"))


# JSON texts that count as "no error": fixed values.
NO_ERROR = ("", "null", "false", "0", "{}", "[]", '""')


def format_slot_block(raw: DataFrame, as_of: str) -> DataFrame:
    """Raw slot-chain blocks; a missing (or zero) block time becomes `as_of`."""

    def shape(t: Column) -> Column:
        failed = F.coalesce(~F.trim(t["meta"]["err"]).isin(*NO_ERROR), F.lit(False))
        return F.struct(
            F.get(t["transaction"]["signatures"], F.lit(0)).alias("signature"),
            t["slot"].alias("slot"),
            t["meta"]["err"].alias("error"),
            t["meta"]["fee"].alias("fee"),
            F.when(failed, "failed").otherwise("success").alias("status"),
        )

    return raw.select(
        (F.col("parentSlot") + 1).alias("slot"),
        F.col("parentSlot").alias("parent_slot"),
        "blockhash",
        F.col("previousBlockhash").alias("previous_blockhash"),
        F.coalesce(F.timestamp_seconds(F.nullif("blockTime", F.lit(0))), F.lit(as_of).cast("timestamp")).alias("timestamp"),
        F.transform("transactions", shape).alias("transactions"),
        F.coalesce("rewards", F.array().cast("array<string>")).alias("rewards"),
        F.col("blockHeight").alias("block_height"),
        F.col("blockTime").alias("block_time"),
    )


def transaction_details(raw: DataFrame, limit: int = 10) -> DataFrame:
    """Signature and success of the first transactions of each block."""
    detail = F.transform(
        F.slice("transactions", 1, limit),
        lambda t: F.struct(
            F.get(t["transaction"]["signatures"], F.lit(0)).alias("signature"),
            F.coalesce(F.trim(t["meta"]["err"]).isin(*NO_ERROR), F.lit(True)).alias("success"),
        ),
    )
    return raw.withColumn("transaction_details", detail)
