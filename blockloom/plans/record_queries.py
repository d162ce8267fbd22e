"""Validators, named transforms, record shaping and payload unwrapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.scalars import iso_text
from blockloom.operators import records, validate
from blockloom.operators import transforms as tr
from blockloom.plans.registry import query
from blockloom.plans.standins import EVENTS_AS_OF
from blockloom.schemas import RECORD_FIELDS
from blockloom.sources import committed, payload
from blockloom.sources.named import Sources

ISO = "'%Y-%m-%d %H:%M:%S.%f'"


def _rule_query(name: str, source: str, sql: str):
    @query(name, f"SELECT record_id, {sql} AS valid FROM landed WHERE source_type = '{source}'", ("landed",))
    def _(t):
        rule = validate.SOURCE_RULES[source]
        return t.landed.filter(F.col("source_type") == source).select("record_id", rule(F.col("body")).alias("valid"))


_KEYS = "json_keys(body)"
_rule_query(
    "valid_blockchain",
    "blockchain",
    f"(list_has_all({_KEYS}, ['block_height','transactions']) OR list_has_all({_KEYS}, ['slot','blockhash','transactions']))",
)
_rule_query("valid_ai_model", "ai_models", f"list_has_all({_KEYS}, ['model','predictions'])")
_rule_query("valid_sensor", "sensors", f"list_has_all({_KEYS}, ['sensor_id','timestamp','readings'])")
_rule_query("valid_external", "external", "body NOT IN ('', '{}', '[]', 'null')")


@query("non_empty", "SELECT COUNT(*) > 0 AS non_empty FROM events")
def _(t):
    return validate.non_empty(t.events)


@query(
    "valid_llm_input",
    """SELECT conv_id, turn, length(text) BETWEEN 1 AND 32000 AND turn + 0.5 <= 2 AND length(text) * 600 <= 128000
              AND length(text) <= 200 AS valid
       FROM conversations WHERE role = 'user'""",
)
def _(t):
    return validate.valid_record(t.prompt_records, "body", "llm_input").select("conv_id", "turn", "valid")


def _kind(t, kind: str):
    return t.typed_records.filter(F.col("kind") == kind)


@query(
    "valid_llm_output",
    "SELECT conv_id * 1000 + turn AS record_id, turn <> 3 AS valid FROM conversations WHERE role = 'assistant'",
)
def _(t):
    return validate.valid_record(_kind(t, "llm_output"), "body", "llm_output").select("record_id", "valid")


@query("valid_model_metrics", "SELECT event_id AS record_id, event_type NOT IN ('click', 'view') AS valid FROM events")
def _(t):
    return validate.valid_record(_kind(t, "model_metrics"), "body", "model_metrics").select("record_id", "valid")


@query("valid_training_data", "SELECT doc_id AS record_id, lang NOT IN ('en', 'de') AS valid FROM documents")
def _(t):
    return validate.valid_record(_kind(t, "training_data"), "body", "training_data").select("record_id", "valid")


@query(
    "field_check_reason",
    """SELECT event_id AS record_id, CASE event_type WHEN 'click' THEN 'invalid type: latency'
              WHEN 'view' THEN 'missing field: error_rate' END AS reason FROM events""",
)
def _(t):
    records_ = _kind(t, "model_metrics")
    return validate.field_reason(records_, "body", RECORD_FIELDS["model_metrics"]).select("record_id", "reason")


@query(
    "typed_field_reason",
    """SELECT event_id, CASE WHEN tokens IS NULL OR latency IS NULL THEN 'invalid type' ELSE 'invalid type: status' END AS reason
       FROM requests""",
    ("requests",),
)
def _(t):
    fields = {"latency": "float", "tokens": "int", "status": "dict"}
    return t.requests.select("event_id", validate.typed_field_reason(t.requests, fields).alias("reason"))


@query(
    "dataset_gate",
    """SELECT 'llm_output' AS target, bool_and(turn <> 3) AS valid FROM conversations WHERE role = 'assistant'
       UNION ALL SELECT 'model_metrics', bool_and(event_type NOT IN ('click', 'view')) FROM events
       UNION ALL SELECT 'unknown_target', false""",
)
def _(t):
    gates = [
        validate.dataset_gate(_kind(t, "llm_output"), "llm_output"),
        validate.dataset_gate(_kind(t, "model_metrics"), "model_metrics"),
        validate.dataset_gate(_kind(t, "training_data"), "unknown_target"),
    ]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


LIMITS = {"accuracy": ("min", 0.95), "latency": ("max", 4.0), "error_rate": ("max", 0.01)}


@query(
    "sla_violations",
    """WITH m AS (SELECT endpoint, model, COUNT(*) FILTER (status = 'success')::DOUBLE / COUNT(*) AS accuracy,
                         round(SUM(latency) / COUNT(*), 4) AS latency,
                         COUNT(*) FILTER (status = 'error')::DOUBLE / COUNT(*) AS error_rate
                  FROM requests GROUP BY ALL)
       SELECT endpoint, model, 'accuracy' AS metric, accuracy AS value, 0.95::DOUBLE AS threshold FROM m WHERE accuracy < 0.95
       UNION ALL SELECT endpoint, model, 'latency', latency, 4.0::DOUBLE FROM m WHERE latency > 4
       UNION ALL SELECT endpoint, model, 'error_rate', error_rate, 0.01::DOUBLE FROM m WHERE error_rate > 0.01""",
    ("requests",),
)
def _(t):
    n = F.count("*")
    metrics = t.requests.groupBy("endpoint", "model").agg(
        (F.count_if(F.col("status") == "success") / n).alias("accuracy"),
        F.round(F.avg("latency"), 4).alias("latency"),
        (F.count_if(F.col("status") == "error") / n).alias("error_rate"),
    )
    return validate.sla_violations(metrics, ["endpoint", "model"], LIMITS)


@query(
    "required_files",
    """SELECT dir, bool_or(name = 'config.json') AND bool_or(name = 'pytorch_model.bin')
              AND bool_or(name = 'tokenizer.json') AS complete FROM file_names GROUP BY dir""",
    ("file_names",),
)
def _(t):
    return validate.required_files(t.file_names)


@query(
    "api_payload_unwrap",
    """SELECT 'list' AS shape, c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT 'list', -c_custkey - 1, c_mktsegment FROM customer
       UNION ALL SELECT 'data', s_suppkey, s_name FROM supplier
       UNION ALL SELECT 'single', p_partkey, p_name FROM part""",
)
def _(t):
    return payload.unwrap(t.payloads).select(
        "shape",
        F.variant_get("item", "$.id", "bigint").alias("id"),
        F.variant_get("item", "$.name", "string").alias("name"),
    )


@query("sql_extract_params", "SELECT event_id, user_id, value FROM events WHERE value > 1.5")
def _(t):
    return tr.extract(
        t.spark,
        "SELECT event_id, user_id, value FROM extract_source WHERE value > :min_value",
        {"min_value": 1.5},
        extract_source=t.events,
    )


def _transforms() -> tr.Transforms:
    known = tr.Transforms()
    known.register("double_value", lambda df: df.withColumn("value", F.col("value") * 2))
    known.register("tag", lambda df: df.withColumn("tag", F.concat_ws("-", "event_type", F.col("user_id").cast("string"))))
    known.register("upper_tag", lambda df: df.withColumn("tag", F.upper("tag")))
    return known


@query(
    "transform_chain",
    """SELECT event_id, user_id, event_type, value * 2 AS value, upper(event_type || '-' || user_id) AS tag FROM events""",
)
def _(t):
    source = t.events.select("event_id", "user_id", "event_type", "value")
    return _transforms().apply(source, ["double_value", "tag", "upper_tag"])


@query(
    "etl_batch",
    "SELECT event_id, user_id, event_type, value * 2 AS value, event_type || '-' || user_id AS tag FROM events",
)
def _(t):
    from blockloom.session import work_dir

    path = work_dir(t.spark, "etl")
    source = t.events.select("event_id", "user_id", "event_type", "value")
    for _ in range(2):  # a repeated run changes nothing
        if not tr.run_batch(source, _transforms(), ["double_value", "tag"], F.col("value") >= 0, path, "day-1"):
            raise ValueError("the batch was refused")
    return committed.read(t.spark, path)


@query("etl_load_validated", "SELECT event_id, user_id, value FROM events")
def _(t):
    from blockloom.session import work_dir

    path = work_dir(t.spark, "load")
    rows = t.events.select("event_id", "user_id", "value")
    half = F.col("event_id") % 2 == 0
    tr.load_validated(rows, F.col("value") < 0, path, "refused")  # commits nothing: no row passes
    for run, part in (("even", rows.filter(half)), ("odd", rows.filter(~half)), ("even", rows.filter(half))):
        tr.load_validated(part, F.col("value") >= 0, path, run)
    return committed.read(t.spark, path)


@query("quarantine_split", "SELECT event_id, value >= 5 AS kept FROM events")
def _(t):
    kept, held = tr.split_valid(t.events.select("event_id", "value"), F.col("value") >= 5)
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(held.select("event_id", F.lit(False).alias("kept")))


@query("processing_steps", "SELECT event_id, value + 1 AS value, md5(event_type) AS event_type FROM events")
def _(t):
    steps = tr.ProcessingSteps()
    steps.add(lambda df: df.withColumn("value", F.col("value") + 1))
    steps.add(lambda df: df.withColumn("event_type", F.md5(F.col("event_type").cast("binary"))), requires_auth=True)
    return steps.run(t.events.select("event_id", "value", "event_type"), authorized=True)


@query(
    "run_window_stamp",
    f"""SELECT event_id, '2024-01-01 00:00:00.000000' AS start_time, '2024-01-31 00:00:00.000000' AS end_time,
               '{EVENTS_AS_OF}.000000' AS processing_time FROM events""",
)
def _(t):
    stamped = tr.stamp_run(t.events.select("event_id"), "2024-01-01", "2024-01-31", EVENTS_AS_OF)
    return stamped.select(
        "event_id", *[iso_text(F.col(c)).alias(c) for c in ("start_time", "end_time", "processing_time")]
    )


@query(
    "normalize_timestamps",
    f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(date_trunc('second', ts), {ISO}) END AS timestamp,
               '{EVENTS_AS_OF}.000000' AS processed_at FROM events""",
)
def _(t):
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    out = tr.normalize_timestamps(t.events.select("event_id", text.alias("timestamp")), "timestamp", EVENTS_AS_OF)
    return out.select("event_id", *[iso_text(F.col(c)).alias(c) for c in ("timestamp", "processed_at")])


@query(
    "block_metrics",
    """SELECT d.doc_id, COUNT(b.number) AS total_blocks,
              COALESCE(string_agg(b.number::VARCHAR, ',' ORDER BY b.number), '') AS block_numbers,
              COALESCE(string_agg(strftime(make_timestamp(b.ts * 1000000), '%H%M%S'), ',' ORDER BY b.number), '') AS block_times
       FROM documents d LEFT JOIN doc_blocks b ON d.doc_id = b.doc_id GROUP BY d.doc_id""",
    ("doc_lines", "doc_blocks"),
)
def _(t):
    out = records.block_metrics(t.chain_documents)
    times = F.transform("block_times", lambda ts: F.date_format(ts, "HHmmss"))
    return out.select(
        "doc_id",
        "total_blocks",
        F.array_join(F.col("block_numbers").cast("array<string>"), ",").alias("block_numbers"),
        F.array_join(times, ",").alias("block_times"),
    )


@query(
    "tx_metrics",
    """SELECT d.doc_id, COALESCE(SUM(len(words)), 0)::BIGINT AS total_transactions,
              CASE WHEN COUNT(number) = 0 THEN 0 ELSE SUM(len(words))::DOUBLE / COUNT(number) END AS avg_transactions_per_block
       FROM documents d LEFT JOIN doc_blocks b ON d.doc_id = b.doc_id GROUP BY d.doc_id""",
    ("doc_lines", "doc_blocks"),
)
def _(t):
    return records.transaction_metrics(t.chain_documents).select(
        "doc_id", "total_transactions", "avg_transactions_per_block"
    )


@query(
    "flatten_transactions",
    """SELECT doc_id, number, word AS hash, sender AS "from", receiver AS "to", length(word)::DOUBLE AS value FROM doc_txs""",
    ("doc_lines", "doc_blocks", "doc_txs"),
)
def _(t):
    return records.flatten_transactions(t.chain_documents, "doc_id")


@query(
    "record_type",
    """SELECT 'prompt' AS source, conv_id * 1000 + turn AS record_id, 'llm_input' AS record_type FROM conversations WHERE role = 'user'
       UNION ALL SELECT 'llm_output', conv_id * 1000 + turn, 'llm_output' FROM conversations WHERE role = 'assistant'
       UNION ALL SELECT 'model_metrics', event_id, 'model_metrics' FROM events
       UNION ALL SELECT 'training_data', doc_id, 'training_data' FROM documents
       UNION ALL SELECT source_type, record_id, NULL FROM landed""",
    ("landed",),
)
def _(t):
    prompts = t.prompt_records.select(
        F.lit("prompt").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), "body"
    )
    typed = t.typed_records.withColumnRenamed("kind", "source")
    landed = t.landed.withColumnRenamed("source_type", "source")
    return (
        prompts.unionByName(typed)
        .unionByName(landed)
        .select("source", "record_id", records.record_type(F.col("body")).alias("record_type"))
    )


@query(
    "shape_records",
    """SELECT doc_id, length(text) > 1000 AS text_compressed, CASE WHEN length(text) <= 1000 THEN text END AS plain,
              '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata
       FROM documents""",
)
def _(t):
    docs = t.documents.select("doc_id", "text", F.struct("lang", "source").alias("metadata"))
    shaped = records.shape_json(records.shape_text(docs, "text"), "metadata")
    return shaped.select(
        "doc_id", "text_compressed", F.when(~F.col("text_compressed"), F.col("text")).alias("plain"), "metadata"
    )


@query("shape_numbers", "SELECT event_id, round(value / 7, 4) AS latency FROM events")
def _(t):
    return records.shape_numbers(t.events.select("event_id", (F.col("value") / 7).alias("latency")), "latency")


@query(
    "numeric_profile",
    """SELECT 'latency' AS field, round(AVG(latency), 6) AS mean, round(COALESCE(stddev_samp(latency), 0), 6) AS std,
              MIN(latency) AS min, MAX(latency) AS max FROM requests
       UNION ALL SELECT 'tokens_per_second', round(AVG(tokens), 6), round(stddev_samp(tokens), 6), MIN(tokens), MAX(tokens)
       FROM requests""",
    ("requests",),
)
def _(t):
    rows = t.requests.select("latency", F.col("tokens").alias("tokens_per_second"))
    out = records.numeric_profile(rows, "latency", "tokens_per_second")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "format_evm_block",
    f"""SELECT doc_id, number, hash, md5(number::VARCHAR) AS parent_hash, strftime(make_timestamp(ts * 1000000), {ISO}) AS timestamp,
              len(words) AS gas_used, 30000000::BIGINT AS gas_limit, CASE WHEN hash IS NOT NULL THEN len(words) END AS base_fee_per_gas,
              '78' AS extra_data, lower(hex(encode(words[1]))) AS first_hash,
              (length(array_to_string(words, '')) * 1000)::BIGINT AS total_value
       FROM doc_blocks""",
    ("doc_lines", "doc_blocks"),
)
def _(t):
    # The block projection has a fixed set of columns, so the document id travels in `number`.
    tagged = t.raw_evm_blocks.withColumn("number", F.struct("doc_id", "number"))
    shaped = records.format_evm_block(tagged)
    total = F.aggregate("transactions", F.lit(0).cast("bigint"), lambda acc, tx: acc + tx["value"].cast("bigint"))
    return shaped.select(
        "number.doc_id",
        F.col("number.number").alias("number"),
        "hash",
        "parent_hash",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "gas_used",
        "gas_limit",
        "base_fee_per_gas",
        "extra_data",
        F.get("transactions", F.lit(0))["hash"].alias("first_hash"),
        total.alias("total_value"),
    )


@query(
    "format_slot_block",
    f"""SELECT b.doc_id, b.number + 1 AS slot, b.number AS parent_slot, b.hash AS blockhash,
               strftime(CASE WHEN b.hash IS NULL THEN TIMESTAMP '{EVENTS_AS_OF}' ELSE make_timestamp(b.ts * 1000000) END, {ISO}) AS timestamp,
               MIN(x.word) FILTER (x.i = 0) AS first_signature, COUNT(*) FILTER (x.status = 'failed') AS failed,
               SUM(length(x.word))::BIGINT AS fees
        FROM doc_blocks b JOIN raw_slot_txs x ON b.doc_id = x.doc_id AND b.number = x.number GROUP BY ALL""",
    ("doc_lines", "doc_blocks", "raw_slot_txs"),
)
def _(t):
    tagged = t.raw_slot_blocks.withColumn("previousBlockhash", F.struct("doc_id", "previousBlockhash"))
    shaped = records.format_slot_block(tagged, EVENTS_AS_OF)
    failed = F.size(F.filter("transactions", lambda tx: tx["status"] == "failed")).cast("bigint")
    fees = F.aggregate("transactions", F.lit(0).cast("bigint"), lambda acc, tx: acc + tx["fee"])
    return shaped.select(
        "previous_blockhash.doc_id",
        "slot",
        "parent_slot",
        "blockhash",
        iso_text(F.col("timestamp")).alias("timestamp"),
        F.get("transactions", F.lit(0))["signature"].alias("first_signature"),
        failed.alias("failed"),
        fees.alias("fees"),
    )


@query(
    "tx_details_top10",
    """SELECT doc_id, number, word AS signature, status = 'success' AS success FROM raw_slot_txs WHERE i < 10""",
    ("doc_lines", "doc_blocks", "raw_slot_txs"),
)
def _(t):
    details = records.transaction_details(t.raw_slot_blocks)
    return details.select(
        "doc_id", F.col("parentSlot").alias("number"), F.explode("transaction_details").alias("d")
    ).select("doc_id", "number", "d.signature", "d.success")


@query(
    "named_sources",
    """SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_totalprice >= 1000
       UNION ALL SELECT 'customers', c_custkey, c_acctbal FROM customer UNION ALL SELECT 'refused', 0, count(*)::DOUBLE FROM lineitem""",
)
def _(t):
    """Three registered sources, one of them with invalid rows, read by name and through views."""
    known = Sources()
    known.register("orders", lambda s, least=0: t.orders.filter(F.col("o_totalprice") >= least), lambda df: df["o_totalprice"] >= 0)
    known.register("customers", lambda s, least=0: t.customer.filter(F.col("c_custkey") >= least), lambda df: df["c_custkey"].isNotNull())
    broken = Sources()
    broken.register("lines", lambda s: t.lineitem, lambda df: df["l_quantity"] < 1)
    try:
        broken.fetch("lines", t.spark)
        refused = t.lineitem.limit(0)
    except ValueError:
        refused = t.lineitem
    known.as_views(t.spark, least=0)
    orders = known.fetch("orders", t.spark, least=1000).select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")
    )
    customers = t.spark.sql("SELECT 'customers' AS source, c_custkey AS id, c_acctbal AS amount FROM customers")
    count = refused.agg(F.lit("refused").alias("source"), F.lit(0).cast("bigint").alias("id"), F.count("*").cast("double").alias("amount"))
    return orders.unionByName(customers).unionByName(count)
