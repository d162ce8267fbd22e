"""The test tables in the shape of the operators' inputs.

Every view is a row-local projection of a table, but for `blocks`, whose transaction counts are
one pre-aggregated row per order. `CTES` holds the same views in SQL for the oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.session import configure

AS_OF = "2001-08-15 00:00:00"  # two weeks after the last order
DAYS = 2500  # reaches back before the first order, so period queries read the whole table
EVENTS_AS_OF = "2024-01-31 00:00:00"
FIRST_CHAIN = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _address(key: str) -> Column:
    """A key as an account address: 0x and forty hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(key), 40, "0")))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def headers(self) -> DataFrame:
        """Blocks without transaction counts: no join."""
        key = F.col("o_orderkey")
        return self.read("orders").select(
            F.when(F.col("o_orderpriority").isin(*FIRST_CHAIN), "ethereum").otherwise("solana").alias("blockchain"),
            key.alias("block_number"),
            F.md5(key.cast("string").cast("binary")).alias("block_hash"),
            F.md5((key - 1).cast("string").cast("binary")).alias("parent_hash"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            (F.col("o_totalprice") / 7).alias("gas_used"),
            (F.col("o_totalprice") * 2).alias("gas_limit"),
            key.alias("slot"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        counts = self.read("lineitem").groupBy(F.col("l_orderkey").alias("block_number")).agg(F.count("*").alias("n"))
        return (
            self.headers.join(counts, "block_number", "left")
            .withColumn("transaction_count", F.coalesce("n", F.lit(0)))
            .drop("n")
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.read("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_hash"),
            F.col("l_orderkey").alias("block_height"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            (F.col("l_returnflag") != "R").alias("success"),
            _address("l_suppkey").alias("from_address"),
            _address("l_partkey").alias("to_address"),
            # Cents and sixteen digits more: amounts beyond 64 bits, few of them equal.
            F.concat(F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.lpad(F.col("l_orderkey") * 7919, 16, "0")).alias("value"),
            F.col("l_quantity").cast("bigint").alias("gas"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.read("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("series"),
            "value",
        )

    @cached_property
    def requests(self) -> DataFrame:
        tokens = F.get_json_object("props", "$.k").cast("bigint")
        return self.read("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            F.col("event_type").alias("endpoint"),
            F.when(tokens < 34, "model-a").when(tokens < 67, "model-b").otherwise("model-c").alias("model"),
            F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
            (F.col("value") / 7).alias("latency"),
            tokens.alias("tokens"),
        )

    @cached_property
    def prompts(self) -> DataFrame:
        """User turns; `ord` is their order in the log."""
        return self.read("conversations").filter(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("prompt")
        )

    @cached_property
    def chain_documents(self) -> DataFrame:
        """One nested block document per text: a line is a block, a sentence a transaction.

        Blank lines leave gaps in the block numbers, short lines have no hash and short
        sentences no receiver, so every quality rule sees passing and failing documents. Built row by row from
        the whole text: no grouping, so no document depends on how many rows share a key.
        """
        lines = F.filter(
            F.transform(
                F.split("text", "\n"),
                lambda line, i: F.struct(line.alias("line"), i.cast("bigint").alias("i")),
            ),
            lambda b: F.trim(b["line"]) != "",
        )
        start = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
        blocks = F.transform(
            lines,
            lambda b: F.struct(
                b["i"].alias("number"),
                F.when(F.length(b["line"]) >= 20, F.md5(b["line"].cast("binary"))).alias("hash"),
                F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") + F.least(F.length(b["line"]), F.lit(300)))
                .alias("timestamp"),
                F.transform(
                    F.split(b["line"], r"\. "),
                    lambda part: F.struct(
                        part.alias("hash"),
                        F.substring(part, 1, 1).alias("from"),
                        F.when(F.length(part) > 30, F.substring(part, -1, 1)).alias("to"),
                        F.length(part).cast("double").alias("value"),
                    ),
                ).alias("transactions"),
            ),
        )
        parts = F.size(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ")).cast("bigint")
        return self.read("documents").select(
            "doc_id",
            "lang",
            F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            blocks.alias("blocks"),
            F.when(F.col("source").isNotNull(), F.struct(F.size(lines).cast("bigint").alias("block_count"))).alias(
                "metrics"
            ),
            F.when(F.col("lang") != "en", F.struct(parts.alias("total_transactions"))).alias("transaction_metrics"),
        )

    @cached_property
    def landed(self) -> DataFrame:
        """Landed JSON records of four source types; some lack a required key."""
        orders = self.read("orders").select(
            F.lit("blockchain").alias("source_type"),
            F.col("o_orderkey").alias("record_id"),
            F.when(
                F.col("o_orderstatus") == "O",
                F.concat(F.lit('{"block_height":'), "o_orderkey", F.lit(',"transactions":[]}')),
            )
            .when(
                F.col("o_orderstatus") == "F",
                F.concat(F.lit('{"slot":'), "o_orderkey", F.lit(',"blockhash":"h","transactions":[]}')),
            )
            .otherwise(F.concat(F.lit('{"slot":'), "o_orderkey", F.lit(',"transactions":[]}')))
            .alias("body"),
        )
        kind = F.col("event_type")
        events = self.read("events")
        models = events.select(
            F.lit("ai_models").alias("source_type"),
            F.col("event_id").alias("record_id"),
            F.concat(
                F.lit('{"model":"'), kind, F.when(kind == "view", '"}').otherwise(F.concat(F.lit('","predictions":['), "value", F.lit("]}")))
            ).alias("body"),
        )
        sensors = events.select(
            F.lit("sensors").alias("source_type"),
            F.col("event_id").alias("record_id"),
            F.concat(
                F.lit('{"sensor_id":"'),
                "user_id",
                F.lit('","timestamp":"'),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(kind == "click", '"}').otherwise(F.concat(F.lit('","readings":{"v":'), "value", F.lit("}}"))),
            ).alias("body"),
        )
        external = events.select(
            F.lit("external").alias("source_type"),
            F.col("event_id").alias("record_id"),
            F.when(kind == "error", "{}").otherwise(F.col("props")).alias("body"),
        )
        return orders.unionByName(models).unionByName(sensors).unionByName(external)

    @cached_property
    def payloads(self) -> DataFrame:
        """API response texts in three shapes: list, object with `data`, single object."""

        def item(key: str, name: str):
            return F.struct(F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"))

        listed = self.read("customer").select(
            F.lit("list").alias("shape"),
            F.to_json(
                F.array(
                    item("c_custkey", "c_name"),
                    F.struct((-F.col("c_custkey") - 1).cast("bigint").alias("id"), F.col("c_mktsegment").alias("name")),
                )
            ).alias("body"),
        )
        data = self.read("supplier").select(
            F.lit("data").alias("shape"),
            F.to_json(F.struct(F.array(item("s_suppkey", "s_name")).alias("data"), F.lit(1).alias("page"))).alias("body"),
        )
        single = self.read("part").select(F.lit("single").alias("shape"), F.to_json(item("p_partkey", "p_name")).alias("body"))
        return listed.unionByName(data).unionByName(single)

    @cached_property
    def prompt_records(self) -> DataFrame:
        """Prompt records as JSON: some prompts are hot, long or lack a safety setting."""
        length = F.char_length("text")
        quoted = F.to_json(F.array("text"))
        safety = F.when(length > 200, F.lit('{"toxicity":1,"hate_speech":1}')).otherwise(
            F.lit('{"toxicity":1,"hate_speech":1,"violence":1}')
        )
        return self.read("conversations").filter(F.col("role") == "user").select(
            "conv_id",
            "turn",
            F.concat(
                F.lit('{"prompt":'),
                quoted.substr(F.lit(2), F.length(quoted) - 2),
                F.lit(',"timestamp":"2024-01-01T00:00:00","model_version":"1","parameters":{"n":1},"max_tokens":'),
                (F.col("turn") * 10).cast("string"),
                F.lit(',"temperature":'),
                F.concat(F.col("turn").cast("string"), F.lit(".5")),
                F.lit(',"context_length":'),
                (length * 600).cast("string"),
                F.lit(',"safety_settings":'),
                safety,
                F.lit("}"),
            ).alias("body"),
        )

    @cached_property
    def typed_records(self) -> DataFrame:
        """JSON records of the other kinds, with missing and mistyped fields among them."""
        conv = self.read("conversations").filter(F.col("role") == "assistant")
        quoted = F.to_json(F.array("text"))
        text = quoted.substr(F.lit(2), F.length(quoted) - 2)
        output = conv.select(
            F.lit("llm_output").alias("kind"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"),
            F.concat(
                F.lit('{"input_id":"'), "conv_id", F.lit('","response":'), text,
                F.lit(',"timestamp":"t","model_version":"1","metrics":{"a":1},"tokens":'),
                F.when(F.col("turn") == 1, "true").when(F.col("turn") == 3, "1.5").otherwise("7"),
                F.lit("}"),
            ).alias("body"),
        )
        kind = F.col("event_type")
        metrics = self.read("events").select(
            F.lit("model_metrics").alias("kind"),
            F.col("event_id").alias("record_id"),
            F.concat(
                F.lit('{"model_id":"'), kind, F.lit('","timestamp":"t","latency":'),
                F.when(kind == "click", "3").otherwise("3.25"),
                F.lit(',"tokens_per_second":10.5,"memory_usage":1.5e3'),
                F.when(kind == "view", "}").otherwise(',"error_rate":0.5}'),
            ).alias("body"),
        )
        docs = self.read("documents")
        quoted_doc = F.to_json(F.array("text"))
        training = docs.select(
            F.lit("training_data").alias("kind"),
            F.col("doc_id").alias("record_id"),
            F.concat(
                F.lit('{"input":'), quoted_doc.substr(F.lit(2), F.length(quoted_doc) - 2),
                F.lit(',"output":"o","dataset_version":'),
                F.when(F.col("lang") == "en", "1").otherwise('"1"'),
                F.lit(',"quality_score":0.5,"metadata":'),
                F.when(F.col("lang") == "de", "[]").otherwise("{}"),
                F.lit("}"),
            ).alias("body"),
        )
        return output.unionByName(metrics).unionByName(training)

    @cached_property
    def raw_evm_blocks(self) -> DataFrame:
        """Raw EVM blocks, one per text line."""
        return self.chain_documents.select("doc_id", F.explode("blocks").alias("b")).select(
            "doc_id",
            F.col("b.number").alias("number"),
            F.unhex("b.hash").alias("hash"),
            F.unhex(F.md5(F.col("b.number").cast("string").cast("binary"))).alias("parentHash"),
            F.unix_timestamp("b.timestamp").alias("timestamp"),
            F.transform(
                "b.transactions",
                lambda t: F.struct(
                    t["hash"].cast("binary").alias("hash"),
                    t["from"].alias("from"),
                    t["to"].alias("to"),
                    (t["value"] * 1000).cast("decimal(38,0)").alias("value"),
                    F.lit(21000).cast("bigint").alias("gas"),
                    F.lit(5).cast("bigint").alias("gasPrice"),
                    F.lit(0).cast("bigint").alias("nonce"),
                ),
            ).alias("transactions"),
            F.size("b.transactions").cast("bigint").alias("gasUsed"),
            F.lit(30000000).cast("bigint").alias("gasLimit"),
            F.when(F.col("b.hash").isNotNull(), F.size("b.transactions").cast("bigint")).alias("baseFeePerGas"),
            F.encode(F.lit("x"), "utf-8").alias("extraData"),
        )

    @cached_property
    def raw_slot_blocks(self) -> DataFrame:
        """Raw slot-chain blocks, one per text line; errors come as JSON text."""
        return self.chain_documents.select("doc_id", F.explode("blocks").alias("b")).select(
            "doc_id",
            F.col("b.number").alias("parentSlot"),
            F.col("b.hash").alias("blockhash"),
            F.md5(F.col("b.number").cast("string").cast("binary")).alias("previousBlockhash"),
            F.transform(
                "b.transactions",
                lambda t: F.struct(
                    F.struct(F.array(t["hash"], t["from"]).alias("signatures")).alias("transaction"),
                    F.lit(0).cast("bigint").alias("slot"),
                    F.struct(
                        F.when(t["value"] > 60, '{"InstructionError":1}').when(t["value"] > 40, "{}").alias("err"),
                        t["value"].cast("bigint").alias("fee"),
                    ).alias("meta"),
                ),
            ).alias("transactions"),
            F.lit(None).cast("array<string>").alias("rewards"),
            F.col("b.number").alias("blockHeight"),
            F.when(F.col("b.hash").isNotNull(), F.unix_timestamp("b.timestamp")).alias("blockTime"),
        )

    @cached_property
    def file_names(self) -> DataFrame:
        """Directory listings: one directory per customer, file names by order priority."""
        name = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "config.json")
            .when(F.col("o_orderpriority") == "2-HIGH", "pytorch_model.bin")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "tokenizer.json")
            .otherwise("notes.txt")
        )
        return self.read("orders").select(F.col("o_custkey").alias("dir"), name.alias("name"))


_CHAIN = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'ethereum' ELSE 'solana' END"

CTES = {
    "headers": f"""
        SELECT {_CHAIN} AS blockchain, o_orderkey AS block_number, md5(o_orderkey::VARCHAR) AS block_hash,
               md5((o_orderkey - 1)::VARCHAR) AS parent_hash, o_orderdate AS timestamp,
               o_totalprice / 7 AS gas_used, o_totalprice * 2 AS gas_limit, o_orderkey AS slot
        FROM orders""",
    "blocks": f"""
        SELECT {_CHAIN} AS blockchain, o_orderkey AS block_number, md5(o_orderkey::VARCHAR) AS block_hash,
               md5((o_orderkey - 1)::VARCHAR) AS parent_hash, o_orderdate AS timestamp,
               o_totalprice / 7 AS gas_used, o_totalprice * 2 AS gas_limit, o_orderkey AS slot,
               COALESCE(n, 0)::BIGINT AS transaction_count
        FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey)
             ON l_orderkey = o_orderkey""",
    "transactions": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_hash,
               l_orderkey AS block_height, l_shipdate AS timestamp, l_returnflag <> 'R' AS success,
               '0x' || lower(lpad(hex(l_suppkey), 40, '0')) AS from_address, '0x' || lower(lpad(hex(l_partkey), 40, '0')) AS to_address,
               round(l_extendedprice * 100)::BIGINT::VARCHAR || lpad((l_orderkey * 7919)::VARCHAR, 16, '0') AS value, l_quantity::BIGINT AS gas
        FROM lineitem""",
    "samples": "SELECT event_id, ts, event_type AS series, value FROM events",
    "requests": """
        SELECT event_id, ts, user_id, event_type AS endpoint,
               CASE WHEN (props->>'$.k')::BIGINT < 34 THEN 'model-a' WHEN (props->>'$.k')::BIGINT < 67 THEN 'model-b'
                    ELSE 'model-c' END AS model,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               value / 7 AS latency, (props->>'$.k')::BIGINT AS tokens
        FROM events""",
    "prompts": "SELECT conv_id * 1000 + turn AS ord, text AS prompt FROM conversations WHERE role = 'user'",
    # One row per block of a document, and one per transaction.
    "doc_lines": """
        SELECT doc_id, i, line FROM (
            SELECT doc_id, UNNEST(range(len(string_split(text, chr(10))))) AS i,
                   UNNEST(string_split(text, chr(10))) AS line FROM documents)
        WHERE trim(line, ' ') <> ''""",
    "doc_blocks": """
        SELECT doc_id, i AS number, CASE WHEN length(line) >= 20 THEN md5(line) END AS hash,
               1704067200 + doc_id + least(length(line), 300) AS ts, string_split(line, '. ') AS words
        FROM doc_lines""",
    "doc_txs": """
        SELECT doc_id, number, word, left(word, 1) AS sender,
               CASE WHEN length(word) > 30 THEN right(word, 1) END AS receiver
        FROM (SELECT doc_id, number, UNNEST(words) AS word FROM doc_blocks)""",
    "landed": """
        SELECT 'blockchain' AS source_type, o_orderkey AS record_id,
               CASE o_orderstatus WHEN 'O' THEN '{"block_height":' || o_orderkey || ',"transactions":[]}'
                    WHEN 'F' THEN '{"slot":' || o_orderkey || ',"blockhash":"h","transactions":[]}'
                    ELSE '{"slot":' || o_orderkey || ',"transactions":[]}' END AS body FROM orders
        UNION ALL SELECT 'ai_models', event_id, '{"model":"' || event_type ||
               CASE WHEN event_type = 'view' THEN '"}' ELSE '","predictions":[' || value || ']}' END FROM events
        UNION ALL SELECT 'sensors', event_id, '{"sensor_id":"' || user_id || '","timestamp":"' ||
               strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
               CASE WHEN event_type = 'click' THEN '"}' ELSE '","readings":{"v":' || value || '}}' END FROM events
        UNION ALL SELECT 'external', event_id, CASE WHEN event_type = 'error' THEN '{}' ELSE props END FROM events""",
    "file_names": """
        SELECT o_custkey AS dir, CASE o_orderpriority WHEN '1-URGENT' THEN 'config.json'
               WHEN '2-HIGH' THEN 'pytorch_model.bin' WHEN '3-MEDIUM' THEN 'tokenizer.json' ELSE 'notes.txt' END AS name
        FROM orders""",
    "raw_slot_txs": """
        SELECT doc_id, number, i, word, CASE WHEN length(word) > 60 THEN 'failed' ELSE 'success' END AS status FROM (
            SELECT doc_id, number, UNNEST(range(len(words))) AS i, UNNEST(words) AS word FROM doc_blocks)""",
}
