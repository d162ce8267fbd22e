"""Declared record shapes."""

from __future__ import annotations

BLOCKS = """
    blockchain string, block_number bigint, block_hash string, parent_hash string,
    timestamp timestamp, transaction_count bigint, gas_used double, gas_limit double, slot bigint
"""

# Amounts are integers of any length, as text: see `functions.amounts`.
TRANSACTIONS = """
    transaction_hash string, block_height bigint, timestamp timestamp, success boolean,
    from_address string, to_address string, value string, gas bigint
"""

BLOCK_METRICS = "block_number bigint, metric_type string, value double, timestamp timestamp"

SAMPLES = "event_id bigint, ts timestamp, series string, value double"

DOCUMENT = """
    timestamp string,
    blocks array<struct<number: bigint, hash: string, timestamp: timestamp,
        transactions: array<struct<hash: string, `from`: string, `to`: string, value: double>>>>,
    metrics struct<block_count: bigint>,
    transaction_metrics struct<total_transactions: bigint>
"""

# Required fields per record kind: fixed values of the record rules.
RECORD_FIELDS = {
    "llm_input": {
        "prompt": "str",
        "timestamp": "str",
        "model_version": "str",
        "parameters": "dict",
        "max_tokens": "int",
        "temperature": "float",
        "context_length": "int",
        "safety_settings": "dict",
    },
    "llm_output": {
        "input_id": "str",
        "response": "str",
        "timestamp": "str",
        "model_version": "str",
        "metrics": "dict",
        "tokens": "int",
    },
    "model_metrics": {
        "model_id": "str",
        "timestamp": "str",
        "latency": "float",
        "tokens_per_second": "float",
        "memory_usage": "float",
        "error_rate": "float",
    },
    "training_data": {
        "input": "str",
        "output": "str",
        "dataset_version": "str",
        "quality_score": "float",
        "metadata": "dict",
    },
}

# Closed list of storage zones: fixed values.
ZONES = {
    "raw": ["blockchain", "ai_models", "sensors", "external"],
    "processed": ["features", "analytics", "metrics"],
    "models": ["checkpoints", "artifacts", "evaluations"],
    "metadata": ["schemas", "lineage", "audit"],
}

# Role permissions: fixed values.
ROLES = {
    "admin": ["can_train", "can_deploy", "can_monitor", "can_manage_users"],
    "engineer": ["can_train", "can_monitor"],
    "analyst": ["can_monitor"],
    "user": ["can_use_models"],
}

# Default tier policies (name, retention in days, storage class): fixed values.
TIER_POLICIES = [
    ("hot_storage", 30, "local"),
    ("warm_storage", 90, "archive"),
    ("cold_storage", 365, "s3_glacier"),
]
