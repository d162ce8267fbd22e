"""Record validators: key presence, field types, bounds, gates and service limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.jsonkeys import has_keys, is_type, type_column, with_field_types
from blockloom.schemas import RECORD_FIELDS

# Bounds of prompt records and the safety settings they must carry: fixed values.
MAX_PROMPT_CHARS = 32000
MAX_TEMPERATURE = 2.0
MAX_CONTEXT = 128000
SAFETY_KEYS = ("toxicity", "hate_speech", "violence")

# Files a model directory must hold: fixed values.
MODEL_FILES = ("config.json", "pytorch_model.bin", "tokenizer.json")


def valid_blockchain(body: Column) -> Column:
    return has_keys(body, "block_height", "transactions") | has_keys(body, "slot", "blockhash", "transactions")


def valid_ai_model(body: Column) -> Column:
    return has_keys(body, "model", "predictions")


def valid_sensor(body: Column) -> Column:
    return has_keys(body, "sensor_id", "timestamp", "readings")


def valid_external(body: Column) -> Column:
    """Anything but an empty payload."""
    return F.coalesce(~F.trim(body).isin("", "{}", "[]", "null"), F.lit(False))


SOURCE_RULES = {
    "blockchain": valid_blockchain,
    "ai_models": valid_ai_model,
    "sensors": valid_sensor,
    "external": valid_external,
}


def non_empty(df: DataFrame) -> DataFrame:
    return df.agg((F.count("*") > 0).alias("non_empty"))


def field_reason(df: DataFrame, body: str, fields: dict[str, str], name: str = "reason") -> DataFrame:
    """Add the first failing field check of JSON records, null when all pass."""
    return _with_reason(df, body, fields, name).select(*df.columns, name)


def _with_reason(df: DataFrame, body: str, fields: dict[str, str], name: str) -> DataFrame:
    typed = with_field_types(df, body, *fields)
    checks = []
    for field, kind in fields.items():
        checks.append(F.when(F.col(type_column(field)).isNull(), F.lit(f"missing field: {field}")))
        checks.append(F.when(~is_type(field, kind), F.lit(f"invalid type: {field}")))
    return typed.withColumn(name, F.coalesce(*checks))


_TYPED = {
    "str": (T.StringType,),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "dict": (T.StructType, T.MapType),
    "list": (T.ArrayType,),
    "bool": (T.BooleanType,),
}


def typed_field_reason(df: DataFrame, fields: dict[str, str]) -> Column:
    """The same check on typed columns: types are settled by the schema, nulls per row."""
    checks = []
    for name, kind in fields.items():
        if name not in df.columns:
            checks.append(F.lit(f"missing field: {name}"))
        elif not isinstance(df.schema[name].dataType, _TYPED[kind]):
            checks.append(F.lit(f"invalid type: {name}"))
        else:
            checks.append(F.when(F.col(name).isNull(), F.lit(f"invalid type: {name}")))
    return F.coalesce(*checks)


def valid_record(df: DataFrame, body: str, target: str, name: str = "valid") -> DataFrame:
    """Add whether JSON records are valid for a target; for an unknown target none is."""
    if target not in RECORD_FIELDS:
        return df.withColumn(name, F.lit(False))
    checked = _with_reason(df, body, RECORD_FIELDS[target], "_reason")
    test = F.col("_reason").isNull()
    if target == "llm_input":
        test = test & _prompt_bounds(F.col("_document"))
    return checked.select(*df.columns, test.alias(name))


def _prompt_bounds(document: Column) -> Column:
    length = F.char_length(F.try_variant_get(document, "$.prompt", "string"))
    temperature = F.try_variant_get(document, "$.temperature", "double")
    context = F.try_variant_get(document, "$.context_length", "bigint")
    test = (
        length.between(1, MAX_PROMPT_CHARS)
        & temperature.between(0.0, MAX_TEMPERATURE)
        & (context <= MAX_CONTEXT)
    )
    for key in SAFETY_KEYS:
        test = test & F.try_variant_get(document, f"$.safety_settings.{key}", "variant").isNotNull()
    return F.coalesce(test, F.lit(False))


def dataset_gate(records: DataFrame, target: str, body: str = "body") -> DataFrame:
    """One row: does every record pass? Data without records passes for a known target."""
    verdict = F.coalesce(F.bool_and("_valid"), F.lit(True)) & F.lit(target in RECORD_FIELDS)
    checked = valid_record(records, body, target, "_valid")
    return checked.agg(verdict.alias("valid")).select(F.lit(target).alias("target"), "valid")


def sla_violations(metrics: DataFrame, keys: list[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per broken limit. `limits` maps a column to ('min' or 'max', threshold)."""
    cells = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("value"),
            F.lit(float(limit)).alias("threshold"),
            ((F.col(name) < limit) if side == "min" else (F.col(name) > limit)).alias("broken"),
        )
        for name, (side, limit) in limits.items()
    ]
    return (
        metrics.select(*keys, F.inline(F.array(*cells))).filter("broken").select(*keys, "metric", "value", "threshold")
    )


def required_files(inventory: DataFrame, required: tuple[str, ...] = MODEL_FILES) -> DataFrame:
    """Is each directory complete? One flag per required name, so state per directory is fixed."""
    flags = [F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)) for name in required]
    return inventory.groupBy("dir").agg(reduce(lambda a, b: a & b, flags).alias("complete"))


