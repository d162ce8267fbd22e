"""Data quality of nested block documents: metrics, gate, score, report and alerts.

A document is a row with `timestamp`, `blocks`, `metrics` and `transaction_metrics`. All checks are
row-local expressions built from the schema; `missing_in_json` walks JSON text whose keys vary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.jsonkeys import type_column, with_field_types
from blockloom.functions.scalars import is_contiguous, is_sorted

FIELDS = ("timestamp", "blocks", "metrics", "transaction_metrics")
BLOCK_FIELDS = ("number", "hash", "timestamp", "transactions")
TX_FIELDS = ("hash", "from", "to", "value")

# Limits and score weights: fixed values.
MAX_MISSING = 20.0
ISSUE_MISSING = 10.0
MIN_SCORE = 80.0
MIN_CONSISTENCY = 90.0
WEIGHTS = {"missing": 0.4, "types": 0.3, "consistency": 0.3}


# Message texts: fixed values.
HIGH_MISSING = "High percentage of missing values: "
LOW_SCORE = "Low quality score: "
LOW_CONSISTENCY = "Low consistency: "
INVALID_TYPE = "Invalid data type for field: "
ADVISE_SOURCE = "Consider implementing data validation at source"
ADVISE_TYPES = "Review data type handling in ETL pipeline"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _add(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def _is_missing(value: Column, kind: T.DataType) -> Column:
    test = value.isNull()
    if isinstance(kind, T.StringType):
        test = test | (value == "")
    return F.when(test, F.lit(1).cast("bigint")).otherwise(_zero())


def _sum_over(items: Column, each) -> Column:
    present = F.filter(items, lambda x: x.isNotNull())
    return F.coalesce(F.aggregate(present, _zero(), lambda acc, x: acc + each(x)), _zero())


def _leaf_only(kind: T.StructType) -> bool:
    return not any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in kind.fields)


def _field_total(value: Column, kind: T.DataType) -> Column | None:
    """Fields below one value; None when it cannot hold any."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), _struct_total(lambda n: value[n], kind)).otherwise(_zero())
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        inner = kind.elementType
        if _leaf_only(inner):
            count = F.size(F.filter(value, lambda x: x.isNotNull())) if kind.containsNull else F.size(value)
            return F.coalesce(F.greatest(count, F.lit(0)).cast("bigint") * len(inner.fields), _zero())
        return _sum_over(value, lambda x: _struct_total(lambda n: x[n], inner))
    return None


def _struct_total(get, kind: T.StructType) -> Column:
    nested = [_field_total(get(f.name), f.dataType) for f in kind.fields]
    return _add([F.lit(len(kind.fields)).cast("bigint"), *[n for n in nested if n is not None]])


def _struct_missing(get, kind: T.StructType) -> Column:
    parts = []
    for f in kind.fields:
        value = get(f.name)
        parts.append(_is_missing(value, f.dataType))
        if isinstance(f.dataType, T.StructType):
            inner = f.dataType
            parts.append(F.when(value.isNotNull(), _struct_missing(lambda n, v=value: v[n], inner)).otherwise(_zero()))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = f.dataType.elementType
            parts.append(_sum_over(value, lambda x, s=inner: _struct_missing(lambda n: x[n], s)))
    return _add(parts)


def missing_values(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Count fields and missing values (null or '') at every level; containers count as fields."""
    kind = T.StructType([df.schema[f] for f in fields])
    return _with_percentage(
        df.withColumns({"missing_count": _struct_missing(F.col, kind), "missing_total": _struct_total(F.col, kind)})
    )


def _with_percentage(df: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("missing_count").cast("double"), F.col("missing_total").cast("double")) * 100
    return df.withColumn("missing_percentage", F.coalesce(share, F.lit(0.0)))


_OBJECT, _LIST = "map<string, variant>", "array<variant>"


def _deeper(df: DataFrame) -> DataFrame:
    """One level of the walk: `_objects` are read, counted in, and replaced by the objects right below them.

    Objects lie below others as values or as items of a list that is a value.
    """
    as_object, as_list = f"try_variant_get(x, '$', '{_OBJECT}')", f"try_variant_get(x, '$', '{_LIST}')"
    values = "flatten(transform(_objects, o -> map_values(o)))"
    sorted_out = f"transform({values}, x -> named_struct('object', {as_object}, 'list', {as_list}, 'value', x))"
    empty = "is_variant_null(k.value) OR try_variant_get(k.value, '$', 'string') = ''"
    listed = f"flatten(transform(filter(_values, k -> k.list IS NOT NULL), k -> transform(k.list, x -> {as_object})))"
    return df.withColumn("_values", F.expr(sorted_out)).select(
        *[c for c in df.columns if c not in ("_objects", "missing_count", "missing_total")],
        F.expr(f"missing_count + size(filter(_values, k -> k.object IS NULL AND k.list IS NULL AND ({empty})))").alias("missing_count"),
        F.expr("missing_total + size(_values)").alias("missing_total"),
        F.expr(
            f"concat(transform(filter(_values, k -> k.object IS NOT NULL), k -> k.object), filter({listed}, o -> o IS NOT NULL))"
        ).alias("_objects"),
    )


def _walked(df: DataFrame, body: str, levels: int) -> DataFrame:
    top = F.try_variant_get(F.try_parse_json(F.col(body)), "$", _OBJECT)
    out = df.withColumns({"_objects": F.array_compact(F.array(top)), "missing_count": _zero(), "missing_total": _zero()})
    for _ in range(levels):
        out = _deeper(out)
    return out


def missing_in_json(df: DataFrame, body: str) -> DataFrame:
    """The same counts for JSON objects with varying keys: an absent key is no field.

    Text that is null, broken or no object has no fields, and so nothing missing. The walk goes level by level,
    within the row: how many levels the deepest text needs is found first.
    """
    levels = 4
    # A maximum and not a filter, which would be pushed down through every level and multiply its expressions.
    while _walked(df.select(body), body, levels).agg(F.max(F.size("_objects"))).first()[0]:
        levels *= 2
    return _with_percentage(_walked(df, body, levels).drop("_objects"))


def type_flags_json(df: DataFrame, body: str) -> DataFrame:
    """Add top-level type flags of JSON documents; absent blocks or metrics pass."""
    wanted = {"timestamp": ("STRING", False), "blocks": ("ARRAY", True), "metrics": ("OBJECT", True)}
    typed = with_field_types(df, body, *wanted)
    flags = {
        f"{name}_valid": F.coalesce(F.col(type_column(name)).startswith(prefix), F.lit(absent))
        for name, (prefix, absent) in wanted.items()
    }
    return typed.select(*df.columns, *[flag.alias(name) for name, flag in flags.items()])


def type_flags(df: DataFrame) -> dict[str, Column]:
    """The same on typed columns: the schema settles the type, a null is a wrong type."""
    wanted = {
        "timestamp": (T.StringType, T.TimestampType, T.TimestampNTZType),
        "blocks": (T.ArrayType,),
        "metrics": (T.StructType, T.MapType),
    }
    flags = {}
    for name, kinds in wanted.items():
        if name not in df.columns:
            flags[f"{name}_valid"] = F.lit(name != "timestamp")
        else:
            flags[f"{name}_valid"] = F.lit(isinstance(df.schema[name].dataType, kinds)) & F.col(name).isNotNull()
    return flags


def consistency_flags() -> dict[str, Column]:
    """Block numbers contiguous, transaction total as reported, block times non-decreasing."""
    counted = F.aggregate(F.transform("blocks", lambda b: F.size(b["transactions"])), F.lit(0), lambda acc, n: acc + n)
    reported = F.coalesce(F.col("transaction_metrics.total_transactions"), counted.cast("bigint"))
    return {
        "block_sequence_valid": is_contiguous(F.transform("blocks", lambda b: b["number"])),
        "transaction_counts_match": counted == reported,
        "timestamps_valid": is_sorted(F.transform("blocks", lambda b: b["timestamp"])),
    }


def _completeness(items: Column, fields: tuple[str, ...]) -> Column:
    def present(x: Column) -> Column:
        return _add([F.when(x[f].isNotNull(), 1).otherwise(0) for f in fields])

    found = F.aggregate(items, F.lit(0), lambda acc, x: acc + present(x)).cast("double")
    share = F.try_divide(found, (F.size(items) * len(fields)).cast("double")) * 100
    return F.coalesce(share, F.lit(100.0))


def block_completeness() -> Column:
    return _completeness(F.col("blocks"), BLOCK_FIELDS)


def transaction_completeness() -> Column:
    return _completeness(F.flatten(F.transform("blocks", lambda b: b["transactions"])), TX_FIELDS)


def record_count() -> Column:
    return F.when(F.col("blocks").isNull(), F.lit(1)).otherwise(F.size("blocks")).cast("bigint")


def measure(documents: DataFrame) -> DataFrame:
    """All metrics of each document as columns."""
    out = missing_values(documents)
    return out.withColumns({"total_records": record_count(), **type_flags(documents), **consistency_flags()})


TYPE_FLAGS = ("timestamp_valid", "blocks_valid", "metrics_valid")
CONSISTENCY_FLAGS = ("block_sequence_valid", "transaction_counts_match", "timestamps_valid")


def gate() -> Column:
    """Does a measured document pass? Anything that cannot be checked fails."""
    flags = [F.col(f) for f in (*TYPE_FLAGS, *CONSISTENCY_FLAGS)]
    test = F.col("missing_percentage") <= MAX_MISSING
    for flag in flags:
        test = test & flag
    return F.coalesce(test & F.forall("blocks", lambda b: b.isNotNull()), F.lit(False))


def _share(flags: tuple[str, ...]) -> Column:
    return _add([F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags]) / len(flags) * 100


def score() -> Column:
    return (
        (F.lit(100.0) - F.col("missing_percentage")) * WEIGHTS["missing"]
        + _share(TYPE_FLAGS) * WEIGHTS["types"]
        + _share(CONSISTENCY_FLAGS) * WEIGHTS["consistency"]
    )


def _too_many_missing() -> Column:
    return F.col("missing_percentage") > ISSUE_MISSING


def _kept(*texts: Column) -> Column:
    return F.array_compact(F.array(*texts))


def issues() -> Column:
    percent = F.concat(
        F.lit(HIGH_MISSING), F.col("missing_percentage").cast("string"), F.lit("%")
    )
    invalid = [F.when(~F.col(f), F.lit(INVALID_TYPE + f)) for f in TYPE_FLAGS]
    return _kept(F.when(_too_many_missing(), percent), *invalid)


def recommendations() -> Column:
    all_typed = F.col(TYPE_FLAGS[0])
    for f in TYPE_FLAGS[1:]:
        all_typed = all_typed & F.col(f)
    return _kept(
        F.when(_too_many_missing(), F.lit(ADVISE_SOURCE)),
        F.when(~all_typed, F.lit(ADVISE_TYPES)),
    )


def report() -> Column:
    return F.struct(
        F.struct(F.col("total_records"), score().alias("quality_score")).alias("summary"),
        issues().alias("issues"),
        recommendations().alias("recommendations"),
    )


def quality_rows(documents: DataFrame, stage: str, as_of: str, *keys: str) -> DataFrame:
    """Rows for the quality table: score and report come from the same document."""
    return measure(documents).select(
        *keys,
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        F.lit(stage).alias("stage"),
        score().alias("score"),
        report().alias("report"),
    )


def _two_digits(value: Column) -> Column:
    # Half-even, as in the text format the messages follow; Java's own rounding is half-up.
    return F.format_string("%.2f", F.bround(value, 2))


def alert_texts(quality_score: Column, missing_percentage: Column, consistency: Column | None = None) -> Column:
    """Alert messages of one metrics row; a missing score counts as 0. Consistency is opt-in."""
    value = F.coalesce(quality_score, F.lit(0.0))
    missing = F.coalesce(missing_percentage, F.lit(0.0))
    low = F.concat(F.lit(LOW_SCORE), _two_digits(value), F.lit(f"% (threshold: {MIN_SCORE}%)"))
    high = F.concat(
        F.lit(HIGH_MISSING), _two_digits(missing), F.lit(f"% (threshold: {MAX_MISSING}%)")
    )
    texts = [F.when(value < MIN_SCORE, low), F.when(missing > MAX_MISSING, high)]
    if consistency is not None:
        text = F.concat(F.lit(LOW_CONSISTENCY), _two_digits(consistency), F.lit(f"% (threshold: {MIN_CONSISTENCY}%)"))
        texts.append(F.when(consistency < MIN_CONSISTENCY, text))
    return _kept(*texts)


def alerts(measured: DataFrame, *keys: str) -> DataFrame:
    """One row per alert."""
    texts = alert_texts(score(), F.col("missing_percentage"))
    return measured.select(*keys, F.explode(texts).alias("alert"))


def checks_report(checks: DataFrame, stage: str, ts_text: str) -> DataFrame:
    """Number of checks, last check (largest `stage_time` text) and the stages seen."""
    return checks.agg(
        F.count("*").alias("total_checks"),
        F.max(F.concat_ws("_", stage, ts_text)).alias("last_check"),
        F.count_distinct(stage).alias("stages_checked"),
    )


def distinct_stages(checks: DataFrame, stage: str) -> DataFrame:
    return checks.select(stage).distinct()
