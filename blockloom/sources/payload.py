"""Landed API responses to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unwrap(payloads: DataFrame, body: str = "body", strict: bool = True) -> DataFrame:
    """One row per item of each response text, as a variant column `item`.

    A list gives its items, an object with `data` the items of `data`, any other object itself.
    Other responses raise, or give no row when not strict.
    """
    document = F.try_parse_json(body)
    kind = F.schema_of_variant("_document")
    listed = F.try_variant_get("_document", "$", "array<variant>")
    data = F.try_variant_get("_document", "$.data", "variant")
    data_items = F.coalesce(F.try_variant_get("_document", "$.data", "array<variant>"), F.array(data))
    one = F.array(F.col("_document"))
    refused = F.raise_error(F.concat(F.lit("unexpected response: "), F.col(body))).cast("array<variant>")
    items = (
        F.when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT") & data.isNotNull(), data_items)
        .when(kind.startswith("OBJECT"), one)
    )
    if strict:
        items = items.otherwise(refused)
    rest = [c for c in payloads.columns if c != body]
    return payloads.withColumn("_document", document).select(*rest, F.explode(items).alias("item"))
