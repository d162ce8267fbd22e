"""Key and type predicates over JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_keys(text: Column, *keys: str) -> Column:
    """True when the text is a JSON object holding all `keys` (false for other or broken text)."""
    present = F.json_object_keys(text)
    test = F.lit(True)
    for key in keys:
        test = test & F.array_contains(present, key)
    return F.coalesce(test, F.lit(False))


def type_column(key: str) -> str:
    return f"_type_{key}"


def with_field_types(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """Add the Spark type name of top-level JSON fields as `_type_<key>` columns.

    Null stands for an absent key, VOID for a JSON null. The text is parsed once per row, in a
    projection of its own, whatever the number of keys.
    """
    parsed = df.withColumn("_document", F.try_parse_json(F.col(body)))
    types = {
        type_column(k): F.schema_of_variant(F.try_variant_get("_document", f"$.{k}", "variant")) for k in keys
    }
    return parsed.withColumns(types)


# What each declared field type accepts, as prefixes of the type names above. A boolean is an
# integer here and a number without a fraction is no float: fixed values of the record rules.
ACCEPTED = {
    "str": ("STRING",),
    "int": ("BIGINT", "BOOLEAN"),
    "float": ("DECIMAL", "DOUBLE", "FLOAT"),
    "dict": ("OBJECT",),
    "list": ("ARRAY",),
    "bool": ("BOOLEAN",),
}


def is_type(key: str, kind: str) -> Column:
    """Does the `_type_<key>` column name an accepted type?"""
    name = F.col(type_column(key))
    test = F.lit(False)
    for prefix in ACCEPTED[kind]:
        test = test | name.startswith(prefix)
    return F.coalesce(test, F.lit(False))
