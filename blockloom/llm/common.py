"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters (Java's \s is just these).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_columns(df: DataFrame, schema_of: DataFrame) -> DataFrame:
    """`df` reduced to the columns of `schema_of`, in that order."""
    return df.select(*[F.col(f"`{c}`") for c in schema_of.columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that few Python copies of texts live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, underscored until no column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    """The top-level column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
