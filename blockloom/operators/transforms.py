"""Named and ordered transforms over DataFrames, batch runs and validated loads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockloom.sources import committed

Transform = Callable[[DataFrame], DataFrame]


class Transforms:
    """A registry of DataFrame transforms, applied in the order they are listed."""

    def __init__(self):
        self._known: dict[str, Transform] = {}

    def register(self, name: str, fn: Transform) -> None:
        self._known[name] = fn

    def register_record_function(self, name: str, fn: Callable[[dict], dict], schema: str) -> None:
        """An opaque dict -> dict function, run over Arrow batches; `schema` is its output."""
        self.register(name, lambda df: df.mapInArrow(_record_batches(fn, schema), schema))

    def apply(self, df: DataFrame, names: Iterable[str]) -> DataFrame:
        for name in names:
            if name not in self._known:
                raise ValueError(f"unknown transformation: {name}")
            df = df.transform(self._known[name])
        return df


def _record_batches(fn, schema: str):
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(record) for record in batch.to_pylist()], schema=kind)

    return run


class ProcessingSteps:
    """Ordered steps; a step may require the caller to be authorised."""

    def __init__(self):
        self._steps: list[tuple[Transform, bool]] = []

    def add(self, fn: Transform, requires_auth: bool = False) -> ProcessingSteps:
        self._steps.append((fn, requires_auth))
        return self

    def run(self, df: DataFrame, authorized: bool) -> DataFrame:
        """The permission is settled before any step is planned."""
        if not authorized and any(needed for _, needed in self._steps):
            raise PermissionError("a step requires authorisation")
        for fn, _ in self._steps:
            df = df.transform(fn)
        return df


def extract(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of a query with bound named parameters; `tables` become views for it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params or {})


def extract_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """A partitioned read of an external database table."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=column,
            lowerBound=low,
            upperBound=high,
            numPartitions=partitions,
            **options,
        )
        .load()
    )


def normalize_timestamps(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """ISO text to timestamps (null when unreadable), and the processing time."""
    return df.withColumn(column, F.try_to_timestamp(column)).withColumn(
        "processed_at", F.lit(as_of).cast("timestamp")
    )


def stamp_run(df: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Add the run window and the processing time."""
    return df.withColumns(
        {
            "start_time": F.lit(start).cast("timestamp"),
            "end_time": F.lit(end).cast("timestamp"),
            "processing_time": F.lit(as_of).cast("timestamp"),
        }
    )


def load_validated(df: DataFrame, valid: Column, path: str, run: str, allow_empty: bool = True) -> bool:
    """Commit all rows as run `run` of the table at `path`, or none when one of them is invalid.

    The rows are computed and written once: they are counted on their way into a folder that readers do not see
    before it is published. A repeated run replaces its own rows. Read the table with `committed.read`.
    """
    spark, seen = df.sparkSession, Observation()
    counted = df.observe(seen, F.count("*").alias("rows"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
    folder = committed.stage(counted, path, run)
    found = seen.get
    if found["invalid"] or not (found["rows"] or allow_empty):
        committed.discard(spark, path, folder)
        return False
    committed.publish(spark, path, run, folder, df.schema)
    return True


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Row-level alternative to the all-or-nothing load: (kept, quarantined)."""
    test = F.coalesce(valid, F.lit(False))
    return df.filter(test), df.filter(~test)


def run_batch(source: DataFrame, transforms: Transforms, names: Iterable[str], valid: Column, path: str, run: str) -> bool:
    """Extract, transform and load as one plan and one write; false, and nothing committed, when it has no rows."""
    return load_validated(transforms.apply(source, names), valid, path, run, allow_empty=False)


def batch_outcomes(batches: DataFrame, batch: str, ok: Column) -> DataFrame:
    """Rows and success per batch."""
    return batches.groupBy(batch).agg(F.count("*").alias("n_rows"), F.bool_and(ok).alias("succeeded"))


def load_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a batched load."""
    return outcomes.agg(
        F.count("*").alias("batches"),
        F.count_if(~F.col("succeeded")).alias("failed_batches"),
        F.coalesce(F.sum(F.when(F.col("succeeded"), F.col("n_rows"))), F.lit(0)).alias("loaded_rows"),
        F.bool_and("succeeded").alias("success"),
    )
