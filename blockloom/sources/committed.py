"""Tables that grow by runs, of which readers see whole ones only.

A run writes its rows to a folder of its own and then publishes one small file that names the folder. Readers
list those files, so rows of a run that failed, or still writes, are in no snapshot. A repeated run
publishes a newer entry under the same name, which replaces the older one. Appending the entry is the only commit:
Spark's writer moves the finished file into place, and nothing is overwritten.

Entries are one small file per run and are read by the driver. `compact` merges the rows of many runs into one
folder, so that readers open few; the entries stay, as the record of what was done. One writer per table and run name is assumed; runs of other names may write at the same time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDER = "_run_folder"  # run folders look like partitions, so that those with partitions of their own read together
ENTRY = "version long, run string, folder string, row_schema string, covers array<string>"


class Entry(NamedTuple):
    version: int
    run: str
    folder: str
    row_schema: str
    covers: list[str] | None


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """Every published entry, oldest first; none where there is no table yet."""
    try:
        found = spark.read.schema(ENTRY).json(f"{path}/manifest").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(Entry(*row) for row in found)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> list[Entry]:
    """The entries whose rows count: the newest of each run that no merged run covers."""
    newest: dict[str, Entry] = {}
    for entry in entries(spark, path):
        if version is None or entry.version <= version:
            newest[entry.run] = entry
    covered = {folder for entry in newest.values() for folder in entry.covers or ()}
    return [entry for entry in sorted(newest.values()) if entry.folder not in covered]


def stage(df: DataFrame, path: str, run: str, partition_by: Iterable[str] = ()) -> str:
    """Write rows where no reader looks yet; the folder's name, for `publish` or `discard`."""
    folder = f"data/{FOLDER}={re.sub(r'[^A-Za-z0-9.-]', '_', run)}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    return folder


def publish(spark: SparkSession, path: str, run: str, folder: str, schema: StructType, covers: Iterable[str] = ()) -> int:
    """Make a staged folder the rows of its run; the new version. A run that was merged into another can't be replaced."""
    known = entries(spark, path)
    if {entry.folder for entry in known if entry.run == run} & {f for entry in known for f in entry.covers or ()}:
        raise ValueError(f"run {run} was merged and can't be repeated")
    version = max((entry.version for entry in known), default=0) + 1
    row = spark.range(0, 1, 1, 1).select(
        F.lit(version).cast("long").alias("version"),
        F.lit(run).alias("run"),
        F.lit(folder).alias("folder"),
        F.lit(schema.json()).alias("row_schema"),
        F.array(*map(F.lit, covers)).cast("array<string>").alias("covers"),
    )
    row.write.mode("append").json(f"{path}/manifest")
    return version


def discard(spark: SparkSession, path: str, folder: str) -> None:
    """Remove a staged folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def commit(df: DataFrame, path: str, run: str, partition_by: Iterable[str] = (), once: bool = False) -> bool:
    """Write and publish a run. With `once`, a run that is already there is left as it is, and false comes back."""
    spark = df.sparkSession
    if once and any(entry.run == run for entry in entries(spark, path)):
        return False
    publish(spark, path, run, stage(df, path, run, partition_by), df.schema)
    return True


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a snapshot, with the columns of its newest run; None-valued where older runs lack one."""
    return _rows(spark, path, snapshot(spark, path, version))


def _rows(spark: SparkSession, path: str, live: list[Entry]) -> DataFrame:
    if not live:
        raise ValueError(f"no committed run below {path}")
    schema = StructType.fromJson(json.loads(live[-1].row_schema))
    folders = [f"{path}/{entry.folder}" for entry in live]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop(FOLDER)


def compact(spark: SparkSession, path: str, partition_by: Iterable[str] = (), merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Merge the runs of the present snapshot into one folder, `merge` applied to their rows; how many there were.

    Runs that commit meanwhile are not covered and stay.
    """
    live = snapshot(spark, path)
    if len(live) < 2:
        return len(live)
    rows = _rows(spark, path, live)
    merged = merge(rows) if merge else rows
    run = f"merged-{live[-1].version}"
    covers = [folder for entry in live for folder in (entry.folder, *(entry.covers or ()))]
    publish(spark, path, run, stage(merged, path, run, partition_by), merged.schema, covers)
    return len(live)
