"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import blockloom

# Functions that run in Python workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(blockloom)

# Runtime SQL settings every operator relies on. Partition counts and memory stay with the cluster.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "blockloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in `spark.checkpoint.dir`. A throw-away folder is used only in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="blockloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scratch: list[tuple[SparkSession, str, str | None]] = []  # (session, path, table name) of what was written


def _as_scratch(spark: SparkSession, name: str, table: bool = False) -> tuple[str, str | None]:
    """A fresh scratch folder that `release` removes, with a table name if one is wanted."""
    path = work_dir(spark, name)
    if not _scratch:
        atexit.register(release)
    known_as = f"scratch_{uuid.uuid4().hex}" if table else None
    _scratch.append((spark, path, known_as))
    return path, known_as


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, lineage cut, columns still prunable.

    The table is scratch of this application; `release` or the end of the program removes it.
    """
    path, _ = _as_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: str, order: list[str]) -> DataFrame:
    """`df` as a scratch table in the shared folder whose files are bucketed `by` a column and sorted.

    What groups or windows by that column reads it without a shuffle.
    """
    path, table = _as_scratch(df.sparkSession, name, table=True)
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def release() -> None:
    """Remove the scratch tables made so far. Frames that read them can no longer run."""
    remove(list(_scratch))


def scratch_tables() -> list[tuple[SparkSession, str, str | None]]:
    """The scratch tables there are, oldest first; `remove` takes any of them."""
    return list(_scratch)


def remove(tables: list[tuple[SparkSession, str, str | None]], unless_read_by: DataFrame | None = None) -> None:
    """Remove some scratch tables, but not those that a frame reads."""
    read = _paths_of(unless_read_by) if unless_read_by is not None else []
    for entry in reversed(tables):
        spark, path, table = entry
        if entry not in _scratch or any(path in used for used in read):
            continue
        _scratch.remove(entry)
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone; what is left lies in the shared folder
            return


def _paths_of(df: DataFrame) -> list[str]:
    """Folders and files that a frame scans."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    relations = [leaves.apply(i) for i in range(leaves.size())]
    found = []
    for leaf in relations:
        if leaf.getClass().getSimpleName() == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(i).toString() for i in range(roots.size())]
    return found
