"""File scans by format, inventories and directory hashes.

The scans read files Spark wrote from a whole table just before, in the shared working folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.plans.registry import query
from blockloom.session import work_dir
from blockloom.sources import files

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
COLUMNS = "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string"


def _customer(t):
    return t.customer.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("scan_csv", CUSTOMER)
def _(t):
    path = work_dir(t.spark, "scan") + ".csv"
    _customer(t).write.option("header", True).csv(path)
    return files.read_file(t.spark, path, COLUMNS)


@query("scan_jsonl", CUSTOMER)
def _(t):
    path = work_dir(t.spark, "scan") + ".jsonl"
    _customer(t).write.json(path)
    return files.read_file(t.spark, path, COLUMNS)


@query(
    "scan_json",
    """SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation
       UNION ALL SELECT n_regionkey, 'region of ' || n_name FROM nation""",
)
def _(t):
    """Files that hold one array of objects each: here one file per nation."""
    path = work_dir(t.spark, "scan") + ".json"
    items = F.array(
        F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
        F.struct(F.col("n_regionkey").alias("key"), F.concat(F.lit("region of "), "n_name").alias("name")),
    )
    t.nation.select(F.col("n_nationkey").alias("file"), F.to_json(items).alias("value")).write.partitionBy("file").text(path)
    return files.read_file(t.spark, path, "key bigint, name string").select("key", "name")


@query("scan_parquet", CUSTOMER)
def _(t):
    return _customer(t)


@query(
    "scan_dir",
    "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT n_nationkey, n_name FROM nation",
)
def _(t):
    """CSV files and, deeper in the tree, JSON files of one object with an extra column each."""
    root = work_dir(t.spark, "tree")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.option("header", True).csv(f"{root}/a")
    nation = t.nation.select("n_nationkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit(1).alias("extra"))
    nation.write.partitionBy("n_nationkey").json(f"{root}/b/c")
    return files.read_tree(t.spark, root, "key bigint, name string")


@query("file_inventory")
def _(t):
    listing = files.inventory(t.spark, t.sf_dir)
    stored = listing.select("path", F.col("modified_at").alias("created_at"), F.col("modified_at").alias("last_accessed"))
    sidecars = stored.filter(F.col("path").contains("events")).withColumn("storage_class", F.lit("archive"))
    return files.with_sidecars(listing, sidecars)


@query("dir_hash")
def _(t):
    return files.directory_hash(t.spark, t.sf_dir)


@query("table_sizes")
def _(t):
    return files.table_sizes(files.inventory(t.spark, t.sf_dir))
