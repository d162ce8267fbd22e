"""File readers chosen by suffix, directory scans and file inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from blockloom.functions.scalars import file_name, parent_dir
from blockloom.schemas import ZONES

SIDECAR = ".metadata"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large data: inferring one reads the files twice.

    Columns go by name: those of the schema that the header lacks are null, others are not read. All
    files must have the same header; one that differs is an error when its rows are read.
    """
    return _csv(spark.read, path, schema)


def _csv(reader: DataFrameReader, path: str | list[str], schema: str | None) -> DataFrame:
    reader = reader.option("header", True).option("enforceSchema", False)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    wanted = StructType.fromDDL(schema)
    header = reader.csv(path).columns
    by_name = {field.name: field for field in wanted}
    found = StructType([by_name.get(name, StructField(name, StringType())) for name in header])
    rows = reader.schema(found).csv(path)
    return rows.select(*[F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that each hold one object or one array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_csv,
    ".json": read_json,
    ".jsonl": read_jsonl,
    ".parquet": read_parquet,
}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reader by the path's suffix in any case."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in READERS:
        raise ValueError(f"unsupported file format: {suffix or path}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return READERS[suffix](spark, path, schema)


def read_source(spark: SparkSession, kind: str, location, schema: str | None = None) -> DataFrame:
    """Local path (file or tree) or a function that returns the rows."""
    if kind == "custom":
        return location(spark)
    if kind != "local":
        raise ValueError(f"unsupported source kind: {kind}")
    name = location.rstrip("/").rsplit("/", 1)[-1]
    return read_file(spark, location, schema) if "." in name else read_tree(spark, location, schema)


def read_tree(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """All .json, .jsonl and .csv files below `path` as one table.

    Without a schema the columns are those of the first file by name: extra columns of other
    files are dropped, and missing ones are null. CSV files go by their own headers, so these may differ in names and
    order. When strict, a record that lacks one of the columns is an error, as is one that is no JSON object.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    suffixes = (".json", ".jsonl", ".csv")
    listing = inventory(spark, path).filter(F.lower("path").rlike(r"\.(json|jsonl|csv)$"))
    found = {
        row["suffix"]: row["first"]
        for row in listing.groupBy(F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).alias("suffix"))
        .agg(F.min("path").alias("first"))
        .collect()  # at most one row per suffix
    }
    if not found:
        raise ValueError(f"no data files below {path}")

    first = min(found, key=found.get)
    columns = READERS[first](spark, found[first], schema).columns
    parts = []
    for suffix in suffixes:
        if suffix in found:
            any_case = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
            files = {"recursiveFileLookup": True, "pathGlobFilter": f"*{any_case}"}
            if suffix == ".csv":
                for header, group in _by_header(spark, path, files):
                    lacking = [c for c in columns if c not in header]
                    if strict and lacking:
                        raise ValueError(f"records lack columns {lacking}")
                    parts.append(_csv(spark.read, group, schema))
            else:
                if strict:
                    _check_records(spark, path, files, columns, whole=suffix == ".json")
                reader = spark.read.options(**files).option("multiLine", suffix == ".json")
                parts.append((reader.schema(schema) if schema else reader).json(path))

    merged = None
    for frame in parts:
        kept = frame.select(*[c for c in columns if c in frame.columns])
        merged = kept if merged is None else merged.unionByName(kept, allowMissingColumns=True)
    return merged.select(*columns)


def _by_header(spark: SparkSession, path: str, files: dict) -> list[tuple[list[str], list[str]]]:
    """Header and files of each group of CSV files with the same first line; the driver holds names, as for any listing."""
    lines = spark.read.options(**files).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    numbered = lines.withColumn("place", F.monotonically_increasing_id()).filter("file_block_start = 0")
    first = numbered.groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("paths")).orderBy("paths")
    return [(spark.read.option("header", True).csv(row["paths"][0]).columns, row["paths"]) for row in grouped.collect()]


def _check_records(spark: SparkSession, path: str, files: dict, columns: list[str], whole: bool) -> None:
    """An error unless every JSON record is an object with all `columns`; `whole` files hold one object or array each."""
    text = spark.read.options(**files).text(path, wholetext=whole).filter(F.trim("value") != "")
    parsed = text.select(F.try_parse_json("value").alias("v"))
    if whole:
        items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        parsed = parsed.select(F.explode(items).alias("v"))
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string, variant>"))
    whole_record = F.size(F.array_except(F.array(*map(F.lit, columns)), keys)) == 0
    if not parsed.filter(~F.coalesce(whole_record, F.lit(False))).isEmpty():
        raise ValueError(f"records lack some of the columns {columns}")


def inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below `path`: path, name, dir, size and modification time. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        file_name(F.col("path")).alias("name"),
        parent_dir(F.col("path")).alias("dir"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Join files to their sidecar records; sidecar values win over the file's own."""
    data = files.filter(~F.col("path").endswith(SIDECAR))
    notes = sidecars.select(
        "path",
        F.col("created_at").alias("_created"),
        F.col("last_accessed").alias("_accessed"),
        F.col("storage_class").alias("_class"),
    )
    return data.join(notes, "path", "left").select(
        "path",
        "name",
        "size",
        F.coalesce("_created", "modified_at").alias("created_at"),
        F.coalesce("_accessed", "modified_at").alias("last_accessed"),
        F.coalesce("_class", F.lit("local")).alias("storage_class"),
    )


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar records `<file>.metadata` below `path`, keyed by the path of their file."""
    schema = "created_at timestamp, last_accessed timestamp, storage_class string"
    records = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{SIDECAR}")
        .option("multiLine", True)
        .json(path)
    )
    own = F.regexp_replace(F.col("_metadata.file_path"), r"\.metadata$", "")
    return records.select(own.alias("path"), "created_at", "last_accessed", "storage_class")


def in_zone(files: DataFrame, category: str, subcategory: str | None = None) -> DataFrame:
    """Files of a zone, by path; names outside the closed list are refused."""
    check_zone(category, subcategory)
    prefix = f"{category}/{subcategory}/" if subcategory else f"{category}/"
    return files.filter(F.col("path").startswith(prefix) | F.col("path").contains(f"/{prefix}"))


def check_zone(category: str, subcategory: str | None = None) -> None:
    if category not in ZONES:
        raise ValueError(f"invalid category: {category}")
    if subcategory is not None and subcategory not in ZONES[category]:
        raise ValueError(f"invalid subcategory: {subcategory}")


def valid_zone(category: Column, subcategory: Column) -> Column:
    """Row form of `check_zone`."""
    test = F.lit(False)
    for name, members in ZONES.items():
        test = test | ((category == name) & subcategory.isin(*members))
    return F.coalesce(test, F.lit(False))


#: Spark's line reader unpacks files with these endings and so reads each in one task.
_PACKED = r"\.(gz|bz2|deflate|zst|lz4|snappy)$"


_SOURCE = "_metadata.file_path"


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """(source, start, id, value): the bytes between line feeds of all files but packed ones, numbered in each block."""
    text = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n").filter(~F.col(_SOURCE).rlike(_PACKED))
    start = F.col("_metadata.file_block_start").alias("start")
    return text.select(F.col(_SOURCE).alias("source"), start, F.monotonically_increasing_id().alias("id"), "value")


def _file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, size, lanes) of every file below `path`, by its content; no file is held whole.

    A file is read as the runs of bytes between line feeds, of which Spark deals any number of blocks to tasks. Each run
    is hashed with its place in the file, and the hashes are added up as numbers; with the size, the runs tell the
    content. A run's place is its number in its block after all runs of the blocks before.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listing = whole.select(F.col(_SOURCE).alias("source"), "path", F.col("length").alias("size"))
    packed = whole.filter(F.col(_SOURCE).rlike(_PACKED)).select(F.col(_SOURCE).alias("source"), F.sha2("content", 256).alias("h"))
    # A scan numbers its rows alike whatever columns it reads: by task and place, and a block lies in one task.
    runs = _runs(spark, path)
    blocks = runs.groupBy("source", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("start")) - F.col("n")
    blocks = blocks.select(F.col("source").alias("of"), F.col("start").alias("block"), (before - F.col("first")).alias("shift"))
    placed = runs.join(F.broadcast(blocks), (F.col("source") == F.col("of")) & (F.col("start") == F.col("block")))
    numbered = F.concat(F.col("value").cast("binary"), F.concat(F.lit("\n"), F.col("id") + F.col("shift")).cast("binary"))
    hashes = placed.select("source", F.sha2(numbered, 256).alias("h"))
    added = hashes.unionByName(packed).groupBy("source").agg(F.count("*").alias("runs"), *_lanes("h"))
    found = listing.join(added, "source", "left")
    return found.select(parent_dir(F.col("path")).alias("dir"), file_name(F.col("path")).alias("name"), "size", "runs", *_LANES)


_LANES = [f"lane_{i}" for i in range(5)]


def _lanes(hashes: str) -> list[Column]:
    """The sums of five parts of hashes in hex, as text."""
    part = lambda i: F.conv(F.substring(hashes, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(i)).cast("string").alias(name) for i, name in enumerate(_LANES)]


def directory_hash(spark: SparkSession, path: str) -> DataFrame:
    """One content hash per directory.

    Files are hashed block by block where they are read, and what is hashed is added up as numbers: files and directories
    of any size combine map-side, and the result depends neither on listing order nor on how files are dealt to
    tasks. Compressed files (.gz and the like) are the exception: each is hashed as a whole by one task.
    """
    content = F.concat_ws("|", "size", F.coalesce("runs", F.lit(0)), *_LANES)
    entries = _file_hashes(spark, path).select("dir", F.sha2(F.concat_ws("|", content, "name").cast("binary"), 256).alias("h"))
    added = entries.groupBy("dir").agg(F.count("*").alias("files"), *_lanes("h"))
    return added.select("dir", "files", F.sha2(F.concat_ws("|", "files", *_LANES).cast("binary"), 256).alias("hash"))


def table_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files per table, the table being a file's name up to its first dot."""
    table = F.regexp_extract("name", r"^([^.]*)", 1)
    return files.groupBy(table.alias("table")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
