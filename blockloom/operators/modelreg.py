"""Model registry tables: flatten, upsert and latest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_registry(nested: DataFrame, column: str = "registry") -> DataFrame:
    """name -> versions -> info maps to rows."""
    names = nested.select(F.explode(column).alias("name", "versions"))
    return names.select("name", F.explode("versions").alias("version", "info")).select("name", "version", "info.*")


def register(existing: DataFrame, incoming: DataFrame, content: Column, as_of: str) -> DataFrame:
    """Registry after an upsert on (name, version): incoming rows replace existing ones.

    Both sides hold name, version, path; existing also hash, registered_at and status. One row per
    key survives a map-side combined aggregate, so no key is gathered in one place.
    """
    new = incoming.select(
        "name",
        "version",
        "path",
        F.sha2(content, 256).alias("hash"),
        F.lit(as_of).cast("timestamp").alias("registered_at"),
        F.lit("registered").alias("status"),
        F.lit(1).alias("_rank"),
    )
    info = ("path", "hash", "registered_at", "status")
    both = existing.select("name", "version", *info, F.lit(0).alias("_rank")).unionByName(new)
    return (
        both.groupBy("name", "version")
        .agg(F.max(F.struct("_rank", *info)).alias("kept"))
        .select("name", "version", *[F.col(f"kept.{c}").alias(c) for c in info])
    )


def latest_version(models: DataFrame, semantic: bool = False) -> DataFrame:
    """Newest version per name: by text ('9.0' above '10.0'), or by its numbers when `semantic`."""
    rank = F.transform(F.split("version", r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(-1))) if semantic else F.col("version")
    columns = [c for c in models.columns if c != "name"]
    return (
        models.groupBy("name")
        .agg(F.max(F.struct(rank.alias("_rank"), *columns)).alias("top"))
        .select("name", *[F.col(f"top.{c}").alias(c) for c in columns])
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key as an aggregate (combines map-side, unlike a row number)."""
    columns = [c for c in df.columns if c not in keys]
    ranked = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_top")
    return df.groupBy(*keys).agg(ranked).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in columns])
