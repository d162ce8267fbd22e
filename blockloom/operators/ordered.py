"""Ordered computations over keys of any size.

A plain window sends all rows of one key to one task. Here rows are range-partitioned on
(keys, order) first, so a key that holds a third of the table is spread over many blocks. Each
block needs only a small carried value from the blocks before it. Carries exist only for keys that reach
over a block's end, at most two a block, and are joined by broadcast; the rows themselves stay where the range
partitioning put them, in a table bucketed by block. `order` must identify a row within its key: ties would
follow the sort.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.session import bucketed, written

BLOCK, LABEL = "_block", "_label"  # place of a block in the order, and the number its bucket goes by

BYTES_PER_BLOCK = 128 << 20  # of stored input
_UNKNOWN_SIZE = 1 << 60  # larger estimates are Spark's stand-in for "not known"


class Running(NamedTuple):
    """One running value: `kind` is sum, min, max or last (last non-null)."""

    name: str
    kind: str
    source: Column
    inclusive: bool = True
    backward: bool = False


def to_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Range-partition on keys + order and fix each row's block in a table bucketed by block.

    The table keeps the blocks the same for all that read them, a lost executor is replaced without sampling
    the ranges again, and windows within a block need no shuffle.
    """
    if blocks is None and stored_size(df) is None:
        df = written(df, "sized")
    parts = blocks or block_count(df)
    at = F.spark_partition_id()
    label = F.coalesce(F.try_element_at(F.lit(_labels(df.sparkSession, parts)), at + 1), at + _UNLABELLED)
    ranged = df.repartitionByRange(parts, *keys, *order).withColumns({BLOCK: at, LABEL: label})
    return bucketed(ranged, "blocks", parts, LABEL, [*keys, *order])


_UNLABELLED = 1 << 30
_known_labels: dict[int, list[int]] = {}


def _labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n blocks that Spark's hash puts into a bucket of its own."""
    if n not in _known_labels:
        tried = spark.range(n * 20).select(F.col("id").cast("int").alias("id"))
        found = tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("bucket")).agg(F.min("id").alias("id")).collect()
        hit = {row["bucket"]: row["id"] for row in found}
        _known_labels[n] = [hit.get(i, _UNLABELLED - 1 - i) for i in range(n)]
    return _known_labels[n]


def stored_size(df: DataFrame) -> int | None:
    """Bytes of what `df` reads, or None when a source cannot tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(size >= _UNKNOWN_SIZE for size in sizes) else sum(sizes)


def block_count(df: DataFrame) -> int:
    """Blocks by the stored size of what `df` reads, and no fewer than the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, stored_size(df) // BYTES_PER_BLOCK + 1)


def _fold(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "min":
        return F.min(value)
    if kind == "max":
        return F.max(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    raise ValueError(f"unknown running kind: {kind}")


def _block_value(run: Running, order: list[str]) -> Column:
    """The whole block's contribution as an aggregate."""
    value = F.col(f"_v_{run.name}")
    if run.kind != "last":
        return _fold(run.kind, value)
    pick = F.min if run.backward else F.max
    return pick(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))["_value"]


def _edges(per_block: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows per (keys, block) those of the first and the last key of each block: only these reach over its ends."""
    if not keys:
        return per_block
    block, key = Window.partitionBy(LABEL, BLOCK), F.struct(*keys)
    bounded = per_block.withColumns({"_first": F.min(key).over(block), "_last": F.max(key).over(block)})
    return bounded.filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))).drop("_first", "_last")


def _with_carry(rows: DataFrame, carries: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows with the values carried into their block for their key; at most two carries a block are broadcast."""
    known = carries.select(
        F.col(LABEL).alias("_its_label"), F.col(BLOCK).alias("_its_block"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *names
    )
    same = (F.col(LABEL) == F.col("_its_label")) & (F.col(BLOCK) == F.col("_its_block"))
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    joined = rows.join(F.broadcast(known), same, "left")
    return joined.drop("_its_label", "_its_block", *[f"_key_{i}" for i in range(len(keys))])


def _both(kind: str, carry: Column, own: Column) -> Column:
    """A carried value and one of the block itself, either of which may be missing."""
    if kind == "sum":
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
    if kind == "last":
        return F.coalesce(own, carry)
    return (F.least if kind == "min" else F.greatest)(carry, own)


def running(df: DataFrame, keys: list[str], order: list[str], runs: list[Running]) -> DataFrame:
    """Add running values per key in `order` to rows stamped by `to_blocks`."""
    columns = [c for c in df.columns if c not in (BLOCK, LABEL)]
    staged = df.select("*", *[r.source.alias(f"_v_{r.name}") for r in runs])
    per_block = staged.groupBy(LABEL, *keys, BLOCK).agg(*[_block_value(r, order).alias(f"_v_{r.name}") for r in runs])
    types = {f.name: f.dataType for f in per_block.schema}

    carried = []
    for r in runs:
        block_order = F.col(BLOCK).desc() if r.backward else F.col(BLOCK).asc()
        earlier = Window.partitionBy(*keys).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(_fold(r.kind, F.col(f"_v_{r.name}")).over(earlier).alias(f"_c_{r.name}"))
    carries = _edges(per_block, keys).select(LABEL, BLOCK, *keys, *carried)
    names = [f"_c_{r.name}" for r in runs]
    rows = _with_carry(staged, carries, keys, names)

    within = Window.partitionBy(LABEL, BLOCK, *keys)
    out = []
    for r in runs:
        window = within.orderBy(*[F.col(c).desc() if r.backward else F.col(c).asc() for c in order])
        own = _fold(r.kind, F.col(f"_v_{r.name}")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow if r.inclusive else -1))
        out.append(_both(r.kind, F.col(f"_c_{r.name}"), own).cast(types[f"_v_{r.name}"]).alias(r.name))
    return rows.select(*columns, BLOCK, LABEL, *out)


def streaks(df: DataFrame, keys: list[str], order: list[str], value: Column, reset: Column, name: str = "streak") -> DataFrame:
    """Add the sum of `value` since the last row with `reset`, that row included, to rows stamped by `to_blocks`.

    A block is the pair (was there a reset, sum since the last one); pairs combine from block to block.
    """
    columns = [c for c in df.columns if c not in (BLOCK, LABEL)]
    flagged = df.withColumns({"_reset": F.coalesce(reset, F.lit(False)).cast("int"), "_value": value})
    within = Window.partitionBy(LABEL, BLOCK, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy(LABEL, BLOCK, *keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = flagged.withColumn("_part", F.sum("_reset").over(within)).withColumn("_own", F.sum("_value").over(since))
    last = F.max(F.struct(*order, "_part", "_own"))
    per_block = summed.groupBy(LABEL, *keys, BLOCK).agg(last["_part"].alias("_part"), last["_own"].alias("_own"))

    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    parts = Window.partitionBy(*keys, "_section").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = (
        _edges(per_block, keys)
        .withColumn("_section", F.sum(F.when(F.col("_part") > 0, 1).otherwise(0)).over(blocks))
        .withColumn("_after", F.sum("_own").over(parts))
        .withColumn("_carry", F.lag("_after").over(blocks))
    )
    rows = _with_carry(summed, after, keys, ["_carry"])
    total = F.col("_own") + F.when(F.col("_part") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)
    return rows.select(*columns, BLOCK, LABEL, total.alias(name))


def scan(df: DataFrame, keys: list[str], order: list[str], runs: list[Running]) -> DataFrame:
    """`to_blocks` followed by one `running` pass, block numbers dropped."""
    return running(to_blocks(df, keys, order), keys, order, runs).drop(BLOCK, LABEL)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """1-based position of each row in its key, without a one-task sort."""
    return scan(df, keys, order, [Running(name, "sum", F.lit(1).cast("bigint"))])


def rolling_rows(
    df: DataFrame, keys: list[str], order: list[str], size: int, aggregates: list[tuple[str, Column]], chunk: int = 10_000
) -> DataFrame:
    """Aggregates over the last `size` rows of each key.

    Rows are numbered, cut into chunks of `chunk` rows or of `size` if that is more, and the last size-1 rows of a chunk are
    copied to the next one as context, so every window partition holds at most chunk+size-1 rows.
    """
    chunk = max(chunk, size)
    columns = df.columns
    at = F.col("_row_no") - 1
    numbered = number_rows(df, keys, order, "_row_no").withColumn("_home", F.floor(at / chunk))
    spill = (at % chunk) >= chunk - (size - 1)
    copied = numbered.withColumn(
        "_chunk", F.explode(F.when(spill, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_row_no").rowsBetween(-(size - 1), 0)
    return (
        copied.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates])
        .filter(F.col("_chunk") == F.col("_home"))
        .select(*columns, *[name for name, _ in aggregates])
    )


def trailing_range(df: DataFrame, keys: list[str], ts: str, value: Column, micros: int) -> DataFrame:
    """Sum, count, min and max of `value` over [ts - micros, ts] for each distinct (keys, ts).

    Time is cut into buckets as wide as the window, so a window is a suffix of one bucket and a
    prefix of the next: one forward and one backward running pass give both parts with no
    re-scan of the frame. Rows with equal time are merged before anything is sorted.
    """
    points = (
        df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("_value", value)
        .groupBy(*keys, "_at")
        .agg(
            F.sum("_value").alias("_sum"),
            F.count("_value").alias("_n"),
            F.min("_value").alias("_min"),
            F.max("_value").alias("_max"),
        )
    )
    bucket = F.floor(F.col("_at") / F.lit(micros)).cast("bigint")
    parts = ["_sum", "_n", "_min", "_max"]
    marked = points.select(*keys, F.col("_at"), F.lit(0).alias("_probe"), F.col("_at").alias("_owner"), *parts)
    # -1 sorts a probe before the point of equal time, so the backward pass sees that point first.
    probes = points.select(
        *keys, (F.col("_at") - micros).alias("_at"), F.lit(-1).alias("_probe"), F.col("_at").alias("_owner")
    )
    both = marked.unionByName(probes, allowMissingColumns=True).withColumn("_bucket", bucket)
    kinds = {"_sum": "sum", "_n": "sum", "_min": "min", "_max": "max"}
    scope = [*keys, "_bucket"]
    order = ["_at", "_probe"]
    runs = [Running(f"_f{c}", kinds[c], F.col(c)) for c in parts]
    runs += [Running(f"_b{c}", kinds[c], F.col(c), backward=True) for c in parts]
    ran = running(to_blocks(both, scope, order), scope, order, runs)
    part = {c: F.when(F.col("_probe") == 0, F.col(f"_f{c}")).otherwise(F.col(f"_b{c}")) for c in parts}
    return (
        ran.groupBy(*keys, F.col("_owner"))
        .agg(
            F.sum(part["_sum"]).alias("sum"),
            F.sum(part["_n"]).alias("n"),
            F.min(part["_min"]).alias("min"),
            F.max(part["_max"]).alias("max"),
        )
        .select(*keys, F.timestamp_micros("_owner").alias(ts), "sum", "n", "min", "max")
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    moments: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key; `moments` adds n, mean, min and max.

    `weight` is how many rows a row stands for (default one).

    Equal values are counted first; ranks come from running sums over (key, value), so no task
    ever holds the values of one key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("_c")
    )
    ranked = scan(
        counts,
        keys,
        [value],
        [Running("_upto", "sum", F.col("_c")), Running("_from", "sum", F.col("_c"), backward=True)],
    )
    total = F.col("_upto") + F.col("_from") - F.col("_c")
    start = F.col("_upto") - F.col("_c")
    picks, results = [], []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (total - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((start <= low) & (low < F.col("_upto")), F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when((start <= high) & (high < F.col("_upto")), F.col(value))).cast("double").alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
        results.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name)
        )
    if moments:
        picks += [
            F.sum("_c").alias("n"),
            F.sum(F.col(value) * F.col("_c")).cast("double").alias("_total"),
            F.min(value).cast("double").alias("min"),
            F.max(value).cast("double").alias("max"),
        ]
        results = ["n", F.try_divide(F.col("_total"), F.col("n")).alias("mean"), "min", "max", *results]
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *results)


def as_of(points: DataFrame, probes: DataFrame, keys: list[str], ts: str, value: str, default: int = 0) -> DataFrame:
    """Backward as-of lookup: the `value` of the last point with point.ts <= probe.ts.

    Points of equal time keep the largest value. One row per distinct probe (keys, ts).
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    left = (
        points.withColumn("_at", at).groupBy(*keys, "_at").agg(F.max(value).alias(value)).withColumn("_probe", F.lit(0))
    )
    right = probes.withColumn("_at", at).select(*keys, "_at").distinct().withColumn("_probe", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    ran = scan(both, keys, ["_at", "_probe"], [Running("_last", "last", F.col(value))])
    return ran.filter(F.col("_probe") == 1).select(
        *keys, F.timestamp_micros("_at").alias(ts), F.coalesce("_last", F.lit(default)).alias(value)
    )
