"""Range scans over landed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.ordered import BLOCK, to_blocks


def block_range(blocks: DataFrame, start: int | str, end: int | str = "latest", with_transactions: bool = True) -> DataFrame:
    """Blocks with start <= number <= end; 'latest' is the highest number, also as a start."""
    latest = blocks.agg(F.max("block_number")).scalar() if "latest" in (start, end) else None
    high: Column = latest if end == "latest" else F.lit(end)
    low: Column = high if start == "latest" else F.lit(start)
    kept = blocks.filter(F.col("block_number").between(low, high))
    return kept if with_transactions else kept.drop("transactions")


def slot_range(blocks: DataFrame, slot: int, until: int | None = None) -> DataFrame:
    """Slots in [slot, until]; skipped slots are simply absent. `until` defaults to `slot`."""
    return blocks.filter(F.col("slot").between(slot, slot if until is None else until))


def time_range(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """From the last block at or before `start` to the last at or before `end`, both included."""

    def number_at(moment: str) -> Column:
        at = F.lit(moment).cast("timestamp")
        found = blocks.filter(F.col("timestamp") <= at).agg(
            F.coalesce(F.max(F.struct("timestamp", "block_number"))["block_number"], F.lit(0).cast("bigint"))
        )
        return found.scalar()

    return blocks.filter(F.col("block_number").between(number_at(start), number_at(end)))


def fetch_summary(blocks: DataFrame) -> DataFrame:
    return blocks.agg(
        F.count("*").alias("block_count"),
        F.min("block_number").alias("start_block"),
        F.max("block_number").alias("end_block"),
    )


class PageIndex:
    """Pages of a table in key order, of which each reads only the blocks it touches.

    The rows are range-partitioned by key and written in blocks once, and the driver keeps a count and the files of each
    block. Any page then comes from one or two blocks, however deep it lies. `keys` must identify a row.
    """

    def __init__(self, df: DataFrame, keys: list[str], blocks: int | None = None):
        self._keys, self._columns = keys, df.columns
        self._table = to_blocks(df, [], keys, blocks)
        placed = self._table.select(BLOCK, F.input_file_name().alias("file"))
        counted = placed.groupBy(BLOCK).agg(F.count("*").alias("n"), F.collect_set("file").alias("files")).collect()
        self._blocks = [(row["n"], row["files"]) for row in sorted(counted, key=lambda row: row[BLOCK])]

    def __len__(self) -> int:
        return sum(n for n, _ in self._blocks)

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows [offset, offset + limit) in key order; none beyond the end."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        files, skip, start = [], 0, 0
        for n, its_files in self._blocks:
            if start < offset + limit and start + n > offset:
                skip = skip if files else offset - start
                files += its_files
            start += n
        if not files:
            return self._table.limit(0).select(*self._columns)
        rows = self._table.sparkSession.read.schema(self._table.schema).parquet(*files)
        return rows.orderBy(*self._keys).offset(skip).limit(limit).select(*self._columns)


def page(self, offset: int, limit: int) -> DataFrame:
        """Rows [offset, offset + limit) in key order; none beyond the end."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        labels, skip = self.touched(offset, limit)
        rows = self._table.filter(F.col(LABEL).isin(labels)) if labels else self._table.limit(0)
        return rows.orderBy(*self._keys).offset(skip).limit(limit).select(*self._columns)


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """One page in key order. To read several, keep a `PageIndex`."""
    return PageIndex(df, keys).page(offset, limit)
