"""Block and transaction analytics.

Day-level windows below run on pre-aggregated rows, at most one per chain and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import amounts
from blockloom.functions.scalars import cutoff, iso_date, percent, ratio
from blockloom.operators.ordered import Running, as_of as as_of_lookup, exact_quantiles, scan

CHAINS = ("ethereum", "solana")


def recent(df: DataFrame, days: int, as_of: str, ts: str = "timestamp") -> DataFrame:
    """Rows of the last `days` days."""
    return df.filter(F.col(ts) >= cutoff(as_of, days))


def select_chain(blocks: DataFrame, chain: str) -> DataFrame:
    """Rows of one chain, named in any case."""
    name = chain.lower()
    if name not in CHAINS:
        raise ValueError(f"unsupported blockchain: {chain}")
    return blocks.filter(F.lower("blockchain") == name)


def daily_transactions(blocks: DataFrame, days: int, as_of: str) -> DataFrame:
    return (
        recent(blocks, days, as_of)
        .groupBy("blockchain", iso_date(F.col("timestamp")).alias("day"))
        .agg(F.sum("transaction_count").alias("transactions"))
    )


def daily_avg_gas(blocks: DataFrame, days: int, as_of: str) -> DataFrame:
    return (
        recent(blocks, days, as_of)
        .groupBy("blockchain", iso_date(F.col("timestamp")).alias("day"))
        .agg((F.sum(F.col("gas_used")).cast("double") / F.count("gas_used")).alias("avg_gas"))
    )


def daily_slots(blocks: DataFrame, days: int, as_of: str) -> DataFrame:
    return (
        recent(blocks, days, as_of)
        .groupBy("blockchain", iso_date(F.col("timestamp")).alias("day"))
        .agg(F.count("*").alias("slots_processed"), F.sum("transaction_count").alias("transactions"))
    )


def chain_statistics(blocks: DataFrame, days: int, as_of: str, size: Column) -> DataFrame:
    """Totals of the period per chain; `size` is the block size."""
    return (
        recent(blocks, days, as_of)
        .groupBy("blockchain")
        .agg(
            F.count("*").alias("total_blocks"),
            F.count_distinct("slot").alias("total_slots"),
            ratio(F.sum(size), F.count(size)).alias("avg_block_size"),
            F.sum("transaction_count").alias("total_transactions"),
        )
    )


def growth_rate(daily: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Mean day-over-day change in percent; 0 with fewer than two days, days after a zero skipped."""
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(day))
    change = F.try_divide((F.col(value) - F.col("_previous")).cast("double"), F.col("_previous").cast("double"))
    return (
        daily.withColumn("_previous", previous)
        .groupBy(key)
        .agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.avg(change) * 100).alias("growth_rate"))
    )


def compare_chains(blocks: DataFrame, days: int, as_of: str) -> DataFrame:
    """One row comparing the two chains.

    `active_day_ratio` and the `*_active_day_average` columns divide counts of active days;
    `volume_ratio` divides transaction totals.
    """
    daily = daily_transactions(blocks, days, as_of)
    previous = F.lag("transactions").over(Window.partitionBy("blockchain").orderBy("day"))
    change = F.try_divide((F.col("transactions") - F.col("_p")).cast("double"), F.col("_p").cast("double"))
    marked = daily.withColumn("_p", previous).withColumn("_change", change)

    def of(chain: str, value: Column) -> Column:
        return F.when(F.col("blockchain") == chain, value)

    sums = []
    for chain in CHAINS:
        sums += [
            F.count(of(chain, F.lit(1))).alias(f"{chain}_days"),
            F.coalesce(F.sum(of(chain, F.col("transactions"))), F.lit(0)).alias(f"{chain}_transactions"),
            F.coalesce(F.avg(of(chain, F.col("_change"))) * 100, F.lit(0.0)).alias(f"{chain}_growth_rate"),
        ]
    one = marked.agg(*sums)
    return one.select(
        ratio(F.col("ethereum_days"), F.col("solana_days")).alias("active_day_ratio"),
        ratio(F.col("ethereum_transactions"), F.col("solana_transactions")).alias("volume_ratio"),
        (F.col("ethereum_days") / F.lit(float(days))).alias("ethereum_active_day_average"),
        (F.col("solana_days") / F.lit(float(days))).alias("solana_active_day_average"),
        F.round("ethereum_growth_rate", 6).alias("ethereum_growth_rate"),
        F.round("solana_growth_rate", 6).alias("solana_growth_rate"),
        F.round(F.col("ethereum_growth_rate") - F.col("solana_growth_rate"), 6).alias("growth_difference"),
    )


def chain_transactions(transactions: DataFrame, blocks: DataFrame, chain: str, days: int, as_of: str) -> DataFrame:
    """Transactions of one chain's recent blocks.

    A task holds the numbers and times of its share of the blocks; transactions stream past them and are not sorted.
    """
    kept = select_chain(recent(blocks, days, as_of), chain).select(
        F.col("block_number").alias("block_height"), F.col("timestamp").alias("block_time")
    )
    return transactions.drop("timestamp").join(kept.hint("shuffle_hash"), "block_height")


def amount_statistics(transactions: DataFrame, column: str) -> DataFrame:
    """Mean, exact median and maximum of one amount column."""
    return exact_quantiles(transactions, [], column, {"median": 0.5}, moments=True).select("mean", "median", "max")


def exact_amount_statistics(transactions: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """The same of amounts given as integer text, all results exact text: (total, mean, median, max).

    What is no integer is left out. The median comes from running counts over the ordered amounts, as for numbers.
    """
    kept = transactions.select(amounts.canonical(F.col(column)).alias("_amount")).filter("_amount IS NOT NULL")
    counts = kept.groupBy(F.length("_amount").alias("_digits"), "_amount").agg(F.count("*").alias("_n"))
    ranked = scan(
        counts,
        [],
        ["_digits", "_amount"],
        [Running("_upto", "sum", F.col("_n")), Running("_from", "sum", F.col("_n"), backward=True)],
    )
    middle, before = (F.col("_upto") + F.col("_from") - F.col("_n") - 1) / 2, F.col("_upto") - F.col("_n")
    pick = lambda rank: F.max(F.when((before <= rank) & (rank < F.col("_upto")), F.col("_amount")))
    found = ranked.agg(
        pick(F.floor(middle)).alias("_low"),
        pick(F.ceil(middle)).alias("_high"),
        F.max(amounts.order_of(F.col("_amount")))["text"].alias("max"),
        amounts.limb_sums(F.col("_amount"), F.col("_n")).alias("_sums"),
    )
    return found.select(
        amounts.total_text(F.col("_sums.sums")).alias("total"),
        amounts.mean_text(F.col("_sums"), digits).alias("mean"),
        amounts.between_text(F.col("_low"), F.col("_high"), F.lit(0.5), digits).alias("median"),
        "max",
    )


def unique_addresses(transactions: DataFrame) -> DataFrame:
    """Distinct senders and receivers; a missing address counts as one value."""

    def distinct(column: str) -> Column:
        return F.count_distinct(column) + F.coalesce(F.max(F.when(F.col(column).isNull(), 1)), F.lit(0))

    return transactions.agg(
        distinct("from_address").cast("bigint").alias("unique_senders"),
        distinct("to_address").cast("bigint").alias("unique_receivers"),
    )


def top_addresses(transactions: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The `n` most frequent addresses, ties by address; missing addresses are left out."""
    return (
        transactions.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("address"))
        .agg(F.count("*").alias("transactions"))
        .orderBy(F.desc("transactions"), "address")
        .limit(n)
    )


def success_statistics(transactions: DataFrame) -> DataFrame:
    good = F.count_if("success")
    return transactions.agg(
        F.count("*").alias("total"),
        good.alias("successful"),
        (F.count("*") - good).alias("failed"),
        percent(good, F.count("*")).alias("success_rate"),
    )


def _positions(daily: DataFrame, key: str, day: str) -> DataFrame:
    return daily.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy(day)) - 1).cast("bigint"))


def zip_daily_series(blocks: DataFrame, days: int, as_of: str, align: str = "position") -> DataFrame:
    """The daily series of both chains side by side, matched by position or by date."""
    daily = (
        recent(blocks, days, as_of)
        .groupBy("blockchain", iso_date(F.col("timestamp")).alias("day"))
        .agg(
            F.sum("transaction_count").alias("transactions"),
            (F.sum(F.col("gas_used")).cast("double") / F.count("gas_used")).alias("gas"),
            F.count("*").alias("slots"),
        )
    )
    if align == "position":
        daily, on = _positions(daily, "blockchain", "day"), "position"
    elif align == "date":
        on = "day"
    else:
        raise ValueError(f"unknown alignment: {align}")

    def pick(chain: str, column: str) -> Column:
        return F.max(F.when(F.col("blockchain") == chain, F.col(column)))

    zipped = daily.groupBy(on).agg(
        pick("ethereum", "transactions").alias("eth_transactions"),
        pick("ethereum", "gas").alias("eth_gas"),
        pick("solana", "transactions").alias("sol_transactions"),
        pick("solana", "slots").alias("sol_slots"),
    )
    if align == "date":
        return zipped
    return zipped.filter(F.col("eth_transactions").isNotNull() & F.col("sol_transactions").isNotNull())


SERIES = ("eth_transactions", "eth_gas", "sol_transactions", "sol_slots")


def correlation_matrix(zipped: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of series as (a, b, r); null for a constant series."""
    cells = []
    for a in SERIES:
        for b in SERIES:
            r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r, 6).alias("r")))
    return zipped.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def activity_matrix_literal(blocks: DataFrame, days: int, as_of: str) -> DataFrame:
    """Daily totals laid out seven per row by position; the last row of a chain may end in nulls."""
    placed = _positions(daily_transactions(blocks, days, as_of), "blockchain", "day")
    week = F.floor(F.col("position") / 7).cast("bigint")
    slot = F.col("position") % 7
    cells = [F.max(F.when(slot == i, F.col("transactions"))).alias(f"d{i}") for i in range(7)]
    return placed.groupBy("blockchain", week.alias("matrix_row")).agg(*cells)


def activity_hour_dow(samples: DataFrame, key: str, ts: str) -> DataFrame:
    """Counts per hour of day (rows) and weekday (columns, Sunday first)."""
    dow = F.dayofweek(ts)
    cells = [F.count_if(dow == i).alias(f"dow{i}") for i in range(1, 8)]
    return samples.groupBy(key, F.hour(ts).cast("bigint").alias("hour")).agg(*cells)


def gas_forecast(blocks: DataFrame, days: int, as_of: str, prediction_days: int = 7) -> DataFrame:
    """Straight-line forecast of the daily mean gas for the days after the last one."""
    if prediction_days <= 0:
        raise ValueError("prediction_days must be a positive integer")
    daily = _positions(daily_avg_gas(blocks, days, as_of), "blockchain", "day")
    fit = daily.groupBy("blockchain").agg(
        F.regr_slope("avg_gas", "position").alias("slope"),
        F.regr_intercept("avg_gas", "position").alias("intercept"),
        F.count("*").alias("n"),
        F.to_date(F.max("day")).alias("last_day"),
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(prediction_days)))
    return fit.withColumn("ahead", ahead).select(
        "blockchain",
        F.date_format(F.date_add("last_day", F.col("ahead")), "yyyy-MM-dd").alias("day"),
        F.round(F.col("intercept") + F.col("slope") * (F.col("n") + F.col("ahead") - 1), 4).alias("predicted_gas"),
    )


def top_receiver_pairs(transactions: DataFrame, n: int = 5) -> DataFrame:
    """Pairs of the `n` busiest receivers and the number of senders they share."""
    top = top_addresses(transactions, "to_address", n).select(
        F.struct((-F.col("transactions")).alias("order"), F.col("address")).alias("entry")
    )
    ranked = top.agg(F.sort_array(F.collect_list("entry")).alias("entries")).select(
        F.posexplode("entries").alias("rank", "entry")
    )
    ranked = ranked.select((F.col("rank") + 1).cast("bigint").alias("rank"), F.col("entry.address").alias("to_address"))
    # At most n ranks per sender and n*(n-1)/2 pairs in all, whatever the size of the table.
    members = transactions.join(F.broadcast(ranked), "to_address").groupBy("from_address").agg(
        F.collect_set("rank").alias("ranks")
    )
    shared = members.select(F.explode(_pairs("ranks")).alias("pair")).groupBy("pair").agg(
        F.count("*").alias("shared_senders")
    )
    grid = ranked.agg(F.collect_set("rank").alias("ranks")).select(F.explode(_pairs("ranks")).alias("pair"))
    return grid.join(shared, "pair", "left").select(
        F.col("pair.a").alias("rank_a"),
        F.col("pair.b").alias("rank_b"),
        F.coalesce("shared_senders", F.lit(0)).alias("shared_senders"),
    )


def _pairs(ranks: str) -> Column:
    def above(a: Column) -> Column:
        later = F.filter(ranks, lambda b: b > a)
        return F.transform(later, lambda b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(ranks, above))


def latest_blocks(blocks: DataFrame, chain: str, n: int = 100) -> DataFrame:
    return select_chain(blocks, chain).orderBy(F.desc("block_number")).limit(n)


def block_gaps(blocks: DataFrame, number: str = "slot") -> DataFrame:
    """Ranges of numbers a chain skips between its first and last one."""
    distinct = blocks.select("blockchain", number).distinct()
    ran = scan(
        distinct, ["blockchain"], [number], [Running("_previous", "last", F.col(number), inclusive=False)]
    )
    return ran.filter(F.col(number) - F.col("_previous") > 1).select(
        "blockchain",
        (F.col("_previous") + 1).alias("gap_start"),
        (F.col(number) - 1).alias("gap_end"),
        (F.col(number) - F.col("_previous") - 1).alias("missing"),
    )


def sequence_checks(blocks: DataFrame) -> DataFrame:
    """Per chain, in block order: are numbers contiguous and times non-decreasing?"""
    order = ["block_number", "block_hash"]
    ran = scan(
        blocks.select("blockchain", "timestamp", *order),
        ["blockchain"],
        order,
        [
            Running("_number", "last", F.col("block_number"), inclusive=False),
            Running("_time", "last", F.col("timestamp"), inclusive=False),
        ],
    )
    jump = F.coalesce(F.col("block_number") - F.col("_number") != 1, F.lit(False))
    back = F.coalesce(F.col("timestamp") < F.col("_time"), F.lit(False))
    return ran.groupBy("blockchain").agg(
        F.count_if(jump).alias("number_breaks"),
        F.count_if(back).alias("time_breaks"),
        (F.count_if(jump) == 0).alias("sequence_valid"),
        (F.count_if(back) == 0).alias("timestamps_valid"),
    )


def block_at(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """For each distinct (chain, time): the last block at or before it, 0 if none."""
    points = blocks.select("blockchain", "timestamp", "block_number")
    return as_of_lookup(points, probes, ["blockchain"], "timestamp", "block_number")
