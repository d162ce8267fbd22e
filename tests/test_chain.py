import random
from datetime import datetime
from fractions import Fraction

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import chain
from blockloom.sources import blocks as block_source

AS_OF = "2024-01-11 00:00:00"
SCHEMA = "blockchain string, block_number long, block_hash string, timestamp timestamp, transaction_count long, gas_used double, slot long"


def block(name, number, day, count, gas, hour=12):
    return (name, number, f"h{name[0]}{number}", datetime(2024, 1, day, hour), count, gas, number)


DATA = [
    block("ethereum", 1, 1, 10, 100.0),
    block("ethereum", 2, 2, 20, 200.0),
    block("ethereum", 3, 2, 10, 400.0, 13),
    block("ethereum", 6, 3, 15, 50.0),
    block("solana", 5, 1, 0, 0.0),
    block("solana", 6, 2, 8, 0.0),
    block("solana", 9, 3, 12, 0.0),
    block("ethereum", 99, 10, 7, 70.0),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_daily_series_and_cutoff(blocks):
    all_days = rows(chain.daily_transactions(blocks, 30, AS_OF))
    assert ("ethereum", "2024-01-02", 30) in all_days and len(all_days) == 7
    assert rows(chain.daily_transactions(blocks, 5, AS_OF)) == [("ethereum", "2024-01-10", 7)]
    assert ("ethereum", "2024-01-02", 300.0) in rows(chain.daily_avg_gas(blocks, 30, AS_OF))
    assert ("ethereum", "2024-01-02", 2, 30) in rows(chain.daily_slots(blocks, 30, AS_OF))


@pytest.mark.parametrize("days", [0, -1])
def test_days_must_be_positive(blocks, days):
    with pytest.raises(ValueError):
        chain.daily_transactions(blocks, days, AS_OF)


def test_unknown_chain(blocks):
    with pytest.raises(ValueError):
        chain.select_chain(blocks, "bitcoin")
    assert chain.select_chain(blocks, "SOLANA").count() == 3


def test_growth_rate_edge_cases(spark):
    daily = spark.createDataFrame(
        [("a", "1", 10), ("a", "2", 15), ("a", "3", 30), ("one", "1", 5), ("zero", "1", 0), ("zero", "2", 4), ("zero", "3", 6)],
        "k string, day string, n long",
    )
    got = dict(rows(chain.growth_rate(daily, "k", "day", "n")))
    assert got["a"] == pytest.approx(75.0)
    assert got["one"] == 0.0
    assert got["zero"] == pytest.approx(50.0)  # the day after a zero is skipped


def test_compare_chains(blocks):
    row = chain.compare_chains(blocks, 30, AS_OF).first()
    assert row["active_day_ratio"] == pytest.approx(4 / 3)
    assert row["volume_ratio"] == pytest.approx(62 / 20)
    assert row["ethereum_active_day_average"] == pytest.approx(4 / 30)
    assert row["growth_difference"] == pytest.approx(row["ethereum_growth_rate"] - row["solana_growth_rate"], abs=1e-5)


def test_compare_chains_without_second_chain(blocks):
    row = chain.compare_chains(blocks.filter("blockchain = 'ethereum'"), 30, AS_OF).first()
    assert (row["active_day_ratio"], row["volume_ratio"], row["solana_growth_rate"]) == (0.0, 0.0, 0.0)


def test_addresses(spark):
    tx = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), (None, None)], "from_address string, to_address string"
    )
    assert rows(chain.unique_addresses(tx)) == [(3, 3)]
    assert [tuple(r) for r in chain.top_addresses(tx, "from_address").collect()] == [("a", 2), ("b", 1)]
    pairs = rows(chain.top_receiver_pairs(tx))
    assert pairs == [(1, 2, 1)]


def test_transactions_are_not_sorted_to_find_their_blocks(spark):
    """A task holds its share of the blocks' numbers, not of the transactions."""
    at = datetime(2024, 6, 1)
    blocks = spark.createDataFrame([("ethereum", i, at) for i in range(50)] + [("solana", 50, at)], "blockchain string, block_number long, timestamp timestamp")
    tx = spark.createDataFrame([(i % 60, f"a{i % 7}" if i % 7 else None, f"b{i % 11}", at) for i in range(600)], "block_height long, from_address string, to_address string, timestamp timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chain.unique_addresses(chain.chain_transactions(tx, blocks, "ethereum", 30, "2024-06-02"))
        assert rows(found) == [(7, 11)]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_amounts_and_success(spark):
    tx = spark.createDataFrame([(1.0, True), (2.0, False), (4.5, True), (10.0, True)], "value double, success boolean")
    assert rows(chain.amount_statistics(tx, "value")) == [(4.375, 3.25, 10.0)]
    assert rows(chain.success_statistics(tx)) == [(4, 3, 1, 75.0)]
    assert rows(chain.success_statistics(tx.limit(0))) == [(0, 0, 0, 0.0)]


def test_join_keeps_only_recent_blocks_of_the_chain(spark, blocks):
    tx = spark.createDataFrame([(1, 5.0), (99, 6.0), (5, 7.0), (1000, 8.0)], "block_height long, value double").withColumn(
        "timestamp", F.lit(AS_OF).cast("timestamp")
    )
    assert [r["value"] for r in chain.chain_transactions(tx, blocks, "ethereum", 3, AS_OF).collect()] == [6.0]


def test_constant_series_has_no_correlation(spark):
    zipped = spark.createDataFrame([(1, 2.0, 5, 1), (2, 4.0, 5, 3), (3, 6.0, 5, 2)], ", ".join(f"{s} double" for s in chain.SERIES).replace("eth_transactions double", "eth_transactions long").replace("sol_transactions double", "sol_transactions long").replace("sol_slots double", "sol_slots long"))
    got = {(a, b): r for a, b, r in rows(chain.correlation_matrix(zipped))}
    assert len(got) == 16
    assert got["eth_transactions", "eth_gas"] == 1.0
    assert got["eth_transactions", "sol_transactions"] is None
    assert got["eth_gas", "sol_slots"] == 0.5


def test_zip_by_date_keeps_unmatched_days(blocks):
    assert chain.zip_daily_series(blocks, 30, AS_OF).count() == 3
    assert chain.zip_daily_series(blocks, 30, AS_OF, align="date").count() == 4
    with pytest.raises(ValueError):
        chain.zip_daily_series(blocks, 30, AS_OF, align="week")


def test_activity_matrix_keeps_the_unfinished_row(spark):
    data = [block("ethereum", d, d, d, 1.0) for d in range(1, 10)]
    out = chain.activity_matrix_literal(spark.createDataFrame(data, SCHEMA), 30, AS_OF)
    assert rows(out) == [("ethereum", 0, 1, 2, 3, 4, 5, 6, 7), ("ethereum", 1, 8, 9, None, None, None, None, None)]


def test_forecast_continues_a_line(spark):
    data = [block("ethereum", d, d, 1, 10.0 * d) for d in range(1, 6)]
    out = rows(chain.gas_forecast(spark.createDataFrame(data, SCHEMA), 30, AS_OF, 2))
    assert out == [("ethereum", "2024-01-06", 60.0), ("ethereum", "2024-01-07", 70.0)]
    with pytest.raises(ValueError):
        chain.gas_forecast(spark.createDataFrame(data, SCHEMA), 30, AS_OF, 0)


def test_gaps_and_sequence(blocks):
    assert rows(chain.block_gaps(blocks, "slot")) == [("ethereum", 4, 5, 2), ("ethereum", 7, 98, 92), ("solana", 7, 8, 2)]
    got = {r["blockchain"]: r.asDict() for r in chain.sequence_checks(blocks).collect()}
    assert got["ethereum"]["number_breaks"] == 2 and got["ethereum"]["timestamps_valid"]
    assert not got["solana"]["sequence_valid"]


def test_block_ranges(blocks):
    eth = blocks.filter("blockchain = 'ethereum'")
    assert [r[0] for r in rows(block_source.block_range(eth, 2, 6).select("block_number"))] == [2, 3, 6]
    assert [r[0] for r in rows(block_source.block_range(eth, "latest").select("block_number"))] == [99]
    assert [r[0] for r in rows(block_source.slot_range(blocks, 6).select("slot"))] == [6, 6]
    assert block_source.slot_range(blocks, 7, 8).count() == 0


def test_time_range_starts_with_the_block_before(blocks):
    eth = blocks.filter("blockchain = 'ethereum'")
    ranged = block_source.time_range(eth, "2024-01-02 12:30:00", "2024-01-03 00:00:00")
    assert [r[0] for r in rows(ranged.select("block_number"))] == [2, 3]
    assert rows(block_source.fetch_summary(ranged)) == [(2, 2, 3)]


def test_block_at(spark, blocks):
    probes = spark.createDataFrame(
        [("ethereum", datetime(2024, 1, 2, 13)), ("ethereum", datetime(2023, 1, 1)), ("solana", datetime(2024, 2, 1))],
        "blockchain string, timestamp timestamp",
    )
    assert sorted(r[2] for r in rows(chain.block_at(blocks, probes))) == [0, 3, 9]


def test_latest_and_page(blocks):
    assert [r["block_number"] for r in chain.latest_blocks(blocks, "ethereum", 2).collect()] == [99, 6]
    page = block_source.page(blocks.select("block_number", "block_hash"), ["block_number", "block_hash"], 2, 2)
    assert [r[0] for r in page.collect()] == [3, 5]


def test_amounts_beyond_two_digits_and_doubles(spark):
    rows = [(str(3 * 10**18),), (str(10**18),), (str(2 * 10**18),)]
    df = spark.createDataFrame(rows, "v string").select(F.col("v").cast("decimal(38,0)").alias("value"))
    got = chain.amount_statistics(df, "value").first()
    assert (got["mean"], got["median"], got["max"]) == (2e18, 2e18, 3e18)


def test_a_deep_page_reads_one_or_two_blocks(spark):
    numbers = spark.range(0, 200_000, 1, 7).select((F.col("id") * 7919 % 200_000).alias("n"), F.hash("id").alias("h"))
    index = block_source.PageIndex(numbers, ["n"], blocks=20)
    assert len(index) == 200_000
    for offset, limit in ((0, 100), (100_000, 100), (199_950, 100), (123_456, 1), (200_000, 10), (5, 0)):
        got = index.page(offset, limit)
        assert [r["n"] for r in got.collect()] == list(range(offset, min(offset + limit, 200_000)))
        assert offset == 200_000 or not limit or 1 <= len(index.page(offset, limit).inputFiles()) <= 2
    assert index.page(0, 10**6).count() == 200_000
    assert block_source.PageIndex(numbers.limit(0), ["n"], 3).page(0, 10).collect() == []


def test_amounts_of_any_length_are_exact(spark):
    rng = random.Random(7)
    for numbers in ([3 * 10**18, 2**255, 1, 0], [2**256 - 1] * 5 + [2**256 - 2], [7], [rng.randrange(2 ** rng.randrange(1, 280)) for _ in range(500)]):
        texts = [rng.choice(("", "0", "000")) + str(v) for v in numbers] + [None, "", "x", "-1", "1.5"]
        df = spark.createDataFrame([(t,) for t in texts], "value string")
        got = chain.exact_amount_statistics(df, "value").first()
        ordered = sorted(numbers)
        middle = Fraction(ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2], 2)
        shown = lambda f: f"{(f * 20000 + 1) // 2 // 10000}.{(f * 20000 + 1) // 2 % 10000:04d}"
        assert tuple(got) == (str(sum(numbers)), shown(Fraction(sum(numbers), len(numbers))), shown(middle), str(ordered[-1]))
    none = chain.exact_amount_statistics(spark.createDataFrame([("x",)], "value string"), "value").first()
    assert tuple(none) == ("0", None, None, None)
    with pytest.raises(Exception, match="digits"):
        chain.exact_amount_statistics(spark.createDataFrame([("9" * 91,)], "value string"), "value").collect()
