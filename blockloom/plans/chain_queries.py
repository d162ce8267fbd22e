"""Chain analytics: scans by range, daily series, joins, comparisons, as-of lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.scalars import iso_text
from blockloom.operators import chain
from blockloom.plans.registry import query, rounded
from blockloom.plans.standins import AS_OF, DAYS
from blockloom.sources import blocks as block_source

CUT = f"TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
DAY = "strftime(timestamp, '%Y-%m-%d')"
ISO = "'%Y-%m-%d %H:%M:%S.%f'"
DAILY = f"""daily AS (
    SELECT blockchain, {DAY} AS day, SUM(transaction_count)::BIGINT AS transactions,
           SUM(gas_used) / COUNT(gas_used) AS gas, COUNT(*) AS slots
    FROM blocks WHERE timestamp >= {CUT} GROUP BY ALL)"""
# Running the joins on every transaction: the period reaches back to the first block.
ETH_TX = f"""eth AS (
    SELECT t.*, b.timestamp AS block_time FROM transactions t JOIN headers b ON t.block_height = b.block_number
    WHERE b.timestamp >= {CUT} AND b.blockchain = 'ethereum')"""
SOL_TX = ETH_TX.replace("eth AS", "sol AS").replace("'ethereum'", "'solana'")


@query(
    "daily_transactions",
    f"SELECT blockchain, {DAY} AS day, SUM(transaction_count)::BIGINT AS transactions "
    f"FROM blocks WHERE timestamp >= {CUT} GROUP BY ALL",
    ("blocks",),
)
def _(t):
    return chain.daily_transactions(t.blocks, DAYS, AS_OF)


@query("daily_avg_gas", f"WITH {DAILY} SELECT blockchain, day, round(gas, 4) AS avg_gas FROM daily", ("blocks",))
def _(t):
    return rounded(chain.daily_avg_gas(t.headers, DAYS, AS_OF), "avg_gas")


@query("daily_slots", f"WITH {DAILY} SELECT blockchain, day, slots AS slots_processed, transactions FROM daily", ("blocks",))
def _(t):
    return chain.daily_slots(t.blocks, DAYS, AS_OF)


@query(
    "chain_statistics",
    f"""SELECT blockchain, COUNT(*) AS total_blocks, COUNT(DISTINCT slot) AS total_slots,
               round(SUM(gas_used) / COUNT(gas_used), 4) AS avg_block_size,
               SUM(transaction_count)::BIGINT AS total_transactions
        FROM blocks WHERE timestamp >= {CUT} GROUP BY blockchain""",
    ("blocks",),
)
def _(t):
    return rounded(chain.chain_statistics(t.blocks, DAYS, AS_OF, F.col("gas_used")), "avg_block_size")


TX_COLUMNS = ("transaction_hash", "block_height", "success", "from_address", "to_address", "value", "gas")


@query(
    "eth_tx_join",
    f"WITH {ETH_TX} SELECT {', '.join(TX_COLUMNS)}, strftime(block_time, {ISO}) AS block_time FROM eth",
    ("headers", "transactions"),
)
def _(t):
    joined = chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF)
    return joined.select(*TX_COLUMNS, iso_text(F.col("block_time")).alias("block_time"))


@query(
    "sol_tx_join",
    f"WITH {SOL_TX} SELECT transaction_hash, block_height AS slot, success, strftime(block_time, {ISO}) AS block_time FROM sol",
    ("headers", "transactions"),
)
def _(t):
    joined = chain.chain_transactions(t.transactions, t.headers, "Solana", DAYS, AS_OF)
    return joined.select(
        "transaction_hash", F.col("block_height").alias("slot"), "success", iso_text(F.col("block_time")).alias("block_time")
    )


def _amounts(column: str) -> str:
    return f"""WITH {ETH_TX} SELECT round(SUM({column})::DOUBLE / COUNT({column}), 4) AS mean,
        round(MEDIAN({column})::DOUBLE, 4) AS median, MAX({column})::DOUBLE AS max FROM eth"""


def _exactly(scaled: str) -> str:
    """Ten thousand times a number, as text with four digits."""
    return f"({scaled}) // 10000 || '.' || lpad((({scaled}) % 10000)::VARCHAR, 4, '0')"


@query(
    "tx_value_stats",
    f"""WITH {ETH_TX}, v AS (
          SELECT value::HUGEINT AS value, row_number() OVER (ORDER BY value::HUGEINT) - 1 AS place, count(*) OVER () AS n FROM eth),
        s AS (SELECT sum(value)::HUGEINT AS total, count(*)::HUGEINT AS n, max(value) AS most,
          sum(CASE WHEN place IN ((n - 1) // 2, n // 2) THEN CASE WHEN n % 2 = 1 THEN 2 * value ELSE value END END)::HUGEINT AS twice FROM v)
        SELECT total::VARCHAR AS total, {_exactly("(total * 20000 + n) // (2 * n)")} AS mean, {_exactly("twice * 5000")} AS median,
          most::VARCHAR AS max FROM s""",
    ("headers", "transactions"),
)
def _(t):
    return chain.exact_amount_statistics(chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF), "value")


@query("tx_gas_stats", _amounts("gas"), ("headers", "transactions"))
def _(t):
    return chain.amount_statistics(chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF), "gas").transform(rounded, "mean", "median")


@query(
    "unique_addresses",
    f"""WITH {ETH_TX} SELECT
        (COUNT(DISTINCT from_address) + COALESCE(MAX(CASE WHEN from_address IS NULL THEN 1 END), 0))::BIGINT AS unique_senders,
        (COUNT(DISTINCT to_address) + COALESCE(MAX(CASE WHEN to_address IS NULL THEN 1 END), 0))::BIGINT AS unique_receivers
        FROM eth""",
    ("headers", "transactions"),
)
def _(t):
    return chain.unique_addresses(chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF))


def _top(column: str) -> str:
    return f"""WITH {ETH_TX} SELECT {column} AS address, COUNT(*) AS transactions FROM eth
        WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY transactions DESC, address LIMIT 5"""


@query("top_senders", _top("from_address"), ("headers", "transactions"))
def _(t):
    eth = chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF)
    return chain.top_addresses(eth, "from_address")


@query("top_receivers", _top("to_address"), ("headers", "transactions"))
def _(t):
    eth = chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF)
    return chain.top_addresses(eth, "to_address")


@query(
    "tx_success_stats",
    f"""WITH {SOL_TX} SELECT COUNT(*) AS total, COUNT(*) FILTER (success) AS successful,
        COUNT(*) - COUNT(*) FILTER (success) AS failed,
        (COUNT(*) FILTER (success) * 100)::DOUBLE / COUNT(*) AS success_rate FROM sol""",
    ("headers", "transactions"),
)
def _(t):
    return chain.success_statistics(chain.chain_transactions(t.transactions, t.headers, "solana", DAYS, AS_OF))


GROWTH = """changes AS (
    SELECT *, (transactions - p)::DOUBLE / NULLIF(p, 0) AS change FROM (
        SELECT *, LAG(transactions) OVER (PARTITION BY blockchain ORDER BY day) AS p FROM daily))"""


@query(
    "growth_rate",
    f"WITH {DAILY}, {GROWTH} SELECT blockchain, round(CASE WHEN COUNT(*) < 2 THEN 0 ELSE AVG(change) * 100 END, 6) AS growth_rate "
    "FROM changes GROUP BY blockchain",
    ("blocks",),
)
def _(t):
    daily = chain.daily_transactions(t.blocks, DAYS, AS_OF)
    return chain.growth_rate(daily, "blockchain", "day", "transactions").withColumn(
        "growth_rate", F.round("growth_rate", 6)
    )


@query(
    "compare_chains",
    f"""WITH {DAILY}, {GROWTH},
    e AS (SELECT COUNT(*) AS d, SUM(transactions) AS n, AVG(change) * 100 AS g FROM changes WHERE blockchain = 'ethereum'),
    s AS (SELECT COUNT(*) AS d, SUM(transactions) AS n, AVG(change) * 100 AS g FROM changes WHERE blockchain = 'solana')
    SELECT e.d::DOUBLE / s.d AS active_day_ratio, e.n::DOUBLE / s.n::DOUBLE AS volume_ratio,
           e.d / {DAYS}.0::DOUBLE AS ethereum_active_day_average, s.d / {DAYS}.0::DOUBLE AS solana_active_day_average,
           round(e.g, 6) AS ethereum_growth_rate, round(s.g, 6) AS solana_growth_rate,
           round(e.g - s.g, 6) AS growth_difference
    FROM e, s""",
    ("blocks",),
)
def _(t):
    return chain.compare_chains(t.blocks, DAYS, AS_OF)


ZIP = f"""{DAILY}, placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY blockchain ORDER BY day) - 1 AS position FROM daily),
    zipped AS (SELECT e.position, e.transactions AS eth_transactions, round(e.gas, 4) AS eth_gas,
                      s.transactions AS sol_transactions, s.slots AS sol_slots
               FROM placed e JOIN placed s ON e.position = s.position
               WHERE e.blockchain = 'ethereum' AND s.blockchain = 'solana')"""


@query("zip_daily_series", f"WITH {ZIP} SELECT * REPLACE (round(eth_gas, 4) AS eth_gas) FROM zipped", ("blocks",))
def _(t):
    return rounded(chain.zip_daily_series(t.blocks, DAYS, AS_OF), "eth_gas")


@query(
    "zip_daily_series_by_date",
    f"""WITH {DAILY} SELECT COALESCE(e.day, s.day) AS day, e.transactions AS eth_transactions, round(e.gas, 4) AS eth_gas,
                      s.transactions AS sol_transactions, s.slots AS sol_slots
        FROM (SELECT * FROM daily WHERE blockchain = 'ethereum') e
        FULL JOIN (SELECT * FROM daily WHERE blockchain = 'solana') s ON e.day = s.day""",
    ("blocks",),
)
def _(t):
    return rounded(chain.zip_daily_series(t.blocks, DAYS, AS_OF, align="date"), "eth_gas")


_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM zipped" for a in chain.SERIES for b in chain.SERIES
)


@query("correlation_matrix", f"WITH {ZIP} {_CELLS}", ("blocks",))
def _(t):
    return chain.correlation_matrix(chain.zip_daily_series(t.blocks, DAYS, AS_OF))


_D = ", ".join(f"MAX(CASE WHEN position % 7 = {i} THEN transactions END) AS d{i}" for i in range(7))


@query(
    "activity_matrix_literal",
    f"""WITH {DAILY}, placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY blockchain ORDER BY day) - 1 AS position FROM daily)
    SELECT blockchain, position // 7 AS matrix_row, {_D} FROM placed GROUP BY ALL""",
    ("blocks",),
)
def _(t):
    return chain.activity_matrix_literal(t.blocks, DAYS, AS_OF)


_DOW = ", ".join(f"COUNT(*) FILTER (dayofweek(ts) = {i}) AS dow{i + 1}" for i in range(7))


@query("activity_hour_dow", f"SELECT series, hour(ts)::BIGINT AS hour, {_DOW} FROM samples GROUP BY ALL", ("samples",))
def _(t):
    return chain.activity_hour_dow(t.samples, "series", "ts")


@query(
    "gas_forecast",
    f"""WITH {DAILY}, placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY blockchain ORDER BY day) - 1 AS position FROM daily),
    fit AS (SELECT blockchain, regr_slope(gas, position) AS slope, regr_intercept(gas, position) AS intercept,
                   COUNT(*) AS n, MAX(day)::DATE AS last_day FROM placed GROUP BY blockchain)
    SELECT blockchain, strftime(last_day + a::INTEGER, '%Y-%m-%d') AS day,
           round(intercept + slope * (n + a - 1), 4) AS predicted_gas
    FROM fit, range(1, 8) r(a)""",
    ("blocks",),
)
def _(t):
    return chain.gas_forecast(t.headers, DAYS, AS_OF)


@query(
    "top_receiver_pairs",
    f"""WITH {ETH_TX}, top AS (
        SELECT to_address, ROW_NUMBER() OVER (ORDER BY n DESC, to_address) AS rk
        FROM (SELECT to_address, COUNT(*) AS n FROM eth WHERE to_address IS NOT NULL GROUP BY 1)
        QUALIFY rk <= 5),
    m AS (SELECT DISTINCT rk, from_address FROM eth JOIN top USING (to_address)),
    shared AS (SELECT a.rk AS rank_a, b.rk AS rank_b, COUNT(*) AS n FROM m a JOIN m b
               ON a.from_address = b.from_address AND a.rk < b.rk GROUP BY ALL)
    SELECT a.rk AS rank_a, b.rk AS rank_b, COALESCE(n, 0)::BIGINT AS shared_senders
    FROM top a JOIN top b ON a.rk < b.rk LEFT JOIN shared ON rank_a = a.rk AND rank_b = b.rk""",
    ("headers", "transactions"),
)
def _(t):
    return chain.top_receiver_pairs(chain.chain_transactions(t.transactions, t.headers, "ethereum", DAYS, AS_OF))


@query(
    "latest_blocks",
    f"""SELECT blockchain, block_number, block_hash, strftime(timestamp, {ISO}) AS timestamp, gas_used
        FROM headers WHERE blockchain = 'ethereum' ORDER BY block_number DESC LIMIT 100""",
    ("headers",),
)
def _(t):
    return chain.latest_blocks(t.headers, "ethereum").select(
        "blockchain", "block_number", "block_hash", iso_text(F.col("timestamp")).alias("timestamp"), "gas_used"
    )


@query(
    "chain_select",
    "SELECT block_number, block_hash FROM headers WHERE lower(blockchain) = 'solana'",
    ("headers",),
)
def _(t):
    return chain.select_chain(t.headers, "Solana").select("block_number", "block_hash")


@query(
    "union_chains",
    """SELECT blockchain, block_number, transaction_count FROM blocks WHERE blockchain = 'ethereum'
       UNION ALL SELECT blockchain, slot, transaction_count FROM blocks WHERE blockchain = 'solana'""",
    ("blocks",),
)
def _(t):
    eth = chain.select_chain(t.blocks, "ethereum").select("blockchain", "block_number", "transaction_count")
    sol = chain.select_chain(t.blocks, "solana").select(
        "blockchain", F.col("slot").alias("block_number"), "transaction_count"
    )
    return eth.unionByName(sol)


@query(
    "block_range_scan",
    "SELECT block_number, block_hash, transaction_count FROM blocks "
    "WHERE block_number BETWEEN (SELECT MIN(block_number) FROM blocks) AND (SELECT MAX(block_number) FROM blocks)",
    ("blocks",),
)
def _(t):
    return block_source.block_range(t.blocks, 0, "latest").select("block_number", "block_hash", "transaction_count")


@query(
    "slot_range_scan",
    """SELECT slot, block_hash FROM headers WHERE blockchain = 'solana'
       AND slot BETWEEN 0 AND (SELECT max(slot) FROM headers WHERE blockchain = 'solana')""",
    ("headers",),
)
def _(t):
    slots = chain.select_chain(t.headers, "solana")
    newest = slots.agg(F.max("slot")).first()[0] or 0
    return block_source.slot_range(slots, 0, newest).select("slot", "block_hash")


@query(
    "slot_gaps",
    """SELECT blockchain, p + 1 AS gap_start, slot - 1 AS gap_end, slot - p - 1 AS missing FROM (
        SELECT blockchain, slot, LAG(slot) OVER (PARTITION BY blockchain ORDER BY slot) AS p FROM headers)
       WHERE slot - p > 1""",
    ("headers",),
)
def _(t):
    return chain.block_gaps(t.headers, "slot")


@query(
    "sequence_gaps",
    """SELECT blockchain, COUNT(*) FILTER (block_number - p <> 1) AS number_breaks,
              COUNT(*) FILTER (timestamp < q) AS time_breaks,
              COUNT(*) FILTER (block_number - p <> 1) = 0 AS sequence_valid,
              COUNT(*) FILTER (timestamp < q) = 0 AS timestamps_valid
       FROM (SELECT *, LAG(block_number) OVER w AS p, LAG(timestamp) OVER w AS q FROM headers
             WINDOW w AS (PARTITION BY blockchain ORDER BY block_number)) GROUP BY blockchain""",
    ("headers",),
)
def _(t):
    return chain.sequence_checks(t.headers)


@query(
    "asof_block",
    f"""WITH probes AS (SELECT DISTINCT c.blockchain, l.l_shipdate AS timestamp FROM lineitem l,
                       (SELECT UNNEST(['ethereum', 'solana']) AS blockchain) c),
    points AS (SELECT blockchain, timestamp, MAX(block_number) AS block_number FROM headers GROUP BY ALL)
    SELECT p.blockchain, strftime(p.timestamp, {ISO}) AS timestamp, COALESCE(b.block_number, 0) AS block_number
    FROM probes p ASOF LEFT JOIN points b ON p.blockchain = b.blockchain AND p.timestamp >= b.timestamp""",
    ("headers",),
)
def _(t):
    probes = t.lineitem.select(
        F.explode(F.array(*[F.lit(c) for c in chain.CHAINS])).alias("blockchain"), F.col("l_shipdate").alias("timestamp")
    )
    return chain.block_at(t.headers, probes).withColumn("timestamp", iso_text(F.col("timestamp")))


RANGE_START, RANGE_END = "1994-12-31 00:00:00", "2001-08-01 12:00:00"
_AT = "COALESCE((SELECT block_number FROM headers WHERE timestamp <= TIMESTAMP '{}' ORDER BY timestamp DESC, block_number DESC LIMIT 1), 0)"


@query(
    "block_time_range",
    f"""SELECT block_number, block_hash, strftime(timestamp, {ISO}) AS timestamp FROM headers
        WHERE block_number BETWEEN {_AT.format(RANGE_START)} AND {_AT.format(RANGE_END)}""",
    ("headers",),
)
def _(t):
    return block_source.time_range(t.headers, RANGE_START, RANGE_END).select(
        "block_number", "block_hash", iso_text(F.col("timestamp")).alias("timestamp")
    )


@query(
    "fetch_summary",
    f"""SELECT COUNT(*) AS block_count, MIN(block_number) AS start_block, MAX(block_number) AS end_block FROM headers
        WHERE block_number BETWEEN {_AT.format(RANGE_START)} AND {_AT.format(RANGE_END)}""",
    ("headers",),
)
def _(t):
    return block_source.fetch_summary(block_source.time_range(t.headers, RANGE_START, RANGE_END))


@query(
    "blocks_with_metrics",
    """SELECT b.block_number, b.block_hash, m.metric_type, m.value FROM headers b
       LEFT JOIN (SELECT block_number, 'tps' AS metric_type, transaction_count::DOUBLE AS value FROM blocks
                  WHERE transaction_count > 0) m ON b.block_number = m.block_number""",
    ("headers", "blocks"),
)
def _(t):
    from blockloom.operators.lifecycle import derive_block_metrics

    metrics = derive_block_metrics(t.blocks.filter("transaction_count > 0")).select("block_number", "metric_type", "value")
    return t.headers.select("block_number", "block_hash").join(metrics, "block_number", "left")


@query(
    "page_slice",
    """WITH p AS (SELECT block_number, block_hash, row_number() OVER (ORDER BY block_number) - 1 AS place, count(*) OVER () AS n FROM headers),
       v AS (SELECT *, CASE WHEN asked < 0 THEN greatest(n + asked, 0) ELSE asked END AS first FROM p, (VALUES (500, 300), (-350, 400)) v(asked, wanted))
       SELECT block_number, block_hash, (place - first) // 100 AS page FROM v WHERE place >= first AND place < first + wanted""",
    ("headers",),
)
def _(t):
    """Three pages near the start, and all pages from 350 rows before the end on."""
    index = block_source.PageIndex(t.headers.select("block_number", "block_hash"), ["block_number"])
    starts = [(500, k) for k in range(3)] + [(max(len(index) - 350, 0), k) for k in range(4)]
    pages = [index.page(start + 100 * k, 100).withColumn("page", F.lit(k).cast("long")) for start, k in starts]
    return reduce(DataFrame.unionByName, pages)
