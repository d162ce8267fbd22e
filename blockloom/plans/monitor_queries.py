"""Request-log metrics, windows, alert rules and access audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.scalars import iso_text
from blockloom.operators import audit, monitor
from blockloom.plans.registry import query, rounded
from blockloom.plans.standins import EVENTS_AS_OF

ISO = "'%Y-%m-%d %H:%M:%S.%f'"


@query("request_counts", "SELECT endpoint, model, status, COUNT(*) AS requests FROM requests GROUP BY ALL", ("requests",))
def _(t):
    return monitor.request_counts(t.requests)


_LE = " UNION ALL ".join(
    f"SELECT endpoint, model, '{'+Inf' if b == float('inf') else b}' AS le, "
    f"COUNT(*) FILTER (latency <= {'1e308' if b == float('inf') else b}) AS requests FROM requests GROUP BY ALL"
    for b in monitor.LATENCY_BUCKETS
)


@query("latency_histogram", _LE, ("requests",))
def _(t):
    return monitor.latency_histogram(t.requests)


@query(
    "inference_totals",
    """SELECT SUM(tokens)::BIGINT AS total_requests, SUM(user_id)::BIGINT AS total_tokens,
              round(SUM(latency) / SUM(tokens), 4) AS avg_latency FROM requests""",
    ("requests",),
)
def _(t):
    out = monitor.inference_totals(t.requests, "tokens", "user_id", "latency")
    return rounded(out, "avg_latency")


@query(
    "batch_stats",
    """SELECT SUM(tokens)::DOUBLE / COUNT(tokens) AS avg_batch_size, MIN(tokens) AS min_batch_size, MAX(tokens) AS max_batch_size FROM requests""",
    ("requests",),
)
def _(t):
    return monitor.batch_stats(t.requests, "tokens")


@query(
    "last10_mean",
    """SELECT round(SUM(latency) / COUNT(*), 4) AS mean FROM (
        SELECT latency FROM requests ORDER BY ts DESC, event_id DESC LIMIT 10)""",
    ("requests",),
)
def _(t):
    return rounded(monitor.last_mean(t.requests, ["ts", "event_id"], "latency"), "mean")


@query(
    "running_avg_latency",
    """SELECT event_id, endpoint, round(COALESCE((SUM(latency) OVER w) / NULLIF(SUM(tokens) OVER w, 0), 0), 4) AS avg_latency
       FROM requests WINDOW w AS (PARTITION BY endpoint ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    ("requests",),
)
def _(t):
    source = t.requests.select("event_id", "endpoint", "ts", "tokens", "latency")
    out = monitor.running_avg_latency(source, ["endpoint"], ["ts", "event_id"], "tokens", "latency")
    return rounded(out.select("event_id", "endpoint", "avg_latency"), "avg_latency")


@query(
    "rolling10_mean",
    """SELECT event_id, series, round((SUM(value) OVER w) / COUNT(*) OVER w, 9) AS rolling_mean FROM samples
       WINDOW w AS (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ("samples",),
)
def _(t):
    out = monitor.rolling_mean(t.samples, ["series"], ["ts", "event_id"], "value")
    return rounded(out.select("event_id", "series", "rolling_mean"), "rolling_mean", digits=9)


_TRAIL = """trail AS (SELECT DISTINCT series, ts, COUNT(*) OVER w AS samples,
    round((SUM(value) OVER w) / COUNT(*) OVER w, 9) AS mean, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi
    FROM samples WINDOW w AS (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW))"""


@query("trailing_5m_avg", f"WITH {_TRAIL} SELECT series, strftime(ts, {ISO}) AS ts, samples, mean FROM trail", ("samples",))
def _(t):
    out = monitor.trailing_stats(t.samples, ["series"], "ts", "value")
    return rounded(out.select("series", iso_text(F.col("ts")).alias("ts"), "samples", "mean"), "mean", digits=9)


@query(
    "trailing_5m_range",
    f"""WITH {_TRAIL}, m AS (SELECT *, CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE (hi - lo) * 0.1::DOUBLE END AS margin FROM trail)
    SELECT series, strftime(ts, {ISO}) AS ts, lo AS min, hi AS max, greatest(0, lo - margin) AS lower, hi + margin AS upper FROM m""",
    ("samples",),
)
def _(t):
    out = monitor.trailing_stats(t.samples, ["series"], "ts", "value")
    return out.select("series", iso_text(F.col("ts")).alias("ts"), "min", "max", "lower", "upper")


def _floor(seconds: int) -> str:
    return f"(floor(epoch(ts) / {seconds})::BIGINT * {seconds})"


@query(
    "tps_tumbling",
    f"""SELECT endpoint, strftime(make_timestamp({_floor(60)} * 1000000), {ISO}) AS window_start, round(SUM(tokens)::DOUBLE / 60, 9) AS tps
        FROM requests GROUP BY ALL""",
    ("requests",),
)
def _(t):
    out = monitor.tumbling_rate(t.requests, ["endpoint"], "ts", F.col("tokens"))
    return rounded(out.withColumn("window_start", iso_text(F.col("window_start"))), "tps", digits=9)


def _spread(select: str, keys: str = "", minutes: int = 5, step: int = 1, source: str = "requests") -> str:
    """Windows of `minutes` every `step` minutes, straight from the rows."""
    return f"""SELECT {keys} {_floor(step * 60)} + i * {step * 60} AS window_end, {select}
        FROM {source}, (SELECT UNNEST(range(1, {minutes // step + 1})) AS i) GROUP BY ALL"""


@query(
    "tps_sliding",
    f"SELECT endpoint, window_end, n / 300.0::DOUBLE AS tps FROM ({_spread('SUM(tokens)::BIGINT AS n', 'endpoint,')})",
    ("requests",),
)
def _(t):
    out = monitor.sliding(t.requests, ["endpoint"], "ts", {"n": ("sum", F.col("tokens"))})
    return out.select("endpoint", "window_end", (F.col("n") / F.lit(300.0)).alias("tps"))


@query("threshold_alerts", "SELECT event_id, value FROM samples WHERE series = 'click' AND value > 15", ("samples",))
def _(t):
    return monitor.threshold_alerts(t.samples, "click", "series", "value", 15.0).select("event_id", "value")


def _held(inner: str, firing: str, columns: str, keys: tuple[str, ...] = ()) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""WITH rated AS ({inner}), flagged AS (SELECT *, {firing} AS firing FROM rated)
        SELECT {columns}, window_end, firing,
               COUNT(*) FILTER (firing) OVER ({part}ORDER BY window_end RANGE BETWEEN 240 PRECEDING AND CURRENT ROW) = 5 AS sustained
        FROM flagged"""


@query(
    "error_rate_alert",
    _held(
        _spread("COUNT(*) FILTER (status = 'error') AS errors, COUNT(*) AS requests"),
        "errors::DOUBLE / requests > 0.1",
        "errors, requests, errors::DOUBLE / requests AS error_rate",
    ),
    ("requests",),
)
def _(t):
    return monitor.error_rate_alert(t.requests)


@query(
    "p95_latency_alert",
    _held(_spread("round(quantile_cont(latency, 0.95), 6) AS p95"), "p95 > 2", "p95"),
    ("requests",),
)
def _(t):
    return monitor.p95_latency_alert(t.requests).withColumn("p95", F.round("p95", 6))


@query(
    "request_rate",
    _held(_spread("COUNT(*) AS requests"), "requests / 300.0::DOUBLE > 0.005", "requests, requests / 300.0::DOUBLE AS rate"),
    ("requests",),
)
def _(t):
    return monitor.request_rate(t.requests, threshold=0.005)


@query(
    "gauge_alert",
    _held(_spread("MAX(value) AS gauge", "series,", 1, 1, "samples"), "gauge > 14", "series, gauge", ("series",)),
    ("samples",),
)
def _(t):
    return monitor.gauge_alert(t.samples, ["series"], "ts", "value", 14.0)


@query(
    "counter_increase",
    f"""WITH r AS (SELECT series, ts, CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END AS rise FROM (
            SELECT event_type AS series, ts, (props->>'$.k')::BIGINT AS c,
                   LAG((props->>'$.k')::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events))
    SELECT *, increase > 0 AS firing FROM ({_spread('SUM(rise)::BIGINT AS increase', 'series,', 15, 5, 'r')})""",
)
def _(t):
    samples = t.requests.select("event_id", "ts", F.col("endpoint").alias("series"), F.col("tokens").alias("count"))
    return monitor.counter_increase(samples, ["series"], ["ts", "event_id"], "ts", "count")


_RESAMPLED = f"""SELECT series, make_timestamp({_floor(300)} * 1000000) AS window_start,
    round(SUM(value) / COUNT(*), 9) AS average FROM samples GROUP BY ALL"""


@query("metric_resample", f"SELECT series, strftime(window_start, {ISO}) AS window_start, average FROM ({_RESAMPLED})", ("samples",))
def _(t):
    out = monitor.metric_resample(t.samples, ["series"], "ts", "value", EVENTS_AS_OF, hours=24 * 40)
    return rounded(out.withColumn("window_start", iso_text(F.col("window_start"))), "average", digits=9)


@query(
    "metric_first_point",
    f"""WITH r AS ({_RESAMPLED}) SELECT m AS metric, COALESCE((SELECT arg_min(average, window_start) FROM r WHERE series = m), 0) AS value
        FROM (SELECT UNNEST(['click', 'view', 'disk_usage']) AS m)""",
    ("samples",),
)
def _(t):
    out = monitor.metric_resample(t.samples, ["series"], "ts", "value", EVENTS_AS_OF, hours=24 * 40)
    return rounded(monitor.first_point(out, "series", ["click", "view", "disk_usage"]), "value", digits=9)


DEBOUNCE = """WITH RECURSIVE pts AS (SELECT DISTINCT series, ts FROM samples WHERE value > 5),
    nxt AS (SELECT series, ts, MIN(ts) OVER (PARTITION BY series ORDER BY ts
                   RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM pts),
    fired AS (SELECT series, MIN(ts) AS ts FROM pts GROUP BY series
              UNION ALL SELECT f.series, n.nxt FROM fired f JOIN nxt n ON n.series = f.series AND n.ts = f.ts WHERE n.nxt IS NOT NULL)"""


@query("debounced_alerts", f"{DEBOUNCE} SELECT series, strftime(ts, {ISO}) AS ts FROM fired", ("samples",))
def _(t):
    high = t.samples.filter("value > 5").select("series", "ts")
    return monitor.debounce(high, ["series"], "ts", 3600).withColumn("ts", iso_text(F.col("ts")))


@query(
    "authorized_events",
    """WITH asked AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'admin' WHEN 'view' THEN 'engineer' WHEN 'purchase' THEN 'analyst'
                      WHEN 'error' THEN 'ghost' ELSE 'user' END AS role,
                      CASE WHEN (props->>'$.k')::BIGINT < 50 THEN 'can_monitor' ELSE 'can_use_models' END AS permission FROM events)
       SELECT event_id FROM asked WHERE (role IN ('admin', 'engineer', 'analyst') AND permission = 'can_monitor')
              OR (role = 'user' AND permission = 'can_use_models')""",
)
def _(t):
    kind = F.col("event_type")
    role = F.when(kind == "click", "admin").when(kind == "view", "engineer").when(kind == "purchase", "analyst").when(
        kind == "error", "ghost"
    )
    asked = F.when(F.get_json_object("props", "$.k").cast("bigint") < 50, "can_monitor").otherwise("can_use_models")
    return audit.authorized(t.events, role, asked).select("event_id")


@query(
    "unrevoked_events",
    """SELECT event_id, user_id FROM events WHERE user_id NOT IN (
        SELECT c_custkey FROM customer WHERE TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * c_nationkey > TIMESTAMP '2024-01-15')""",
)
def _(t):
    days = F.make_dt_interval(F.col("c_nationkey"))
    listed = t.customer.select(F.col("c_custkey").alias("user_id"), (F.lit("2024-01-01").cast("timestamp") + days).alias("exp"))
    return audit.unrevoked(t.events.select("event_id", "user_id"), listed, "user_id", "2024-01-15")


LOCKOUT = """a AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed,
               SUM((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
        FROM events WHERE event_type IN ('error', 'signup')),
    s AS (SELECT *, SUM(failed::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS consecutive_failures FROM a)"""


@query(
    "failed_attempt_lockout",
    f"""WITH {LOCKOUT} SELECT event_id, user_id, consecutive_failures, consecutive_failures >= 3 AS locked,
        CASE WHEN consecutive_failures >= 3 THEN strftime(ts + INTERVAL 300 SECONDS, {ISO}) END AS locked_until FROM s""",
)
def _(t):
    tries = t.events.filter(F.col("event_type").isin("error", "signup")).select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    out = audit.lockout(tries, "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "error")
    return out.select("event_id", "user_id", "consecutive_failures", "locked", iso_text(F.col("locked_until")).alias("locked_until"))
