"""Quality metrics, gate, score, report and alerts over nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import quality
from blockloom.plans.registry import query
from blockloom.plans.standins import EVENTS_AS_OF

DOCS = ("doc_lines", "doc_blocks", "doc_txs")

# Per document: counts of blocks and words, then the metrics of the measured document.
MEASURED = """
per_tx AS (SELECT doc_id, SUM((word = '')::INT * 2 + (length(word) <= 30)::INT) AS tx_missing,
                  SUM((word <> '')::INT * 0 + 3 + (receiver IS NOT NULL)::INT) AS tx_present,
                  COUNT(*) AS n_tx FROM doc_txs GROUP BY doc_id),
per_block AS (SELECT doc_id, COUNT(*) AS n_blocks, SUM((hash IS NULL)::INT) AS no_hash,
                     bool_and(COALESCE(number - p = 1, true)) AS seq, bool_and(COALESCE(ts >= q, true)) AS ord
              FROM (SELECT *, LAG(number) OVER w AS p, LAG(ts) OVER w AS q FROM doc_blocks
                    WINDOW w AS (PARTITION BY doc_id ORDER BY number)) GROUP BY doc_id),
base AS (SELECT d.doc_id, d.lang, COALESCE(n_blocks, 0)::BIGINT AS total_records, COALESCE(n_tx, 0)::BIGINT AS n_tx,
                COALESCE(no_hash, 0)::BIGINT AS no_hash, COALESCE(tx_present, 0)::BIGINT AS tx_present,
                COALESCE(seq, true) AS block_sequence_valid, COALESCE(ord, true) AS timestamps_valid,
                CASE WHEN d.lang = 'en' THEN true
                     ELSE COALESCE(n_tx, 0) = len(string_split(replace(d.text, chr(10), '. '), '. ')) END AS transaction_counts_match,
                ((d.lang = 'en')::INT + COALESCE(no_hash, 0) + COALESCE(tx_missing, 0))::BIGINT AS missing_count,
                (5 + (d.lang <> 'en')::INT + 4 * COALESCE(n_blocks, 0) + 4 * COALESCE(n_tx, 0))::BIGINT AS missing_total
         FROM documents d LEFT JOIN per_block b ON d.doc_id = b.doc_id LEFT JOIN per_tx x ON d.doc_id = x.doc_id),
pct AS (SELECT *, missing_count::DOUBLE / missing_total::DOUBLE * 100 AS missing_percentage FROM base),
measured AS (SELECT *, (100 - missing_percentage) * 0.4::DOUBLE + 100 * 0.3::DOUBLE
                    + (block_sequence_valid::INT + transaction_counts_match::INT + timestamps_valid::INT)::DOUBLE / 3 * 100 * 0.3::DOUBLE
                    AS score FROM pct)"""


def _measured(columns: str, where: str = "") -> str:
    return f"WITH {MEASURED} SELECT {columns} FROM measured {where}"


@query("dq_record_count", _measured("doc_id, total_records"), DOCS)
def _(t):
    return t.chain_documents.select("doc_id", quality.record_count().alias("total_records"))


_MISSING = ["doc_id", "missing_count", "missing_total", "missing_percentage"]


@query("dq_missing_values", _measured(", ".join(_MISSING)), DOCS)
def _(t):
    return quality.missing_values(t.chain_documents).select(*_MISSING)


@query("dq_missing_values_json", _measured(", ".join(_MISSING)), DOCS)
def _(t):
    body = F.to_json(F.struct(*quality.FIELDS), {"ignoreNullFields": "false"})
    return quality.missing_in_json(t.chain_documents.select("doc_id", body.alias("body")), "body").select(*_MISSING)


@query(
    "dq_type_flags",
    """SELECT doc_id, lang <> 'es' AS timestamp_valid, lang <> 'fr' AS blocks_valid, lang <> 'de' AS metrics_valid FROM documents""",
)
def _(t):
    docs = t.chain_documents
    body = F.concat(
        F.lit('{"timestamp":'),
        F.when(F.col("lang") == "es", "5").otherwise(F.concat(F.lit('"'), "timestamp", F.lit('"'))),
        F.lit(',"blocks":'),
        F.when(F.col("lang") == "fr", "{}").otherwise(F.to_json("blocks")),
        F.when(F.col("lang") == "en", "").otherwise(
            F.concat(F.lit(',"metrics":'), F.when(F.col("lang") == "de", '"text"').otherwise(F.to_json("metrics")))
        ),
        F.lit("}"),
    )
    return quality.type_flags_json(docs.select("doc_id", body.alias("body")), "body").drop("body")


def _flag_query(name: str, flag: str):
    @query(name, _measured(f"doc_id, {flag}"), DOCS)
    def _(t):
        return t.chain_documents.select("doc_id", quality.consistency_flags()[flag].alias(flag))


_flag_query("dq_block_sequence", "block_sequence_valid")
_flag_query("dq_tx_count_match", "transaction_counts_match")
_flag_query("dq_ts_order", "timestamps_valid")


@query(
    "dq_block_completeness",
    _measured(
        """doc_id, CASE WHEN total_records = 0 THEN 100
           ELSE (4 * total_records - no_hash)::DOUBLE / (4 * total_records)::DOUBLE * 100 END AS block_completeness"""
    ),
    DOCS,
)
def _(t):
    return t.chain_documents.select("doc_id", quality.block_completeness().alias("block_completeness"))


@query(
    "dq_tx_completeness",
    _measured(
        "doc_id, CASE WHEN n_tx = 0 THEN 100 ELSE tx_present::DOUBLE / (4 * n_tx)::DOUBLE * 100 END AS transaction_completeness"
    ),
    DOCS,
)
def _(t):
    return t.chain_documents.select("doc_id", quality.transaction_completeness().alias("transaction_completeness"))


@query(
    "dq_gate",
    _measured(
        "doc_id, missing_percentage <= 20 AND block_sequence_valid AND transaction_counts_match AND timestamps_valid AS passed"
    ),
    DOCS,
)
def _(t):
    return quality.measure(t.chain_documents).select("doc_id", quality.gate().alias("passed"))


@query("dq_score", _measured("doc_id, score"), DOCS)
def _(t):
    return quality.measure(t.chain_documents).select("doc_id", quality.score().alias("score"))


_ISSUE = "'High percentage of missing values: ' || missing_percentage::VARCHAR || '%'"


@query("dq_issues", _measured(f"doc_id, {_ISSUE} AS issue", "WHERE missing_percentage > 10"), DOCS)
def _(t):
    return quality.measure(t.chain_documents).select("doc_id", F.explode(quality.issues()).alias("issue"))


@query(
    "dq_recommendations",
    _measured("doc_id, 'Consider implementing data validation at source' AS recommendation", "WHERE missing_percentage > 10"),
    DOCS,
)
def _(t):
    return quality.measure(t.chain_documents).select(
        "doc_id", F.explode(quality.recommendations()).alias("recommendation")
    )


_ALERTS = f"""WITH {MEASURED}
    SELECT doc_id, 'Low quality score: ' || format('{{:.2f}}', score) || '% (threshold: 80.0%)' AS alert FROM measured WHERE score < 80
    UNION ALL
    SELECT doc_id, 'High percentage of missing values: ' || format('{{:.2f}}', missing_percentage) || '% (threshold: 20.0%)'
    FROM measured WHERE missing_percentage > 20"""


@query("dq_alerts", _ALERTS, DOCS)
def _(t):
    return quality.alerts(quality.measure(t.chain_documents), "doc_id")


@query(
    "alert_messages",
    """SELECT event_id, 'Low quality score: ' || format('{:.2f}', value) || '% (threshold: 80.0%)' AS alert FROM events WHERE value < 80
       UNION ALL SELECT event_id, 'High percentage of missing values: ' || format('{:.2f}', (props->>'$.k')::DOUBLE) || '% (threshold: 20.0%)'
       FROM events WHERE (props->>'$.k')::DOUBLE > 20""",
)
def _(t):
    texts = quality.alert_texts(F.col("value"), F.get_json_object("props", "$.k").cast("double"))
    return t.events.select("event_id", F.explode(texts).alias("alert"))


@query(
    "quality_table",
    _measured(
        f"""doc_id, '{EVENTS_AS_OF}' AS timestamp, 'transform' AS stage, score, score AS report_score, total_records,
            (missing_percentage > 10)::BIGINT AS n_issues"""
    ),
    DOCS,
)
def _(t):
    rows = quality.quality_rows(t.chain_documents, "transform", EVENTS_AS_OF, "doc_id")
    return rows.select(
        "doc_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "stage",
        "score",
        F.col("report.summary.quality_score").alias("report_score"),
        F.col("report.summary.total_records").alias("total_records"),
        F.size("report.issues").cast("bigint").alias("n_issues"),
    )


@query(
    "dq_report",
    """SELECT COUNT(*) AS total_checks, MAX(event_type || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS last_check,
              COUNT(DISTINCT event_type) AS stages_checked FROM events""",
)
def _(t):
    checks = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))
    return quality.checks_report(checks, "event_type", "at")


@query("distinct_stages", "SELECT DISTINCT event_type FROM events")
def _(t):
    return quality.distinct_stages(t.events, "event_type")
