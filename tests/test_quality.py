import json
import json
import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import quality
from blockloom.schemas import DOCUMENT

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1)


def tx(**changes):
    return {"hash": "0x", "from": "a", "to": "b", "value": 1.0, **changes}


def block(number=1000, **changes):
    return {"number": number, "hash": "0x1", "timestamp": T0, "transactions": [tx()], **changes}


def document(blocks, **changes):
    return {"timestamp": "2024-01-01T00:00:00", "blocks": blocks, "metrics": {"block_count": 1}, "transaction_metrics": None, **changes}


def frame(spark, *documents):
    def plain(d):
        d = dict(d)
        if d["blocks"] is not None:
            d["blocks"] = [
                None if b is None else (b["number"], b["hash"], b["timestamp"], [(t["hash"], t["from"], t["to"], t["value"]) for t in b["transactions"]])
                for b in d["blocks"]
            ]
        d["metrics"] = tuple(d["metrics"].values()) if d["metrics"] else None
        d["transaction_metrics"] = tuple(d["transaction_metrics"].values()) if d["transaction_metrics"] else None
        return tuple(d[k] for k in ("timestamp", "blocks", "metrics", "transaction_metrics"))

    return spark.createDataFrame([(i, *plain(d)) for i, d in enumerate(documents)], "id long," + DOCUMENT)


def gates(spark, *documents):
    measured = quality.measure(frame(spark, *documents))
    return [r[1] for r in rows(measured.select("id", quality.gate()))]


GOOD = document([block(1000), block(1001, timestamp=T1)], transaction_metrics={"total_transactions": 2})


def test_good_document(spark):
    measured = quality.measure(frame(spark, GOOD))
    row = measured.select("*", quality.gate().alias("ok"), quality.score().alias("score"), quality.block_completeness().alias("c")).first()
    assert row["ok"] and row["score"] == 100.0 and row["c"] == 100.0
    # 4 top fields, 1 + 1 nested, 2 blocks of 4 and 2 transactions of 4
    assert (row["missing_count"], row["missing_total"], row["total_records"]) == (0, 22, 2)


def test_failing_documents(spark):
    assert gates(
        spark,
        document([block(1000), block(1002)]),
        document([block(1000, timestamp=T1), block(1001)]),
        document([block()], transaction_metrics={"total_transactions": 5}),
        document([block(hash=None, number=None, timestamp=None, transactions=[tx(hash="", to=None)] * 3)]),
        document([block()], metrics=None),
        document([block()], timestamp=None),
        document([block(), None]),
        document(None),
        document([]),
        document([block(number=None), block(1001)]),
    ) == [False, False, False, False, False, False, False, False, True, False]


def test_missing_values_in_both_modes(spark):
    df = frame(
        spark,
        GOOD,
        document([block(hash="", transactions=[tx(to=None), tx(hash="", value=None)])], metrics=None),
        document([]),
        document(None),
    )
    typed = rows(quality.missing_values(df).select("id", "missing_count", "missing_total", "missing_percentage"))
    body = F.to_json(F.struct(*quality.FIELDS), {"ignoreNullFields": "false"})
    walked = rows(
        quality.missing_in_json(df.select("id", body.alias("body")), "body").select("id", "missing_count", "missing_total", "missing_percentage")
    )
    assert typed == walked
    assert [r[1:3] for r in typed] == [(0, 22), (6, 16), (1, 5), (2, 5)]


def test_absent_keys_are_no_fields(spark):
    texts = ['{"a":null,"b":{"c":"","d":[{"e":1},[{"f":null}],5]}}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    got = [tuple(r)[1:] for r in quality.missing_in_json(df, "body").collect()]
    assert got == [(2, 5, 40.0), (0, 0, 0.0)]


def test_json_that_is_no_object_has_no_fields(spark):
    texts = [None, "", "{", '{"a":', "[1]", '[{"a":null}]', "null", "3", '"x"', "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    assert [tuple(r)[1:] for r in quality.missing_in_json(df, "body").collect()] == [(0, 0, 0.0)] * len(texts)


def test_json_walk_equals_a_recursive_one(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, "", "x", 1.5, True][kind]
        if kind < 7:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(4))]

    def count(record):
        missing, total = sum(v in (None, "") for v in record.values()), len(record)
        for v in record.values():
            for inner in v if isinstance(v, list) else [v]:
                if isinstance(inner, dict):
                    more = count(inner)
                    missing, total = missing + more[0], total + more[1]
        return missing, total

    chain = None
    for _ in range(21):  # deeper than the first probe
        chain = {"a": chain, "b": [{"c": ""}]}
    records = [{f"k{i}": value(6) for i in range(5)} for _ in range(200)] + [chain]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, body string")
    got = {r["id"]: (r["missing_count"], r["missing_total"]) for r in quality.missing_in_json(df, "body").collect()}
    assert got == {i: count(r) for i, r in enumerate(records)}


def test_json_walk_needs_no_python_worker(spark):
    df = quality.missing_in_json(spark.createDataFrame([('{"a":1}',)], "body string"), "body")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_type_flags_of_json(spark):
    texts = ['{"timestamp":"t","blocks":[],"metrics":{}}', '{"timestamp":"t"}', '{"timestamp":1,"blocks":{},"metrics":"x"}', '{"blocks":null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")
    got = [r[2:] for r in rows(quality.type_flags_json(df, "body"))]
    assert got == [(True, True, True), (True, True, True), (False, False, False), (False, False, True)]


def test_completeness(spark):
    df = frame(spark, document([]), document([block(hash=None, transactions=[tx(to=None), tx()])]), document([block(transactions=[])]))
    got = [r[1:] for r in rows(df.select("id", quality.block_completeness(), quality.transaction_completeness()))]
    assert got == [(100.0, 100.0), (75.0, 87.5), (100.0, 100.0)]


def test_report(spark):
    bad = document([block(hash=None, number=None, transactions=[tx(hash=None, to=None)] * 2)], metrics=None)
    row = quality.quality_rows(frame(spark, bad), "load", "2024-02-01", "id").first()
    summary = row["report"]["summary"]
    assert summary["quality_score"] == row["score"] and summary["total_records"] == 1
    assert row["report"]["issues"][0].startswith("High percentage of missing values: ")
    assert row["report"]["issues"][1] == "Invalid data type for field: metrics_valid"
    assert len(row["report"]["recommendations"]) == 2


def test_alert_texts(spark):
    df = spark.createDataFrame([(60.0, 25.0, 95.0), (80.0, 20.0, 90.0), (None, None, 37.125)], "s double, m double, c double")
    got = [r[0] for r in df.select(quality.alert_texts(F.col("s"), F.col("m"))).collect()]
    assert got[0] == ["Low quality score: 60.00% (threshold: 80.0%)", "High percentage of missing values: 25.00% (threshold: 20.0%)"]
    assert got[1] == [] and got[2] == ["Low quality score: 0.00% (threshold: 80.0%)"]
    extra = [r[0] for r in df.select(quality.alert_texts(F.lit(90.0), F.lit(0.0), F.col("c"))).collect()]
    assert extra == [[], [], ["Low consistency: 37.12% (threshold: 90.0%)"]]


def test_checks_report(spark):
    checks = spark.createDataFrame([("load", "2024-01-02"), ("load", "2024-01-01"), ("extract", "2024-09-01")], "stage string, at string")
    assert rows(quality.checks_report(checks, "stage", "at")) == [(3, "load_2024-01-02", 2)]
    assert rows(quality.distinct_stages(checks, "stage")) == [("extract",), ("load",)]
    assert json.dumps(rows(quality.checks_report(checks.limit(0), "stage", "at"))) == "[[0, null, 0]]"


@pytest.mark.parametrize("missing,expected", [(10.0, 0), (10.5, 1)])
def test_issue_limit(spark, missing, expected):
    flags = {f: F.lit(True) for f in quality.TYPE_FLAGS}
    df = spark.range(1).withColumns({"missing_percentage": F.lit(missing), **flags})
    assert df.select(F.size(quality.issues()), F.size(quality.recommendations())).first() == (expected, expected)
