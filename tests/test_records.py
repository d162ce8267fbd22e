import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.functions import compress, crypto, scalars
from blockloom.functions.jsonkeys import has_keys
from blockloom.operators import records, validate
from blockloom.operators import transforms as tr
from blockloom.schemas import RECORD_FIELDS
from blockloom.session import work_dir
from blockloom.sources import committed
from blockloom.sources import payload


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")


def test_source_rules(spark):
    df = bodies(
        spark,
        '{"block_height":1,"transactions":[]}',
        '{"slot":1,"blockhash":"x","transactions":[]}',
        '{"slot":1,"transactions":[]}',
        "not json",
        None,
        '{"model":"m","predictions":[]}',
        '{"sensor_id":"s","timestamp":"t","readings":{}}',
        "{}",
    )
    got = rows(df.select("id", *[rule(F.col("body")).alias(name) for name, rule in validate.SOURCE_RULES.items()]))
    assert [r[1] for r in got] == [True, True, False, False, False, False, False, False]
    assert [r[0] for r in got if r[2]] == [5] and [r[0] for r in got if r[3]] == [6]
    assert [r[4] for r in got] == [True, True, True, True, False, True, True, False]


def prompt(**changes):
    record = {
        "prompt": "hi",
        "timestamp": "t",
        "model_version": "1",
        "parameters": {},
        "max_tokens": 5,
        "temperature": 1.0,
        "context_length": 100,
        "safety_settings": {"toxicity": 1, "hate_speech": 1, "violence": 1},
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


@pytest.mark.parametrize(
    "changes,valid",
    [
        ({}, True),
        ({"prompt": ""}, False),
        ({"prompt": "x" * 32000}, True),
        ({"prompt": "x" * 32001}, False),
        ({"temperature": 2.0}, True),
        ({"temperature": 2.1}, False),
        ({"temperature": 1}, False),
        ({"context_length": 128000}, True),
        ({"context_length": 128001}, False),
        ({"max_tokens": True}, True),
        ({"max_tokens": 1.5}, False),
        ({"safety_settings": {"toxicity": 1}}, False),
        ({"parameters": ...}, False),
        ({"prompt": None}, False),
    ],
)
def test_prompt_records(spark, changes, valid):
    out = validate.valid_record(bodies(spark, prompt(**changes)), "body", "llm_input")
    assert out.first()["valid"] is valid


def test_reasons_name_the_first_failing_field(spark):
    good = {"model_id": "m", "timestamp": "t", "latency": 1.5, "tokens_per_second": 2.0, "memory_usage": 3.0, "error_rate": 0.5}
    late = {**good, "latency": 1, "error_rate": "x"}
    lacking = {k: v for k, v in good.items() if k != "timestamp"}
    df = bodies(spark, *[json.dumps(r) for r in (good, late, lacking)], "broken")
    out = validate.field_reason(df, "body", RECORD_FIELDS["model_metrics"])
    assert [r["reason"] for r in out.orderBy("id").collect()] == [
        None,
        "invalid type: latency",
        "missing field: timestamp",
        "missing field: model_id",
    ]


def test_typed_reason(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "name string, score double")
    reason = validate.typed_field_reason(df, {"name": "str", "score": "float"})
    assert [r[0] for r in df.select(reason).collect()] == [None, "invalid type: name"]
    assert df.select(validate.typed_field_reason(df, {"score": "int"})).first()[0] == "invalid type: score"
    assert df.select(validate.typed_field_reason(df, {"gone": "int"})).first()[0] == "missing field: gone"


def test_gate(spark):
    good = bodies(spark, prompt(), prompt())
    assert validate.dataset_gate(good, "llm_input").first()["valid"]
    assert not validate.dataset_gate(good.union(bodies(spark, "{}")), "llm_input").first()["valid"]
    assert validate.dataset_gate(good.limit(0), "llm_input").first()["valid"]
    assert not validate.dataset_gate(good, "other").first()["valid"]


def test_sla(spark):
    df = spark.createDataFrame([("ok", 0.98, 50.0, 0.005), ("bad", 0.9, 100.0, 0.02)], "m string, accuracy double, latency double, error_rate double")
    limits = {"accuracy": ("min", 0.95), "latency": ("max", 100.0), "error_rate": ("max", 0.01)}
    assert [r[:2] for r in rows(validate.sla_violations(df, ["m"], limits))] == [("bad", "accuracy"), ("bad", "error_rate")]


def test_required_files(spark):
    df = spark.createDataFrame([("a", n) for n in validate.MODEL_FILES] + [("b", "config.json")], "dir string, name string")
    assert rows(validate.required_files(df)) == [("a", True), ("b", False)]


def test_unwrap_shapes(spark):
    df = bodies(spark, '[{"id":1},{"id":2}]', '{"data":[{"id":3}],"page":1}', '{"id":4}', "[]", '{"data":{"id":5}}')
    out = payload.unwrap(df).select("id", F.variant_get("item", "$.id", "int").alias("item"))
    assert rows(out) == [(0, 1), (0, 2), (1, 3), (2, 4), (4, 5)]


def test_unwrap_refuses_other_texts(spark):
    with pytest.raises(Exception, match="unexpected response"):
        payload.unwrap(bodies(spark, "5")).collect()
    assert payload.unwrap(bodies(spark, "5", "{}"), strict=False).count() == 1


def test_transforms_in_order(spark):
    known = tr.Transforms()
    known.register("add", lambda df: df.withColumn("v", F.col("v") + 1))
    known.register("double", lambda df: df.withColumn("v", F.col("v") * 2))
    known.register_record_function("text", lambda r: {"v": r["v"], "t": f"n{r['v']}"}, "v long, t string")
    df = spark.createDataFrame([(1,), (2,)], "v long")
    assert rows(known.apply(df, ["add", "double", "text"])) == [(4, "n4"), (6, "n6")]
    assert rows(known.apply(df, ["double", "add"])) == [(3,), (5,)]
    with pytest.raises(ValueError):
        known.apply(df, ["missing"])


def test_record_functions_keep_large_integers_beside_nulls(spark):
    known = tr.Transforms()
    known.register_record_function("same", lambda r: r, "v long, x double")
    df = spark.createDataFrame([(9007199254740993, 1.5), (None, None)], "v long, x double").coalesce(1)
    assert set(map(tuple, known.apply(df, ["same"]).collect())) == {(9007199254740993, 1.5), (None, None)}


def test_steps_need_permission(spark):
    steps = tr.ProcessingSteps().add(lambda df: df).add(lambda df: df.limit(1), requires_auth=True)
    df = spark.range(3)
    assert steps.run(df, authorized=True).count() == 1
    with pytest.raises(PermissionError):
        steps.run(df, authorized=False)


def test_extract_binds_parameters(spark):
    source = spark.createDataFrame([(1, 100), (2, 200)], "id long, value long")
    got = tr.extract(spark, "SELECT * FROM source_rows WHERE value > :min_value", {"min_value": 150}, source_rows=source)
    assert rows(got) == [(2, 200)]


def test_load_is_all_or_nothing(spark):
    path = work_dir(spark, "t")
    df = spark.createDataFrame([(1,), (-1,)], "v long")
    assert not tr.load_validated(df, F.col("v") > 0, path, "a")
    for _ in range(2):
        assert tr.load_validated(df.filter("v > 0"), F.col("v") > 0, path, "a")
    assert not tr.load_validated(df, F.col("v") > 0, path, "a")
    assert rows(committed.read(spark, path)) == [(1,)]
    kept, held = tr.split_valid(df.union(spark.sql("select cast(null as long)")), F.col("v") > 0)
    assert (kept.count(), held.count()) == (1, 2)


def test_batch_of_nothing(spark):
    path = work_dir(spark, "t")
    assert not tr.run_batch(spark.range(0), tr.Transforms(), [], F.lit(True), path, "a")
    assert not tr.run_batch(spark.range(9).filter("id > 9"), tr.Transforms(), [], F.lit(True), path, "a")
    assert committed.snapshot(spark, path) == []


def test_batch_twice_is_once(spark):
    path = work_dir(spark, "t")
    for _ in range(2):
        assert tr.run_batch(spark.range(5), tr.Transforms(), [], F.col("id") >= 0, path, "a")
    assert not tr.run_batch(spark.range(9), tr.Transforms(), [], F.col("id") > 0, path, "a")
    assert committed.read(spark, path).count() == 5


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("soon",)], "ts string")
    out = tr.normalize_timestamps(df, "ts", "2024-02-01")
    assert [r["ts"] for r in out.collect()] == [datetime(2024, 1, 2, 3, 4, 5), None]


def test_document_metrics(spark):
    schema = "id long, blocks array<struct<number: long, timestamp: timestamp, transactions: array<string>>>"
    df = spark.createDataFrame([(1, [(5, None, ["a", "b"]), (6, None, [])]), (2, [])], schema)
    out = records.transaction_metrics(records.block_metrics(df))
    got = [tuple(r) for r in out.orderBy("id").select("total_blocks", "block_numbers", "total_transactions", "avg_transactions_per_block").collect()]
    assert got == [(2, [5, 6], 2, 1.0), (0, [], 0, 0.0)]


def test_record_type_first_match_wins(spark):
    df = bodies(
        spark,
        '{"prompt":1,"parameters":2,"input":1,"output":1}',
        '{"response":1,"tokens":1}',
        '{"latency":1,"tokens_per_second":1}',
        '{"input":1,"output":1}',
        '{"prompt":1}',
    )
    got = [r[1] for r in rows(df.select("id", records.record_type(F.col("body"))))]
    assert got == ["llm_input", "llm_output", "model_metrics", "training_data", None]


def test_long_text_is_compressed_and_restored(spark):
    df = spark.createDataFrame([("x" * 1000,), ("y" * 1001,), (None,)], "t string")
    out = records.shape_text(df, "t")
    got = out.collect()
    assert [r["t_compressed"] for r in got] == [False, True, False]
    assert got[0]["t"] == "x" * 1000 and got[2]["t"] is None
    assert out.filter("t_compressed").select(compress.unzlib_hex("t")).first()[0] == "y" * 1001


def test_numeric_profile(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, None)], "latency double, error_rate double")
    assert rows(records.numeric_profile(df, "latency", "error_rate")) == [
        ("error_rate", 7.0, 0.0, 7.0, 7.0),
        ("latency", 2.0, pytest.approx(2**0.5), 1.0, 3.0),
    ]


def test_slot_block(spark):
    schema = """parentSlot long, blockhash string, previousBlockhash string, blockTime long, blockHeight long, rewards array<string>,
        transactions array<struct<transaction: struct<signatures: array<string>>, slot: long, meta: struct<err: string, fee: long>>>"""
    tx = [(((["s1", "s2"]),), 8, (None, 5)), (((["s3"]),), 8, ('{"e":1}', 6)), (((["s4"]),), 8, ("{}", 6))]
    df = spark.createDataFrame([(7, "b", "a", None, 1, None, tx), (8, "c", "b", 1704067200, 2, [], [])], schema)
    first, second = records.format_slot_block(df, "2024-05-01").orderBy("slot").collect()
    assert first["slot"] == 8 and first["timestamp"] == datetime(2024, 5, 1) and first["rewards"] == []
    assert [(t["signature"], t["status"]) for t in first["transactions"]] == [("s1", "success"), ("s3", "failed"), ("s4", "success")]
    assert second["timestamp"] == datetime(2024, 1, 1)
    details = records.transaction_details(df, 2).orderBy("parentSlot").first()["transaction_details"]
    assert [(d["signature"], d["success"]) for d in details] == [("s1", True), ("s3", False)]


def test_evm_hash_blocks(spark):
    df = spark.createDataFrame([(1704067200, [bytearray(b"\x01\xab")])], "timestamp long, transactions array<binary>")
    row = records.format_evm_hashes(df).first()
    assert row["transactions"] == ["01ab"] and row["timestamp"] == datetime(2024, 1, 1)


def test_keys_and_scalars(spark):
    one = spark.range(1)
    assert one.select(has_keys(F.lit('{"a":null}'), "a")).first()[0]
    assert one.select(scalars.first_truthy(F.lit(0), F.lit(4)), scalars.first_nonempty(F.lit(""), F.lit("x"))).first() == (4, "x")
    assert one.select(scalars.age_days(F.lit("2024-01-01 12:00:00").cast("timestamp"), "2024-01-03")).first()[0] == 1
    assert one.select(scalars.age_days(F.lit(None).cast("timestamp"), "2024-01-03")).first()[0] == 0
    assert one.select(scalars.file_suffix(F.lit("/a.b/C.JSON")), scalars.file_suffix(F.lit("/a.b/c"))).first() == (".json", "")
    assert one.select(scalars.join_url(F.lit("http://h/"), F.lit("/p"))).first()[0] == "http://h/p"
    empty = F.array().cast("array<int>")
    assert one.select(scalars.is_contiguous(empty), scalars.is_sorted(F.array(F.lit(1), F.lit(1)))).first() == (True, True)
    assert not one.select(scalars.is_contiguous(F.array(F.lit(1), F.lit(3)))).first()[0]


def test_encryption(spark):
    with pytest.raises(ValueError):
        crypto.key_column(spark, "nobody")
    a, b = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    df = spark.createDataFrame([("secret", [1, 2])], "s string, n array<int>")
    stored = df.select(crypto.encrypt_record(F.struct("s", "n"), a).alias("c"))
    assert json.loads(stored.select(crypto.decrypt(F.col("c"), a)).first()[0]) == {"s": "secret", "n": [1, 2]}
    assert stored.select(crypto.decrypt(F.col("c"), b)).first()[0] is None
    assert stored.select(crypto.decrypt(F.lit("????"), a)).first()[0] is None
