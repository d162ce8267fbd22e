import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.operators import evaluate, modelreg, textprep, transforms

PROMPTS = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "a"), (7, None)]


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(PROMPTS, "ord long, prompt string")


def test_dedup_and_resolve(prompts):
    out = textprep.dedup_prompts(prompts, "ord").select("ord", "prompt", "id", "prompt_ref")
    assert rows(out) == [
        (1, "a", 0, None),
        (2, "b", 1, None),
        (3, None, None, 0),
        (4, "c", 2, None),
        (5, None, None, 1),
        (6, None, None, 0),
        (7, None, None, None),
    ]
    assert rows(textprep.resolve_prompt_refs(out).select("ord", "prompt")) == sorted(PROMPTS, key=repr)


def test_dedup_with_one_hot_prompt(spark):
    df = spark.range(2000).select(
        F.col("id").alias("ord"), F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("prompt")
    )
    out = textprep.dedup_prompts(df, "ord")
    assert out.filter("prompt_ref = 0").count() == 1499
    assert sorted(r[0] for r in out.filter("id is not null").select("id").collect()) == list(range(501))


def test_pairs(spark):
    df = spark.createDataFrame([(1, ["x", "y"], None), (2, None, "t"), (3, ["z"], "t")], "k long, words array<string>, goal string")
    assert rows(textprep.prepare_pairs(df, "words", "goal", ("k",))) == [(1, "x y", "x y"), (3, "z", "t")]
    assert rows(textprep.prepare_pairs(df, "words", "absent", ("k",))) == [(1, "x y", "x y"), (3, "z", "z")]


def test_tokens_are_cut_and_padded(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("a", "b a"), ("", "")], "input string, target string")
    got = textprep.tokenize_pad(df, max_length=4).collect()
    assert [len(r["input_ids"]) for r in got] == [4, 4, 4]
    assert [r["attention_mask"] for r in got] == [[1, 1, 1, 1], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert got[0]["labels"] == got[0]["input_ids"] and 0 not in got[0]["input_ids"]
    assert got[1]["labels"][1] == got[1]["input_ids"][0] == got[0]["input_ids"][0]
    assert got[2]["input_ids"] == [0, 0, 0, 0]


def test_own_tokenizer(spark):
    df = spark.createDataFrame([("abc", "abc"), ("z", "z")], "input string, target string")
    codes = textprep.batched_tokenizer(lambda texts: [[ord(c) for c in t] for t in texts])
    got = textprep.tokenize_pad(df, max_length=2, tokenizer=codes).collect()
    assert [r["input_ids"] for r in got] == [[97, 98], [122, 0]]


def test_batches(spark):
    df = spark.range(21).withColumnRenamed("id", "k")
    shuffled = textprep.loader_batches(df, "k", seed=1)
    assert sorted(r[1] for r in rows(shuffled.groupBy("batch_id").count())) == [5, 8, 8]
    again = textprep.loader_batches(df, "k", seed=1)
    assert rows(shuffled) == rows(again) != rows(textprep.loader_batches(df, "k", seed=2))
    plain = dict(rows(textprep.loader_batches(df, "k", shuffle=False)))
    assert plain[7] == 0 and plain[8] == 1
    five = textprep.assign_batches(spark.range(5), [], ["id"], 2)
    assert [r[1] for r in rows(five)] == [0, 0, 1, 1, 2]


def test_outcomes(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("b", True)], "batch string, ok boolean")
    out = transforms.batch_outcomes(df, "batch", F.col("ok"))
    assert rows(out) == [("a", 2, True), ("b", 2, False)]
    assert rows(transforms.load_summary(out)) == [(2, 1, 2, False)]


def test_inference_answers_each_prompt_once(spark, prompts):
    calls = spark.sparkContext.accumulator(0)

    def generate(texts):
        assert len(texts) <= 2
        calls.add(len(texts))
        return [(t * 3, len(t) * 3) for t in texts]

    df = prompts.union(spark.createDataFrame([(8, "long")], "ord long, prompt string"))
    out = textprep.batch_infer(df, "prompt", generate, max_length=12, batch_size=2)
    got = {r["ord"]: (r["generated"], r["tokens"], r["finish_reason"]) for r in out.collect()}
    assert got[3] == ("aaa", 3, "stop") and got[8] == ("longlonglong", 12, "length") and got[7] == (None, None, None)
    assert calls.value == 4


def test_classification(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "e string, g string")
    row = evaluate.classification_metrics(df, "e", "g").first()
    # a: p 1, r 1/2, f 2/3; b: p 1/2, r 1, f 2/3; c: all 0
    assert tuple(row) == pytest.approx((0.5, (2 * 1 + 0.5) / 4, (2 * 0.5 + 1) / 4, (2 * 2 / 3 + 2 / 3) / 4))
    perfect = spark.createDataFrame([("x", "x"), ("y", "y")], "e string, g string")
    assert tuple(evaluate.classification_metrics(perfect, "e", "g").first()) == (1.0, 1.0, 1.0, 1.0)


def test_perplexity_and_latency(spark):
    df = spark.createDataFrame([(1.0, 10, 1.0), (2.0, 30, 2.0), (4.0, 0, 0.0)], "loss double, tokens long, seconds double")
    row = evaluate.perplexity(df, F.col("loss"), F.col("tokens")).first()
    assert tuple(row) == pytest.approx((math.exp(1.75), 1.75))
    lat = evaluate.latency_percentiles(df, "seconds", "tokens").first()
    assert (lat["avg_latency"], lat["p50"], lat["samples"], lat["avg_throughput"]) == (1.0, 1.0, 3, 12.5)


def test_evaluation_record(spark):
    part = spark.createDataFrame([(1.0, 2.0)], "perplexity double, avg_loss double")
    out = evaluate.evaluation_record("m", "1", {"perplexity": part}, 5, "2024-01-01 00:00:00", "2024-01-01 00:00:30")
    assert out.count() == 2 and out.first()["duration_seconds"] == 30.0
    assert evaluate.evaluation_results(out, "other").count() == 0 and evaluate.evaluation_results(out).count() == 2
    with pytest.raises(ValueError):
        evaluate.evaluation_record("m", "1", {"speed": part}, 5, "2024-01-01", "2024-01-01")


def test_training_log(spark):
    log = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 3, 3.0), (2, 4, 4.0), (3, 5, 2.0)], "epoch long, step long, loss double")
    assert [r["step"] for r in evaluate.checkpoints(log, "step", "loss").orderBy("step").collect()] == [1, 3, 5]
    assert rows(evaluate.epoch_summary(log, "epoch", F.col("loss")))[0] == (1, 2, 5.0, 5.0)
    assert rows(evaluate.training_summary(log, "epoch", "step", "loss")) == [(3, 5, 2.0, 5)]


def test_registry(spark):
    models = spark.createDataFrame([("m", "9.0", "p9"), ("m", "10.0", "p10"), ("n", "1.0", "q")], "name string, version string, path string")
    assert dict((r[0], r[1]) for r in rows(modelreg.latest_version(models))) == {"m": "9.0", "n": "1.0"}
    assert dict((r[0], r[1]) for r in rows(modelreg.latest_version(models, semantic=True))) == {"m": "10.0", "n": "1.0"}
    none = modelreg.register(
        spark.createDataFrame([], "name string, version string, path string, hash string, registered_at timestamp, status string"),
        models,
        F.col("path"),
        "2024-01-01",
    )
    assert none.count() == 3 and {r["status"] for r in none.collect()} == {"registered"}
    changed = models.filter("version = '9.0'").withColumn("path", F.lit("new"))
    again = modelreg.register(none, changed, F.col("path"), "2024-02-01")
    before, after = {r["version"]: r["hash"] for r in none.collect()}, {r["version"]: r["hash"] for r in again.collect()}
    assert again.count() == 3 and before["9.0"] != after["9.0"] and before["10.0"] == after["10.0"]


def test_flatten_and_latest_per_key(spark):
    nested = spark.sql("select map('m', map('1', named_struct('path', 'p'), '2', named_struct('path', 'q'))) as registry")
    assert rows(modelreg.flatten_registry(nested)) == [("m", "1", "p"), ("m", "2", "q")]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, ts long, v string")
    assert rows(modelreg.latest_per_key(df, ["k"], ["ts"])) == [("a", 2, "y"), ("b", 1, None)]
