"""Prompt de-duplication, tokenising, inference, evaluation and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions.scalars import iso_text
from blockloom.operators import evaluate, modelreg, textprep, transforms
from blockloom.plans.registry import query, rounded
from blockloom.plans.standins import EVENTS_AS_OF

ISO = "'%Y-%m-%d %H:%M:%S.%f'"

DEDUP = """
    h AS (SELECT ord, prompt, md5(prompt) AS hash, MIN(ord) OVER (PARTITION BY md5(prompt)) AS first FROM src),
    ids AS (SELECT hash, ROW_NUMBER() OVER (ORDER BY first) - 1 AS id FROM (SELECT DISTINCT hash, first FROM h))"""
_DOC_SRC = "src AS (SELECT doc_id AS ord, text AS prompt FROM documents)"


@query(
    "dedup_prompts",
    f"""WITH {_DOC_SRC}, {DEDUP}
    SELECT ord, CASE WHEN ord = first THEN prompt END AS prompt, CASE WHEN ord = first THEN id END AS id,
           CASE WHEN ord <> first THEN id END AS prompt_ref FROM h JOIN ids USING (hash)""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("ord"), F.col("text").alias("prompt"))
    return textprep.dedup_prompts(docs, "ord")


@query("resolve_prompt_ref", "SELECT doc_id AS ord, text AS prompt FROM documents")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("ord"), F.col("text").alias("prompt"))
    return textprep.resolve_prompt_refs(textprep.dedup_prompts(docs, "ord"))


@query(
    "prepare_pairs",
    "SELECT doc_id, text AS input, COALESCE(CASE WHEN lang <> 'en' THEN source END, text) AS target FROM documents",
)
def _(t):
    docs = t.documents.select(
        "doc_id", F.split("text", " ").alias("words"), F.when(F.col("lang") != "en", F.col("source")).alias("goal")
    )
    return textprep.prepare_pairs(docs, "words", "goal", keys=("doc_id",))


def _pairs(t):
    docs = t.documents.select("doc_id", "text", F.when(F.col("lang") != "en", F.col("source")).alias("goal"))
    return textprep.prepare_pairs(docs, "text", "goal", keys=("doc_id",))


def _ids(text: str) -> str:
    """The default tokenizer in SQL: at most 512 ids, padded with zeros."""
    words = f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')[1:512]"
    return f"list_resize([('0x' || substr(md5(w), 1, 15))::BIGINT + 1 FOR w IN {words}], 512, 0)"


@query(
    "tokenize_pad",
    f"""WITH i AS (SELECT doc_id, lang <> 'en' AND source <> '' AND source <> text AS differs, {_ids('text')} AS ids, {_ids('source')} AS goal
          FROM documents),
        l AS (SELECT *, CASE WHEN coalesce(differs, false) THEN goal ELSE ids END AS labels FROM i)
        SELECT doc_id, len(ids)::BIGINT AS n_ids, len(labels)::BIGINT AS n_labels, len(list_filter(ids, lambda x: x <> 0))::BIGINT AS n_tokens,
          array_to_string([CASE WHEN x <> 0 THEN 1 ELSE 0 END FOR x IN ids], '') AS mask, md5(array_to_string(ids, ',')) AS ids,
          md5(array_to_string(labels, ',')) AS labels FROM l""",
)
def _(t):
    tokens = textprep.tokenize_pad(_pairs(t))
    return tokens.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.size("labels").cast("bigint").alias("n_labels"),
        F.size(F.filter("input_ids", lambda i: i != 0)).cast("bigint").alias("n_tokens"),
        F.array_join("attention_mask", "").alias("mask"),
        F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids"),
        F.md5(F.array_join("labels", ",").cast("binary")).alias("labels"),
    )


@query(
    "loader_batches",
    """SELECT doc_id, (ROW_NUMBER() OVER (ORDER BY md5('7-' || doc_id), doc_id) - 1) // 8 AS batch_id FROM documents""",
)
def _(t):
    return textprep.loader_batches(t.documents.select("doc_id"), "doc_id", seed=7)


_BATCHED = """SELECT event_id, event_type, value,
    (ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 1000 AS batch_id FROM events"""


@query("assign_batches", f"SELECT event_id, event_type, batch_id FROM ({_BATCHED})")
def _(t):
    source = t.events.select("event_id", "event_type", "ts")
    return textprep.assign_batches(source, ["event_type"], ["ts", "event_id"], 1000).drop("ts")


_OUTCOMES = f"""o AS (SELECT event_type, batch_id, COUNT(*) AS n_rows, bool_and(value > 0.05) AS succeeded
                FROM ({_BATCHED}) GROUP BY ALL)"""


def _outcomes(t):
    source = t.events.select("event_id", "event_type", "ts", "value")
    batches = textprep.assign_batches(source, ["event_type"], ["ts", "event_id"], 1000)
    tagged = batches.withColumn("batch", F.concat_ws("/", "event_type", F.col("batch_id").cast("string")))
    return transforms.batch_outcomes(tagged, "batch", F.col("value") > 0.05)


@query("batch_outcomes", f"WITH {_OUTCOMES} SELECT event_type || '/' || batch_id AS batch, n_rows, succeeded FROM o")
def _(t):
    return _outcomes(t)


@query(
    "load_summary",
    f"""WITH {_OUTCOMES} SELECT COUNT(*) AS batches, COUNT(*) FILTER (NOT succeeded) AS failed_batches,
        COALESCE(SUM(n_rows) FILTER (succeeded), 0)::BIGINT AS loaded_rows, bool_and(succeeded) AS success FROM o""",
)
def _(t):
    return transforms.load_summary(_outcomes(t))


@query(
    "batch_infer",
    """SELECT ord, prompt, array_to_string(list_reverse(string_split(prompt, ' ')), ' ') AS generated, len(string_split(prompt, ' ')) AS tokens,
              CASE WHEN len(string_split(prompt, ' ')) >= 20 THEN 'length' ELSE 'stop' END AS finish_reason FROM prompts""",
    ("prompts",),
)
def _(t):
    def generate(prompts):  # stands in for a model
        return [(" ".join(reversed(p.split(" "))), len(p.split(" "))) for p in prompts]

    return textprep.batch_infer(t.prompts, "prompt", generate, max_length=20)


PAIRS = """pairs AS (SELECT l.quality::VARCHAR AS expected, CASE WHEN d.n_chars > 400 THEN '1' ELSE '0' END AS generated
                     FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT c, SUM(s)::DOUBLE AS support, SUM(p)::DOUBLE AS predicted, SUM(h)::DOUBLE AS hits FROM (
        SELECT expected AS c, 1 AS s, 0 AS p, (expected = generated)::INT AS h FROM pairs
        UNION ALL SELECT generated, 0, 1, 0 FROM pairs) GROUP BY c),
    scored AS (SELECT *, COALESCE(hits / NULLIF(predicted, 0), 0) AS pr, COALESCE(hits / NULLIF(support, 0), 0) AS rc,
                      COALESCE(2 * hits / NULLIF(predicted + support, 0), 0) AS f FROM c)"""
ACCURACY = """SELECT round(SUM(hits) / SUM(support), 6) AS accuracy, round(SUM(pr * support) / SUM(support), 6) AS precision,
    round(SUM(rc * support) / SUM(support), 6) AS recall, round(SUM(f * support) / SUM(support), 6) AS f1 FROM scored"""


def _accuracy(t):
    truth = t.labels.select("doc_id", F.col("quality").cast("string").alias("expected"))
    guess = t.documents.select("doc_id", F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("generated"))
    out = evaluate.classification_metrics(evaluate.pair_by_id(truth, guess, "doc_id"), "expected", "generated")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _losses(t):
    return evaluate.perplexity(t.requests, F.col("latency") / 100, F.col("tokens"))


def _latency(t):
    return evaluate.latency_percentiles(t.requests, "latency", "tokens")


LOSS = "SUM(latency * tokens) / 100 / SUM(tokens)"
LATENCY = """SELECT SUM(latency) / COUNT(*) AS avg_latency, quantile_cont(latency, 0.5) AS p50,
    quantile_cont(latency, 0.9) AS p90, quantile_cont(latency, 0.99) AS p99, COUNT(*) AS samples,
    AVG(tokens / NULLIF(latency, 0)) AS avg_throughput FROM requests"""


@query("classification_metrics", f"WITH {PAIRS} {ACCURACY}")
def _(t):
    return _accuracy(t)


@query("perplexity", f"SELECT round(exp({LOSS}), 6) AS perplexity, round({LOSS}, 6) AS avg_loss FROM requests", ("requests",))
def _(t):
    return _losses(t).select(F.round("perplexity", 6).alias("perplexity"), F.round("avg_loss", 6).alias("avg_loss"))


@query(
    "latency_percentiles",
    f"""SELECT round(avg_latency, 6) AS avg_latency, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, samples,
        round(avg_throughput, 6) AS avg_throughput FROM ({LATENCY})""",
    ("requests",),
)
def _(t):
    out = _latency(t)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_latency", "p50", "p90", "p99", "avg_throughput")})


@query(
    "evaluation_summary",
    f"""WITH {PAIRS}, a AS ({ACCURACY}), l AS (SELECT * FROM ({LATENCY})),
    p AS (SELECT exp({LOSS}) AS perplexity, {LOSS} AS avg_loss FROM requests),
    long AS (
        SELECT 'accuracy' AS metric, UNNEST(['accuracy','precision','recall','f1']) AS name,
               UNNEST([accuracy, precision, recall, f1]) AS value FROM a
        UNION ALL SELECT 'perplexity', UNNEST(['perplexity','avg_loss']), UNNEST([perplexity, avg_loss]) FROM p
        UNION ALL SELECT 'latency', UNNEST(['avg_latency','p50','p90','p99','samples','avg_throughput']),
               UNNEST([avg_latency, p50, p90, p99, samples::DOUBLE, avg_throughput]) FROM l)
    SELECT 'm_1.0_{EVENTS_AS_OF}' AS evaluation_id, 'm' AS model_name, '1.0' AS version, metric, name, round(value, 6) AS value,
           100::BIGINT AS samples_evaluated, '{EVENTS_AS_OF}.000000' AS start_time, '2024-01-31 00:01:30.000000' AS end_time,
           90::DOUBLE AS duration_seconds FROM long""",
    ("requests",),
)
def _(t):
    parts = {"accuracy": _accuracy(t), "perplexity": _losses(t), "latency": _latency(t)}
    rows = evaluate.evaluation_record("m", "1.0", parts, 100, EVENTS_AS_OF, "2024-01-31 00:01:30")
    rows = evaluate.evaluation_results(rows, f"m_1.0_{EVENTS_AS_OF}")
    return rows.withColumns(
        {"value": F.round("value", 6), "start_time": iso_text(F.col("start_time")), "end_time": iso_text(F.col("end_time"))}
    )


@query(
    "training_log_summary",
    """SELECT strftime(ts, '%Y-%m-%d') AS epoch, COUNT(*) AS steps, round(SUM(value) / COUNT(*), 9) AS mean_loss,
              MIN(value) AS best_loss FROM events GROUP BY 1""",
)
def _(t):
    log = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "value")
    return rounded(evaluate.epoch_summary(log, "epoch", F.col("value")), "mean_loss", digits=9)


@query(
    "training_checkpoints",
    """SELECT step, loss FROM (SELECT event_id AS step, value AS loss,
              MIN(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
       WHERE best IS NULL OR loss < best""",
)
def _(t):
    return evaluate.checkpoints(t.events.select(F.col("event_id").alias("step"), F.col("value").alias("loss")), "step", "loss")


@query(
    "training_progress",
    """SELECT COUNT(DISTINCT ts::DATE) AS epochs, COUNT(*) AS steps, MIN(value) AS best_loss,
              (SELECT MIN(event_id) FROM events WHERE value = (SELECT MIN(value) FROM events)) AS best_step FROM events""",
)
def _(t):
    log = t.events.select(F.to_date("ts").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return evaluate.training_summary(log, "epoch", "step", "loss")


def _models(t):
    return t.part.select(
        F.col("p_brand").alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("version"),
        F.col("p_name").alias("path"),
    )


MODELS = "models AS (SELECT p_brand AS name, p_size || '.' || p_partkey AS version, p_name AS path FROM part)"


@query(
    "list_models",
    """SELECT p_brand AS name, 'v' || p_size AS version, p_name AS path, p_type AS status FROM part
       UNION ALL SELECT p_brand, 'w' || p_size, p_name, 'old' FROM part""",
)
def _(t):
    def info(status):
        return F.struct(F.col("p_name").alias("path"), status.alias("status"))

    size = F.col("p_size").cast("string")
    versions = F.create_map(
        F.concat(F.lit("v"), size), info(F.col("p_type")), F.concat(F.lit("w"), size), info(F.lit("old"))
    )
    return modelreg.flatten_registry(t.part.select(F.create_map("p_brand", versions).alias("registry")))


@query(
    "registry_upsert",
    f"""WITH {MODELS}
    SELECT name, version, CASE WHEN version LIKE '1%' THEN path || '/new' ELSE path END AS path,
           CASE WHEN version LIKE '1%' THEN sha256(path || '/new') ELSE 'h' END AS hash,
           CASE WHEN version LIKE '1%' THEN '{EVENTS_AS_OF}.000000' ELSE '2020-01-01 00:00:00.000000' END AS registered_at,
           CASE WHEN version LIKE '1%' THEN 'registered' ELSE 'old' END AS status FROM models""",
)
def _(t):
    models = _models(t)
    existing = models.withColumns(
        {
            "hash": F.lit("h"),
            "registered_at": F.lit("2020-01-01").cast("timestamp"),
            "status": F.lit("old"),
        }
    )
    incoming = models.filter(F.col("version").startswith("1")).withColumn("path", F.concat("path", F.lit("/new")))
    out = modelreg.register(existing, incoming, F.col("path"), EVENTS_AS_OF)
    return out.withColumn("registered_at", iso_text(F.col("registered_at")))


@query(
    "latest_model_version",
    f"WITH {MODELS} SELECT name, MAX(version) AS version, arg_max(path, version) AS path FROM models GROUP BY name",
)
def _(t):
    return modelreg.latest_version(_models(t))


@query(
    "latest_model_version_semantic",
    f"""WITH {MODELS}, r AS (SELECT *, list_transform(string_split(version, '.'), lambda x: x::BIGINT) AS k FROM models)
    SELECT name, arg_max(version, k) AS version, arg_max(path, k) AS path FROM r GROUP BY name""",
)
def _(t):
    return modelreg.latest_version(_models(t), semantic=True)


@query(
    "latest_per_key",
    f"""SELECT user_id, event_id, strftime(ts, {ISO}) AS ts, value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    newest = modelreg.latest_per_key(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])
    return newest.withColumn("ts", iso_text(F.col("ts")))
