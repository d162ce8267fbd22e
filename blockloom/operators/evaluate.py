"""Evaluation of predictions, losses and latencies, and summaries of training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.scalars import ratio
from blockloom.operators.ordered import Running, exact_quantiles, scan


def pair_by_id(references: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Expected and generated values of the same example."""
    return references.join(predictions, key)


def classification_metrics(pairs: DataFrame, expected: str, generated: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; undefined values are 0.

    Rows shrink to confusion counts first; classes may be as many as there are distinct texts.
    """
    counts = pairs.groupBy(F.col(expected).alias("e"), F.col(generated).alias("g")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("e") == F.col("g"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("e").alias("c"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("g").alias("c"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")),
    )
    classes = counts.select(F.inline(sides)).groupBy("c").agg(
        *[F.sum(x).cast("double").alias(x) for x in ("support", "predicted", "hits")]
    )
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))

    def weighted(value: Column) -> Column:
        return ratio(F.sum(value * F.col("support")), F.sum("support"))

    return classes.agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def perplexity(losses: DataFrame, loss: Column, tokens: Column) -> DataFrame:
    """exp of the token-weighted mean loss; `tokens` excludes padding."""
    mean = F.try_divide(F.sum(loss * tokens).cast("double"), F.sum(tokens).cast("double"))
    return losses.agg(F.exp(mean).alias("perplexity"), mean.alias("avg_loss"))


def latency_percentiles(batches: DataFrame, duration: str, tokens: str) -> DataFrame:
    """Mean, p50, p90 and p99 duration, mean tokens per second over batches and the sample count."""
    spread = exact_quantiles(
        batches.select(duration), [], duration, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, moments=True
    ).select(F.col("mean").alias("avg_latency"), "p50", "p90", "p99", F.col("n").alias("samples"))
    rate = F.try_divide(F.col(tokens).cast("double"), F.col(duration).cast("double"))
    throughput = batches.agg(F.avg(rate).alias("avg_throughput"))
    both = spread.unionByName(throughput, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def evaluation_record(model: str, version: str, parts: dict[str, DataFrame], samples: int | Column, start: str, end: str) -> DataFrame:
    """Rows (evaluation_id, model, version, metric, name, value, samples, start, end, duration).

    `parts` maps 'accuracy', 'perplexity' or 'latency' to its one-row result.
    """
    rows = None
    for metric, frame in parts.items():
        if metric not in ("accuracy", "perplexity", "latency"):
            raise ValueError(f"unsupported metric: {metric}")
        cells = F.array(
            *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in frame.columns]
        )
        part = frame.select(F.lit(metric).alias("metric"), F.inline(cells))
        rows = part if rows is None else rows.unionByName(part)
    begun, done = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return rows.select(
        F.lit(f"{model}_{version}_{start}").alias("evaluation_id"),
        F.lit(model).alias("model_name"),
        F.lit(version).alias("version"),
        "metric",
        "name",
        "value",
        (samples if isinstance(samples, Column) else F.lit(samples)).cast("bigint").alias("samples_evaluated"),
        begun.alias("start_time"),
        done.alias("end_time"),
        (F.unix_timestamp(done) - F.unix_timestamp(begun)).cast("double").alias("duration_seconds"),
    )


def evaluation_results(evaluations: DataFrame, evaluation_id: str | None = None) -> DataFrame:
    """All stored evaluations, or one of them."""
    return evaluations if evaluation_id is None else evaluations.filter(F.col("evaluation_id") == evaluation_id)


def checkpoints(log: DataFrame, step: str, loss: str) -> DataFrame:
    """Log rows whose loss is strictly below every earlier one."""
    ran = scan(log, [], [step], [Running("_best", "min", F.col(loss), inclusive=False)])
    return ran.filter(F.col("_best").isNull() | (F.col(loss) < F.col("_best"))).drop("_best")


def epoch_summary(log: DataFrame, epoch: str, loss: Column) -> DataFrame:
    return log.groupBy(epoch).agg(
        F.count("*").alias("steps"), ratio(F.sum(loss), F.count(loss)).alias("mean_loss"), F.min(loss).cast("double").alias("best_loss")
    )


def training_summary(log: DataFrame, epoch: str, step: str, loss: str) -> DataFrame:
    """Epochs and steps done, best loss and the first step that reached it."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(step).alias("step")))
    return log.agg(
        F.count_distinct(epoch).alias("epochs"), F.count("*").alias("steps"), best.alias("best")
    ).select("epochs", "steps", F.col("best.loss").alias("best_loss"), F.col("best.step").alias("best_step"))
