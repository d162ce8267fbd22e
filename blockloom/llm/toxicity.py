"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's severity grade is one of 0..K. The model has one weight per feature, shared by all grades,
and K rising thresholds: P(grade > k) = sigmoid(score - threshold_k). The expected severity is the
sum of these probabilities. Features are the distinct words of the lower-cased text and the beginnings
of these words, hashed to a fixed number of buckets. The score is a plain sum over words, so a few harsh
words in a long text weigh as much as in a short one.

The fit sees a bounded sample of labelled ids, chosen by a hash of the id: `SAMPLE` at most. Tasks count
in how many sampled texts above each threshold a bucket occurs, and every bucket that at some threshold speaks for
or against a higher grade well beyond chance is fitted. Scoring runs over every document and the whole of each
text, next to the weights.

Null text counts as empty and scores like a text without known words. Labels with a null id or grade
are left out of the fit; an id with several labels has the highest, and one with several texts the last by
code point. Without labels of two different grades the model is constant: the lowest grade seen, or zero.
Rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted, slices
from blockloom.session import written

BUCKETS = 1 << 20
SAMPLE = 20_000
LEAST_DOCS, LEAST_Z = 5, 5.0
PREFIXES = (3, 4, 5, 6, 7)  # characters
L1, ROUNDS, STEP = 2e-4, 500, 0.5
CACHED_WORDS = 1 << 19  # remembered buckets per task; a full cache is emptied
_WORDS = re.compile(r"\w+").findall


class OrdinalModel(NamedTuple):
    """Weights by bucket (those that are not zero), rising thresholds and the lowest grade."""

    weights: dict[int, float]
    thresholds: list[float]
    base: int


def buckets(word: str) -> list[int]:
    """The buckets of a word and of its beginnings; a beginning's hash never meets that of a word."""
    from zlib import crc32

    starts = [word[:n] + "\x00" for n in PREFIXES if len(word) > n]
    return [crc32(part.encode()) % BUCKETS for part in (word, *starts)]


def features(text: str | None) -> list[int]:
    """The buckets of every distinct word, as often as distinct words share one."""
    return sorted(b for word in words(text) for b in buckets(word))


def words(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """The cumulative-link model of documents given as bucket arrays.

    Proximal gradient descent with momentum on the mean log-loss of all thresholds, with an L1 penalty that
    leaves words without a signal at zero.
    """
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return OrdinalModel({}, [], levels[0] if levels else 0)
    used, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    passed = np.stack([(grades > level).astype(float) for level in levels[:-1]], 1)
    share = passed.mean(0)
    thresholds = np.log((1 - share) / share)
    # Steps per feature follow its frequency, so that rare words are learned as fast as common ones.
    count = np.bincount(flat, minlength=len(used)).astype(float)
    curve = (count / len(rows)) * len(share) / 4 + 1e-3
    weights = np.zeros(len(used))
    ahead = weights.copy()
    for round_ in range(ROUNDS):
        score = np.bincount(owner, ahead[flat], minlength=len(rows))
        error = _sigmoid(score[:, None] - thresholds) - passed
        slope = np.bincount(flat, error.sum(1)[owner], minlength=len(used)) / len(rows)
        step = STEP / (curve * 8)
        moved = ahead - step * slope
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
        ahead = fresh + round_ / (round_ + 3) * (fresh - weights)
        weights = fresh
        thresholds = np.maximum.accumulate(thresholds + STEP * 2 * error.mean(0))
    kept = np.flatnonzero(weights)
    return OrdinalModel(
        dict(zip(used[kept].tolist(), weights[kept].tolist(), strict=True)), thresholds.tolist(), levels[0]
    )


def scorer(model: OrdinalModel) -> Callable[[str | None], tuple[float, int]]:
    """A function from text to expected severity and likeliest grade."""
    weight_of: dict[str, float] = {}
    weights, limits = model.weights, np.array(model.thresholds)

    def score(text: str | None) -> tuple[float, int]:
        found = words(text)
        for word in found.difference(weight_of):
            weight_of[word] = sum(weights.get(b, 0.0) for b in buckets(word))
        total = sum(map(weight_of.__getitem__, found))
        if len(weight_of) > CACHED_WORDS:
            weight_of.clear()
        above = _sigmoid(total - limits)
        chances = np.concatenate([[1.0], above]) - np.concatenate([above, [0.0]])
        return model.base + float(above.sum()), model.base + int(chances.argmax())

    return score


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(grade, text) of the sampled ids, written once."""
    graded = labels.select(quoted("doc_id").alias("id"), quoted("grade").cast("int").alias("grade")).dropna()
    graded = graded.groupBy("id").agg(F.max("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(quoted("doc_id").alias("id"), F.coalesce(quoted("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # `sample` rows of two numbers
    return written(found.groupBy("id", "grade").agg(F.max("text").alias("text")).select("grade", "text"), "sampled")


def screened(sampled: DataFrame) -> list[int]:
    """The buckets that tell the grades above some threshold from those below it, in either direction."""
    found = {r[0]: r[1] for r in sampled.groupBy("grade").count().collect()}
    levels, total = sorted(found), sum(found.values())
    if len(levels) < 2:
        return []
    names = [f"above{k}" for k in range(len(levels) - 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(features(t)).astype(np.int64) for t in batch.column(1).to_pylist()]
            grades = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            used, at = np.unique(np.concatenate(found), return_inverse=True)
            above = [np.bincount(at, grades > level, len(used)).astype(np.int64) for level in levels[:-1]]
            columns = [used, np.bincount(at, minlength=len(used)), *above]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["bucket", "n", *names])

    kinds = ", ".join(f"{c} long" for c in ("bucket", "n", *names))
    counts = sampled.mapInArrow(count, kinds).groupBy("bucket")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("n", *names)]).filter(F.col("n") >= LEAST_DOCS)
    clear = F.lit(False)
    for k, name in enumerate(names):
        share = sum(found[level] for level in levels[k + 1 :]) / total
        z = (F.col(name) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        clear |= F.abs(z) >= LEAST_Z
    return [r[0] for r in counts.filter(clear).select("bucket").collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` ids of `labels` (doc_id, grade) and their texts in `docs` (doc_id, text).

    Tasks turn the sampled texts into bucket numbers; only screened ones reach the driver.
    """
    sampled = _sampled(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(screened(sampled)), np.int64))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.array(features(t), np.int64) for t in batch.column(1).to_pylist()]
            found = [f[np.isin(f, shared.value)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "buckets"]
            )

    got = sampled.mapInArrow(select, "grade int, buckets array<int>").toArrow()
    rows = [b.values.to_numpy() for b in got.column("buckets")]
    return fit_ordinal(rows, np.array(got.column("grade").to_pylist(), int)) if rows else OrdinalModel({}, [], 0)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_severity, grade) of every row of `docs` (doc_id, text)."""
    narrow = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(OrdinalModel(*shared.value))
        for batch in slices(batches):
            found = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.int32()),
                ],
                names=["doc_id", "expected_severity", "grade"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int")
