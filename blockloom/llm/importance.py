"""Importance resampling towards a target distribution, with weights summed bit by bit.

Features are single words and pairs of neighbours, hashed to buckets. A document's bucket counts are
held as bit planes: plane j has bit b set when bit j of the count of bucket b is set. The gain of each
bucket, a signed integer, becomes two sets of planes as well, one for positive and one for negative gains.
Then the sum of gains over a document is exact integer work without a loop over features: every count plane
is ANDed with every gain plane, set bits are counted, and the counts are added up with powers of two.

Null text has no words; a document without features weighs 0 and is drawn only if LEAST_WORDS allows it.
Texts are read whole, a long one only has more planes. Repeated rows are drawn one by one, each with a rank of its
own; ties go to the smaller id, null ids last. Empty tables give an empty result, and no target text means
that all gains come from the corpus alone. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted, slices
from blockloom.operators.ordered import number_rows
from blockloom.session import written

BUCKETS = 10_000
PLANE_WORDS = -(-BUCKETS // 64)  # 64-bit words of a plane
SCALE = 1000  # gains, weights and scores are in thousandths
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7

#: Bytes of UTF-8 text: A-Z become lower case, ASCII that is no letter or digit becomes a space, others stay.
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
CACHED_WORDS = 1 << 18  # remembered words per task; a full cache is emptied


class Hasher:
    """Buckets of a text's features: words as they come, then pairs."""

    def __init__(self):
        self._known: dict[bytes, tuple[int, bytes]] = {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """(words, bucket of every feature)."""
        words = text.encode().translate(FOLDED).split() if text else []
        if not words:
            return 0, np.empty(0, np.int64)
        known = self._known
        for word in set(words).difference(known):
            known[word] = crc32(word), b" " + word
        pairs = [known[w] for w in words]
        # The checksum of "a b" continues that of "a".
        both = [crc32(second[1], first[0]) for first, second in pairwise(pairs)]
        found = np.array([one for one, _ in pairs] + both, np.int64) % BUCKETS
        if len(known) > CACHED_WORDS:
            known.clear()
        return len(words), found


def planes_of(counts: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers, lowest first, as rows of 64-bit words."""
    depth = int(counts.max(initial=0)).bit_length()
    padded = np.zeros((depth, PLANE_WORDS * 64), np.uint8)
    for j in range(depth):
        padded[j, : len(counts)] = counts >> j & 1
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def weighted_sums(planes: np.ndarray, depths: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum of gain x count of each document whose count planes are stacked, `depths` of them a document."""
    power = np.concatenate([np.arange(d) for d in depths]) if len(depths) else np.empty(0, np.int64)
    per_plane = np.zeros(len(planes), np.int64)
    for sign in (1, -1):
        for k, gain_plane in enumerate(planes_of(np.maximum(sign * gains, 0))):
            per_plane += sign * (np.bitwise_count(planes & gain_plane).sum(axis=1, dtype=np.int64) << k)
    upto = np.concatenate([[0], np.cumsum(per_plane << power)])
    ends = np.cumsum(depths)
    return upto[ends] - upto[ends - depths]


def counted(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, planes, totals) as a written table. Planes are mostly empty and travel compressed.

    Every row of `docs` has its planes; every task adds one row that has nothing but `totals`, the bucket
    counts of all its rows, so that one pass over the texts serves both the corpus counts and the weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, totals, batch = Hasher(), np.zeros(BUCKETS, np.int64), None
        for batch in slices(batches):
            columns: list[list] = [[], [], []]
            for text in batch.column(1).to_pylist():
                n_words, found = hashed(text)
                counts = np.bincount(found, minlength=BUCKETS)
                totals += counts
                for column, value in zip(columns, (n_words, len(found), compress(planes_of(counts).tobytes(), 1)), strict=True):
                    column.append(value)
            yield row_batch(batch.column(0), *columns, [None] * batch.num_rows)
        if batch is not None:
            yield row_batch(pa.nulls(1, batch.schema.field(0).type), [None], [None], [None], [totals])

    def row_batch(ids, n_words, n_features, planes, totals) -> pa.RecordBatch:
        arrays = [
            ids,
            pa.array(n_words, pa.int64()),
            pa.array(n_features, pa.int64()),
            pa.array(planes, pa.binary()),
            pa.array(totals, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "n_features", "planes", "totals"])

    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words long, n_features long, planes binary, totals array<long>"
    return written(narrow.mapInArrow(run, schema), name)


def bucket_totals(table: DataFrame) -> np.ndarray:
    """Features per bucket over a table of `counted`: BUCKETS numbers, whatever the table."""
    per_task = table.filter("totals IS NOT NULL").select(F.posexplode("totals").alias("bucket", "n"))
    totals = np.zeros(BUCKETS, np.int64)
    for row in per_task.filter("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much more likely each bucket is in the target: 1000 times the log ratio, smoothed, rounded down."""
    of_corpus, of_target = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratios = (float((t + 1) * of_corpus) / float((s + 1) * of_target) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row of `docs`; `target` is a table with texts."""
    table = counted(docs, "planes", id_col, text_col)
    wanted = counted(target.select(F.lit(0).alias("id"), quoted(text_col).alias("text")), "target-planes", "id", "text")
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_totals(table), bucket_totals(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [decompress(p) for p in batch.column(3).to_pylist()]
            depths = np.array([len(p) // (8 * PLANE_WORDS) for p in raw], np.int64)
            planes = np.frombuffer(b"".join(raw), "<u8").reshape(-1, PLANE_WORDS)
            sums = weighted_sums(planes, depths, gains.value)
            features = batch.column(2).to_numpy()
            weights = np.where(features > 0, sums // np.maximum(features, 1), 0)  # // rounds down
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(weights, pa.int64())],
                names=["id", "n_words", "n_features", "weight"],
            )

    rows = table.filter("totals IS NULL").select("id", "n_words", "n_features", "planes")
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank): every row, the drawn ones ranked from 1.

    The score adds Gumbel noise from a hash of the id to the weight, so that the highest scores are a draw
    without replacement in proportion to the exponentials of the weights, the same in every run.
    """
    weighed = importance_weights(docs, target, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 32))
    score = F.col("weight") + F.floor(-SCALE * F.log(-F.log(share))).cast("long")
    scored = written(weighed.withColumn("score", score), "scores")
    long_enough = F.col("n_words") >= LEAST_WORDS
    drawn = scored.filter(long_enough).count() * percent // 100
    ranked = number_rows(
        scored.filter(long_enough).withColumns({"_down": -F.col("score"), "_last": F.col("id").isNull()}),
        [],
        ["_down", "_last", "id"],
        "rank",
    ).drop("_down", "_last")
    rest = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
