"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles. A sketch fills its bins in rounds: each round hashes every
shingle to a bin, and a bin keeps the smallest hash of the first round that reached it; bins still empty
after as many rounds as there are bins get a round of their own. So every coordinate is filled, two
sets agree in a coordinate with the chance of their Jaccard similarity, and the share of agreeing
coordinates is concentrated around it. Equal bands of coordinates make candidates.

Equal sets are one class, so exact copies are never paired. Within a bucket of equal bands every class is
first checked against the bucket's centre only: the class that shares most buckets with most others, as the
original of many variants does. Where that leaves several components in a bucket, the classes outside the
largest are checked against a few members of the largest, other ones in every bucket; pairs whose sketches
agree in too few coordinates to be similar are left out before (a similar pair falls below that bound with a
chance under 1e-6). Where a bucket still holds several components, its classes meet those of other
components that share one of their rarest shingles early enough to be similar, which no similar pair fails. A
large group of near copies is thus linked through few of its members, and no link that could join two
components is left unchecked. Every link is confirmed on the full sets, centre by centre, a centre with many
partners in several tasks.

Null and empty texts, and those of white space alone, have no shingles and no links. Repeated ids get the
component of each of their texts; a component's id is its smallest document id, null if none has one, and
rows with a null id are kept only in such a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import WORD, free_name, quoted, slices
from blockloom.llm.components import connected
from blockloom.session import written

BANDS, ROWS = 32, 5  # a pair of similarity 0.8 shares no band with a chance of 3e-6
BINS = BANDS * ROWS
LEAST_AGREEING = 0.64  # of the coordinates; 0.8 less five standard deviations
PART = 500  # partners of a centre per task
PICKED = 3  # members of a bucket's largest component that others are checked against first
_MIX = np.uint64(0x9E3779B97F4A7C15)
_VALUE_BITS = 46
_ROUND_BITS = 64 - _VALUE_BITS


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = _scramble(mixed + hashes[k : len(words) - size + 1 + k])
    return np.unique(mixed)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that is not empty: (round, hash) of what filled each bin."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    first = 0
    while first < BINS and empty.any():
        rounds = np.arange(first, min(BINS, first + max(1, 4 * BINS // len(items))), dtype=np.uint64)
        hashed = _scramble(items[None, :] + _MIX * (rounds[:, None] + np.uint64(1)))
        bins = (hashed % np.uint64(BINS)).ravel().astype(np.int64)
        value = ((rounds[:, None] << np.uint64(_VALUE_BITS)) | (hashed >> np.uint64(_ROUND_BITS))).ravel()
        order = np.argsort(value)  # so that the first of each bin is its smallest
        found, at = np.unique(bins[order], return_index=True)
        fresh = empty[found]
        out[found[fresh]] = value[order][at[fresh]]
        empty[found] = False
        first += len(rounds)
    for bin_ in np.flatnonzero(empty):
        hashed = _scramble(items + _MIX * np.array([BINS + bin_ + 1], np.uint64))
        out[bin_] = np.uint64(BINS + bin_) << np.uint64(_VALUE_BITS) | (hashed.min() >> np.uint64(_ROUND_BITS))
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _scramble(key + rows[:, k])
    return key


def _sketched(size: int):
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, keys, band_keys, short = [], [], [], []
            for text in batch.column(2).to_pylist():
                items = shingles(text, size)
                counts.append(len(items))
                if len(items):
                    raw, coordinates = items.tobytes(), sketch(items)
                    keys.append((xxh3_64_intdigest(raw) >> 1, xxh3_64_intdigest(raw, 1) >> 1))
                    band_keys.append(bands(coordinates).view(np.int64))
                    short.append((_scramble(coordinates) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    keys.append((None, None))
                    band_keys.append(None)
                    short.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(band_keys, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "key", "key2", "bands", "short"],
            )

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose short sketches agree often enough."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            close = (left == right).sum(1) >= LEAST_AGREEING * BINS
            yield batch.select([0, 1]).filter(pa.array(close))


def _crossed(mixed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `mixed` (cls, root, outer) that may be similar and have different roots, one of them outer; written.

    Shingles are ordered by how many of these classes hold them, rarest first. A set that is similar to
    one of its size or more has one of its first n - 2p/(1+p) n + 1 shingles among the first n - p n + 1 of
    that set. So sets that share only what is common, like a passage, never meet, and no pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = [shingles(t, size).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["cls", "root", "outer", "items"]
            )

    with_text = mixed.join(texts, "cls").select("cls", "root", "outer", "text")
    sets = with_text.mapInArrow(run, "cls long, root long, outer boolean, items array<long>")
    rows = written(sets.select("cls", "root", "outer", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    held = rows.groupBy("item").agg(F.count("*").alias("held")).filter("held > 1")
    # A set's shingles that no other holds come before all others.
    own = Window.partitionBy("cls").orderBy("held", "item")
    common = F.count("*").over(Window.partitionBy("cls"))
    ranked = rows.join(held, "item").withColumn("rank", F.col("n") - common + F.row_number().over(own))
    ranked = ranked.withColumns(
        {
            "long": F.col("rank") <= F.col("n") - F.expr(f"int((n * {percent} + 99) div 100)") + 1,
            "short": F.col("rank") <= F.col("n") - F.expr(f"int((n * {2 * percent} + {99 + percent}) div {100 + percent})") + 1,
        }
    )
    ranked = written(ranked.filter("long").drop("held", "long"), "items")
    side = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("cls", "root", "n", "rank")]
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
    allowed = smaller & (F.col("root_a") != F.col("root_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    # After their first common shingle enough must be left on both sides.
    most = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
    allowed &= (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = None
    for outer_end in ("a", "b"):  # a is the smaller set
        left, right = ranked.filter("short"), ranked
        left, right = (left.filter("outer"), right) if outer_end == "a" else (left, right.filter("outer"))
        left, right = left.select("item", *side("a")), right.select(F.col("item").alias("same"), *side("b"))
        met = left.join(right, (F.col("item") == F.col("same")) & allowed)
        met = met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        pairs = met if pairs is None else pairs.union(met)
    return written(pairs.distinct(), "pairs")


def _linked(size: int, percent: int):
    """Pairs (a, b) confirmed on full sets; rows come sorted by centre and part, the centre's text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in slices(batches, 200):
            found = []
            for b, a, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                items = shingles(text, size)
                if a is None:
                    centre, own = b, items
                elif centre == b:
                    smaller, larger = sorted((own, items), key=len)
                    at = np.minimum(np.searchsorted(larger, smaller), len(larger) - 1)
                    both = int((larger[at] == smaller).sum())
                    if 100 * both >= percent * (len(own) + len(items) - both):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(side, pa.int64()) for side in zip(*found, strict=True)], names=["a", "b"]
                )

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, written."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    partners = (
        pairs.join(parts, "b")
        .join(texts.withColumnRenamed("cls", "a"), "a")
        .select("b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), "a", "text")
    )
    centres = parts.join(texts.withColumnRenamed("cls", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text"
    )
    together = partners.unionByName(centres).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return written(together.mapInArrow(_linked(size, percent), "a long, b long"), "links")


def _components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, root) of every class, written."""
    roots = connected(links).withColumnRenamed("node", "cls")
    return written(classes.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")), "roots")


def grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) as rows (doc_id, text_hash, n_shingles, key, key2), and classes (key, key2, component_id, keeper).

    `keeper` is the hash of the one text of a component that stays.
    """
    narrow = docs.select(
        quoted("doc_id").cast("long").alias("doc_id"), F.xxhash64(quoted("text")).alias("text_hash"), quoted("text").alias("text")
    )
    schema = "doc_id long, text_hash long, n_shingles long, key long, key2 long, bands array<long>, short binary"
    rows = written(narrow.mapInArrow(_sketched(size), schema), "sketches")
    merged = rows.filter("key IS NOT NULL").groupBy("key", "key2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
        F.first("bands").alias("bands"),
        F.first("short").alias("short"),
        F.first("n_shingles").alias("n"),
    )
    classes = written(merged.withColumn("cls", F.monotonically_increasing_id()), "classes")

    members = classes.select("cls", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(members.join(buckets, "band"), "buckets")  # those that share a band
    degrees = members.groupBy("cls").agg(F.sum("n").alias("degree"))
    ranked = members.join(degrees, "cls").select("band", F.struct("degree", (-F.col("cls")).alias("cls")).alias("rank"))
    centres = ranked.groupBy("band").agg((-F.max("rank")["cls"]).alias("b"))
    members = written(members.join(centres, "band").select("band", "cls", "b"), "buckets")
    wanted = members.select("cls").distinct().join(classes.select("cls", "first.text_hash"), "cls")
    by_text = narrow.groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = written(by_text.join(wanted, "text_hash").select("cls", "text"), "class-texts")
    short = classes.select("cls", "short", "n")

    def similar(pairs: DataFrame) -> DataFrame:
        """The distinct pairs whose sizes and sketches allow the similarity."""
        left = short.select(F.col("cls").alias("a"), F.col("short").alias("short_a"), F.col("n").alias("n_a"))
        right = short.select(F.col("cls").alias("b"), F.col("short").alias("short_b"), F.col("n").alias("n_b"))
        sized = pairs.distinct().join(left, "a").join(right, "b")
        sized = sized.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        return written(sized.select("a", "b", "short_a", "short_b").mapInArrow(_agreeing, "a long, b long"), "pairs")

    # Each class with the centre of most of its buckets, then with its other centres where still needed.
    stars = members.filter("cls <> b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("n"))
    stars = written(stars, "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b")))["b"].alias("b")).select("a", (-F.col("b")).alias("b"))
    links = _confirmed(similar(best), texts, size, percent)
    roots = _components(links, classes)

    def apart(pairs: DataFrame) -> DataFrame:
        root = lambda end: roots.select(F.col("cls").alias(end), F.col("root").alias(f"root_{end}"))
        return pairs.join(root("a"), "a").join(root("b"), "b").filter("root_a <> root_b").select("a", "b")

    def mixed(roots: DataFrame) -> DataFrame:
        """(band, cls, b, root, main) of the buckets that hold several components; `main` is the largest. Written."""
        placed = members.join(roots, "cls").select("band", "cls", "b", "root")
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
        main = sizes.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"))
        return written(placed.join(main.filter("roots > 1").select("band", "main"), "band"), "mixed-buckets")

    buckets = mixed(roots)
    picks = [F.min(F.struct(F.xxhash64("cls", "band", F.lit(k)), "cls"))["cls"] for k in range(PICKED)]
    picked = buckets.filter("root = main").groupBy("band").agg(F.array_distinct(F.array(*picks)).alias("picked"))
    few = buckets.filter("root <> main").join(picked, "band").select(F.col("cls").alias("a"), F.explode("picked").alias("b"))
    more = apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti").union(few).distinct())
    links = links.unionByName(_confirmed(similar(more), texts, size, percent))
    roots = _components(links, classes)

    buckets = mixed(roots)
    apart_yet = buckets.groupBy("cls", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("outer"))
    links = links.unionByName(_confirmed(_crossed(apart_yet, texts, size, percent), texts, size, percent))
    roots = _components(links, classes)

    labelled = classes.select("cls", "key", "key2", "first").join(roots, "cls")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("keeper"))
    return rows.drop("bands", "short"), labelled.join(smallest, "root").select(
        "key", "key2", F.col("keeper.doc_id").alias("component_id"), "keeper"
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text)."""
    rows, classes = grouped(docs, size, percent)
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(classes, ["key", "key2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id, text and more) without near-duplicates.

    Of each component the document with the smallest id stays, of equal rows one; texts without words all stay.
    """
    _, classes = grouped(docs.select("doc_id", "text"), size, percent)
    of, hash_of, text_hash = (free_name(docs, c) for c in ("of", "hash_of", "text_hash"))
    keepers = classes.select(F.col("keeper.doc_id").alias(of), F.col("keeper.text_hash").alias(hash_of)).distinct()
    has_words = F.coalesce(quoted("text").rlike(WORD), F.lit(False))
    hashed = docs.filter(has_words).withColumn(text_hash, F.xxhash64(quoted("text")))
    same = (F.col(text_hash) == F.col(hash_of)) & quoted("doc_id").cast("long").eqNullSafe(F.col(of))
    kept = hashed.join(keepers, same, "left_semi").dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return kept.unionByName(docs.filter(~has_words))
