"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a long hash string: a row of symbols, each naming the axis that lies nearest to
the vector after a random rotation, written as bits. A tree is its strings in sorted order, so the
vectors that share a prefix are neighbours in it. A query first descends: in every tree it counts the
vectors that share its longest prefix and each shorter one. Then it ascends in all trees at once,
from the longest prefix to shorter ones, until at least `budget` vectors share a prefix of that
length with it in some tree. All of these are scored, none is left out, and the best are measured exactly.

Sorted strings are kept in pieces: a tree is cut at a prefix length that follows from the number of
vectors, and a piece that still has too many is split by a hash, its queries visiting every part.
Equal vectors are one entry of the forest, with their smallest ids, so they cost what one vector costs. A
query that no prefix of the pieces satisfies visits all pieces of the first tree, which is every vector.

Null and zero vectors, and such with null or non-finite components, take no part. Vectors of different
lengths never meet. Ties of the score go to the smaller id, repeated ids count as often as they occur and
null ids are left out, since nothing can refer to them. With fewer than `k` others a query gets all of
them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import quoted
from blockloom.session import written

TREES, SYMBOLS, AXES, SEED = 40, 6, 64, 7
PIECE = 20_000  # strings
BUDGET, BUDGET_POWER = 2.4, 0.75  # of the number of different vectors
RESCORED = 4  # times k


def budget(vectors: int) -> int:
    """Candidates that a query looks at in all trees together: it grows more slowly than the vectors."""
    return int(BUDGET * vectors**BUDGET_POWER) + 1


def symbol_bits(axes: int) -> int:
    return max(1, (2 * axes - 1).bit_length())


def hash_strings(vectors: np.ndarray) -> np.ndarray:
    """One integer per vector and tree: SYMBOLS symbols, the first in the highest bits."""
    size = vectors.shape[1]
    axes = min(AXES, size)
    random = np.random.default_rng((SEED, size))
    codes = np.zeros((len(vectors), TREES), np.int64)
    rows = np.arange(len(vectors))
    for tree in range(TREES):
        for _ in range(SYMBOLS):
            # Orthogonal columns, so that no axis is favoured.
            turned = vectors @ np.linalg.qr(random.standard_normal((size, axes)))[0].astype(np.float32)
            nearest = np.abs(turned).argmax(1)
            symbol = 2 * nearest + (turned[rows, nearest] > 0)
            codes[:, tree] = codes[:, tree] << symbol_bits(axes) | symbol
    return codes


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, vector) to (entry, size, codes, small): `small` has the direction in bytes."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            some = batch.take(pa.array(np.flatnonzero(sizes == size)))
            unit = _unit(_matrix(some.column(1), size)).astype(np.float32)
            codes = hash_strings(unit)
            small = np.round(unit / np.abs(unit).max(1, keepdims=True) * 127).astype(np.int8)
            edges = pa.array(np.arange(0, codes.size + 1, TREES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0),
                    pa.array(np.full(len(codes), size), pa.int32()),
                    pa.ListArray.from_arrays(edges, pa.array(codes.ravel())),
                    pa.array([row.tobytes() for row in small], pa.binary()),
                ],
                names=["entry", "size", "codes", "small"],
            )


def _bits(size: int) -> int:
    return SYMBOLS * symbol_bits(min(AXES, size))


def _ranges(codes: np.ndarray, wanted: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted `codes` the first `level` bits of each wanted code begin and end."""
    shift = (bits - level).astype(np.int64)
    low = (wanted >> shift) << shift
    return np.searchsorted(codes, low, "left"), np.searchsorted(codes, low + (np.int64(1) << shift), "left")


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Strings in sorted order, and queries."""
    asks = table.column("asks").to_numpy()
    strings = table.filter(pa.array(~asks))
    return strings.take(pa.array(np.argsort(strings.column("code").to_numpy(), kind="stable"))), table.filter(pa.array(asks))


def _descend(table: pa.Table) -> pa.Table:
    """(query, level, n): how many strings of this piece share exactly `level` bits with the query."""
    strings, queries = _split(table)
    codes, wanted = strings.column("code").to_numpy(), queries.column("code").to_numpy()
    bits = _bits(table.column("size")[0].as_py())
    shared = np.zeros((len(wanted), bits + 2), np.int64)
    for level in range(bits + 1):
        start, end = _ranges(codes, wanted, np.full(len(wanted), level), bits)
        shared[:, level] = end - start
    exact = shared[:, :-1] - shared[:, 1:]
    at, level = np.nonzero(exact)
    return pa.table(
        {"query": queries.column("entry").to_numpy()[at], "level": level.astype(np.int32), "n": exact[at, level]}
    )


def _ascend(table: pa.Table, keep: int) -> pa.Table:
    """(query, entry, near): the best `keep` strings of this piece that share the query's level."""
    strings, queries = _split(table)
    size = table.column("size")[0].as_py()
    found = []
    if len(strings) and len(queries):
        read = lambda t: np.stack([np.frombuffer(b, np.int8) for b in t.column("small").to_pylist()])
        points, asked = read(strings).astype(np.float32), read(queries).astype(np.float32)
        points /= np.sqrt((points * points).sum(1, keepdims=True))
        entries, names = strings.column("entry").to_numpy(), queries.column("entry").to_numpy()
        level = np.maximum(queries.column("level").to_numpy(), 0)
        starts, ends = _ranges(strings.column("code").to_numpy(), queries.column("code").to_numpy(), level, _bits(size))
        for name, vector, start, end in zip(names, asked, starts.tolist(), ends.tolist(), strict=True):
            near = points[start:end] @ vector
            best = np.argpartition(-near, keep)[:keep] if len(near) > keep else np.arange(len(near))
            found.append((np.full(len(best), name), entries[start:end][best], near[best].astype(np.float64)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table(dict(zip(("query", "entry", "near"), columns, strict=True)))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        scores = np.zeros(batch.num_rows)
        sizes = np.diff(left.offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            a, b = (_matrix(side.take(pa.array(at)), size) for side in (left, right))
            a, b = (m / np.abs(m).max(1, keepdims=True) for m in (a, b))
            scores[at] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores)], names=["query", "entry", "score"]
        )


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows with `is_query` (of the id, named `id`) the k nearest other rows."""
    vector = F.transform(quoted(vector_col), lambda x: x + F.lit(0).cast("float"))  # one zero, not two
    usable = rows.select(quoted(id_col).cast("long").alias("id"), vector.alias("vector")).filter(
        F.col("id").isNotNull() & _usable(F.col("vector"))
    )
    keyed = usable.withColumn("key", F.xxhash64("vector"))
    # The k + 1 smallest ids of each different vector, cut down before and after the shuffle.
    order = Window.partitionBy("key", "vector").orderBy("id")
    firsts = keyed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    classes = written(
        firsts.groupBy("key", "vector")
        .agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids"))
        .select("entry", "ids", "vector"),
        "vector-classes",
    )
    asked = written(
        keyed.filter(is_query)
        .groupBy("key", "vector", "id")
        .agg(F.count("*").alias("times"))
        .join(classes.select("entry", "vector", F.xxhash64("vector").alias("key")), ["key", "vector"])
        .select(F.col("entry").alias("query"), F.col("id").alias("query_id"), "times"),
        "vector-queries",
    )
    queries = asked.select(F.col("query").alias("entry")).distinct()

    total = classes.count()
    hashed = written(
        classes.select("entry", "vector").mapInArrow(_hashed, "entry long, size int, codes array<long>, small binary"),
        "vector-hashes",
    )
    goal = budget(total)
    piece = max(PIECE, 2 * goal // TREES)
    cut = max(0, (max(1, total) // piece).bit_length())  # bits that name a piece
    bits = F.lit(SYMBOLS) * F.length(F.bin(2 * F.least("size", F.lit(AXES)) - 1))
    spread = lambda df, *more: df.select("entry", "size", *more, F.posexplode("codes").alias("tree", "code")).withColumn(
        "cell", F.call_function("shiftright", F.col("code"), F.greatest(bits - cut, F.lit(0)).cast("int"))
    )
    strings = spread(hashed, "small")
    parts = (
        spread(hashed)
        .groupBy("size", "tree", "cell")
        .agg(F.count("*").alias("n"))
        .select("size", "tree", "cell", F.ceil(F.col("n") / piece).cast("int").alias("parts"))
    )
    parts = written(parts, "vector-cells")
    place = ["size", "tree", "cell"]
    strings = strings.join(parts, place).withColumn("part", F.pmod(F.xxhash64("entry"), "parts"))
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")
    asking = hashed.join(queries, "entry")
    fields = ["size", "tree", "cell", "part", "entry", "code", "asks"]

    down = strings.withColumn("asks", F.lit(False)).select(*fields).unionByName(
        spread(asking).join(parts, place).select("*", every_part).withColumn("asks", F.lit(True)).select(*fields)
    )
    groups = ["size", "tree", "cell", "part"]
    shared = down.groupBy(*groups).applyInArrow(_descend, "query long, level int, n long")
    per_level = shared.filter(F.col("level") >= cut).groupBy("query", "level").agg(F.sum("n").alias("n"))
    longer = Window.partitionBy("query").orderBy(F.col("level").desc())
    levels = (
        per_level.withColumn("upto", F.sum("n").over(longer))
        .groupBy("query")
        .agg(F.max(F.when(F.col("upto") >= goal + TREES, F.col("level"))).alias("level"))  # it finds itself in each tree
        .select(F.col("query").alias("entry"), F.coalesce("level", F.lit(-1)).alias("level"))
    )
    levels = written(levels, "vector-levels")

    leveled = asking.join(levels, "entry")
    own = spread(leveled.filter("level >= 0"), "small", "level").join(parts, place)
    everywhere = (
        leveled.filter("level < 0")
        .select("entry", "size", "small", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("code"))
        .join(parts.filter("tree = 0"), "size")
    )
    fields = [*fields, "small", "level"]
    visits = own.select("*", every_part).withColumn("asks", F.lit(True)).select(*fields).unionByName(
        everywhere.select("*", every_part).withColumn("asks", F.lit(True)).select(*fields)
    )
    up = strings.withColumn("asks", F.lit(False)).withColumn("level", F.lit(0)).select(*fields).unionByName(visits)
    keep = RESCORED * k
    near = up.groupBy(*groups).applyInArrow(lambda t: _ascend(t, keep), "query long, entry long, near double")
    near = near.groupBy("query", "entry").agg(F.max("near").alias("near"))
    best = Window.partitionBy("query").orderBy(F.col("near").desc(), "entry")
    near = near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= keep).select("query", "entry")
    near = near.union(queries.select("entry", "entry")).distinct()  # copies of the query itself

    vectors = classes.select("entry", "vector")
    pairs = near.join(vectors, "entry").join(
        vectors.select(F.col("entry").alias("query"), F.col("vector").alias("asked")), "query"
    )
    scored = pairs.select("query", "entry", "asked", "vector").mapInArrow(_cosines, "query long, entry long, score double")
    lists = (
        scored.join(classes.select("entry", "ids"), "entry")
        .select("query", "score", F.explode("ids").alias("id"))
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("list"))
    )
    found = asked.join(lists, "query").withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    # A query leaves out one row of its own id: itself.
    self_at = F.array_position(F.transform("list", lambda x: x["id"]), F.col("query_id")).cast("int")
    others = F.when(
        self_at > 0,
        F.concat(F.slice("list", F.lit(1), self_at - 1), F.slice("list", self_at + 1, F.size("list"))),
    ).otherwise(F.col("list"))
    return found.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.id").alias("vec_id"),
        (-F.col("hit.far")).alias("score"),
    )
