"""Mixing sources to target weights along a curriculum.

Sources share `share` times all words by weight; a target stops at `cap` times its source's words and
the excess goes to the others by weight. Documents of a source stand in the order of a content
hash. Every one of them is taken `target / words` times rounded down, and those at the head of the
order once more, up to the document whose end lies nearest to the target.

A source's weight changes over training: `schedule` gives its start and end as multiples of the
weight, with a mean of one. The integral of a weight over training is the demand for the source's
words so far, so inverting it turns a document's place among the words taken into its position in
training, between 0 and 1. Sorting by position mixes the sources.

Nothing is summed row by row within a source. Hash prefixes are summed per source, combining
map-side, and only the one prefix in which the target falls is looked at more closely, twice; so a
source that holds a third of the rows spreads like any other. Reruns agree, as ties only join rows
that agree in id, source and text: such rows are taken alike.

Null text has no words; documents without words are never taken. The null source is one source, the
last. Repeated rows each count. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import free_name, quoted, word_count
from blockloom.session import written

WEIGHTS = (3, 1, 2)  # repeating, over the sources by code point
SHARE_PERCENT, CAP = 150, 2
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  # start and end multiples, repeating like the weights
HASH_BITS = 60
PREFIX_BITS = 10  # of each of the two levels of hash prefixes
MARK_BITS = 6


def content_hash(doc_id: Column, source: Column, text: Column) -> Column:
    """60 bits of the MD5 of a document's id, source and text."""
    joined = F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), text)
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) of every row, written once: no text from here on."""
    narrow = docs.select(
        quoted("doc_id").alias("doc_id"),
        quoted("source").alias("source"),
        word_count(quoted("text")).alias("size"),
        content_hash(quoted("doc_id"), quoted("source"), quoted("text")).alias("place"),
    )
    return written(narrow, "sized")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, rank, source_size, target): one row per source.

    With k sources at their cap the others share what is left by weight. Sources reach their cap in the
    order of cap to weight, so the right k is the first whose share per weight is below the next ratio.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long")
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranked.withColumn("weight", weight)
        .withColumn("limit", cap * F.col("source_size"))
        .withColumn("capped", F.coalesce(F.sum("limit").over(by_ratio), F.lit(0)))
        .withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("budget", share_percent * F.sum("source_size").over(all_rows))
    )
    # The share per weight if all sources before this one are at their cap.
    level = (F.col("budget") - 100 * F.col("capped")) / (100 * F.col("left"))
    first = F.max(F.when(level * F.col("weight") <= F.col("limit"), level)).over(all_rows)
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(first, F.lit(float("inf"))))
    return before.select("source", "rank", "source_size", target.alias("target"))


def _prefix(place: str, level: int) -> Column:
    return F.shiftright(F.col(place), HASH_BITS - PREFIX_BITS * level)


def plan(sizes: DataFrame, **shares) -> DataFrame:
    """One row per source: its `target`, the whole `rounds`, the `last` place that is taken once more, and
    `marks`, the words before each of 2^MARK_BITS equal parts of the places.
    """
    goals = targets(sizes, **shares)
    rounds = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0).cast("long"))
    goals = goals.withColumn("rounds", rounds).withColumn(
        "extra", F.col("target") - F.col("rounds") * F.col("source_size")
    )
    goals = written(goals, "mix-goals")

    of = F.col("source").eqNullSafe(F.col("s"))
    left = sizes.filter("size > 0")
    cut = goals.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("base"), "extra")
    start = F.col("base") + F.col("before")
    for level in (1, 2):
        prefix = _prefix("place", level)
        sums = left.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words"))
        earlier = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        # The prefix in which the cut falls is the last that starts at or before it.
        cut = written(
            sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
            .join(cut, of)
            .filter(start <= F.col("extra"))
            .groupBy("source")
            .agg(F.max(F.struct("prefix", start.alias("base"), "extra")).alias("c"))
            .select(F.col("source").alias("s"), F.col("c.prefix").alias("cut"), "c.base", "c.extra"),
            "mix-cut",
        )
        left = left.join(cut.select("s", "cut"), of & (prefix == F.col("cut")), "left_semi")
    # About one row in a million of each source is left.
    steps = left.groupBy("source", "place").agg(F.sum("size").alias("words"))
    end = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("place"))
    last = (
        steps.join(cut, of)
        .withColumn("end", end)
        .filter(2 * F.col("end") - F.col("words") <= 2 * F.col("extra"))  # its end is nearer than its start
        .groupBy("source")
        .agg(F.max("place").alias("inside"))
    )
    head = F.shiftleft(F.col("cut"), HASH_BITS - 2 * PREFIX_BITS) - 1
    last = cut.join(last, of, "left").select("s", F.coalesce("inside", head).alias("last"))
    goals = goals.join(last, of, "left").drop("s").withColumn("last", F.coalesce("last", F.lit(-1).cast("long")))
    return written(goals, "mix-plan")  # so that the join with all rows is a plain one, broadcast or split by size


def _starts(placed: DataFrame) -> DataFrame:
    """(of, at_place, start): the words of a source, given by its rank, before each different place, exactly; written.

    Sums of the two levels of prefixes are added up, at most 2^PREFIX_BITS in a window, and then the places in one.
    """
    steps = placed.groupBy("rank", "place").agg(F.sum("size").alias("words"))
    steps = written(steps.withColumns({"high": _prefix("place", 1), "low": _prefix("place", 2)}), "mix-steps")
    before = lambda *by: F.coalesce(F.sum("words").over(
        Window.partitionBy("rank", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0).cast("long"))
    high = steps.groupBy("rank", "high").agg(F.sum("words").alias("words"))
    low = steps.groupBy("rank", "high", "low").agg(F.sum("words").alias("words"))
    high = high.select("rank", "high", before("high").alias("base"))
    low = low.select("rank", "high", "low", before("high", "low").alias("inner"))
    bases = low.join(high, ["rank", "high"]).select("rank", "low", (F.col("base") + F.col("inner")).alias("base"))
    inside = steps.join(bases, ["rank", "low"]).withColumn("start", F.col("base") + before("low", "place"))
    return written(inside.select(F.col("rank").alias("of"), F.col("place").alias("at_place"), "start"), "mix-starts")


def _position(words: Column, target: Column, rank: Column, schedules) -> Column:
    """The time, from 0 to 1, at which the demand for a source's words reaches `words` of its `target`."""
    share = F.least(F.try_divide(words, target), F.lit(1.0))
    ramps = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in schedules])
    ramp = F.element_at(ramps, (rank % len(schedules) + 1).cast("int"))
    begin, rise = ramp[0], ramp[1] - ramp[0]
    # The t at which begin * t + rise * t^2 / 2, the weight's integral, reaches this share.
    when = 2 * share / (begin + F.sqrt(F.greatest(begin * begin + 2 * rise * share, F.lit(0.0))))
    return F.coalesce(when, F.lit(0.0))


def _with_rank(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    return sizes.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mixing(docs: DataFrame, schedules=SCHEDULES, positions: str | None = None, **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `docs` (doc_id, source, text).

    Every copy gets its position in training; rows come sorted by the position of their first copy, and rows
    that are not taken at the end. `positions` names a column for the positions of a row's copies.
    """
    sizes = sized(docs)
    rows = _with_rank(sizes, plan(sizes, **shares))
    starts = _starts(rows.filter("size > 0"))
    rows = rows.join(starts, (F.col("rank") == F.col("of")) & (F.col("place") == F.col("at_place")), "left")
    copies = F.col("rounds") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    each = F.when((F.col("size") > 0) & (copies > 0), F.sequence(F.lit(0).cast("long"), copies - 1))
    at = F.transform(
        F.coalesce(each, F.array().cast("array<bigint>")),
        lambda copy: _position(copy * F.col("source_size") + F.col("start"), F.col("target"), F.col("rank"), schedules),
    )
    rows = rows.withColumn("positions", at).withColumn("first", F.get("positions", F.lit(0)))
    order = [F.col("first").asc_nulls_last(), F.col("place"), F.col("doc_id")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    taken = (F.col("size") * F.size("positions")).alias("taken")
    kept = ["doc_id", "size", "source_size", "target", taken]
    return ordered.select(*kept, *([F.col("positions").alias(positions)] if positions else []))


def _marks(sizes: DataFrame) -> DataFrame:
    """(s, marks): the words of each source before each part of the places, and after the last."""
    part = F.shiftright("place", HASH_BITS - MARK_BITS)
    sums = sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    parts = F.map_from_entries(F.collect_list(F.struct("part", "words")))  # at most 2^MARK_BITS entries
    all_parts = F.sequence(F.lit(0).cast("long"), F.lit((1 << MARK_BITS) - 1).cast("long"))
    return sums.groupBy(F.col("source").alias("s")).agg(parts.alias("by_part")).select(
        "s",
        F.aggregate(
            all_parts,
            F.array(F.lit(0).cast("long")),
            lambda so_far, at: F.concat(
                so_far,
                F.array(F.element_at(so_far, -1) + F.coalesce(F.try_element_at("by_part", at), F.lit(0)).cast("long")),
            ),
        ).alias("marks"),
    )


def mixed(docs: DataFrame, schedules=SCHEDULES, position: str | None = None, **shares) -> DataFrame:
    """The rows of `docs` as often as they are taken, sorted by position in training.

    `position` names a column for the position; without it only the columns of `docs` are returned.
    The one shuffle of texts is the range sort.
    """
    sizes = sized(docs)
    goals = plan(sizes, **shares).drop("extra")
    goals = goals.join(_marks(sizes), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fields = [c for c in goals.columns if c != "source"]
    of, goal, place, copy, at = (free_name(docs, c) for c in ("goal_of", "goal", "place", "copy", "position_at"))
    goals = goals.select(F.col("source").alias(of), F.struct(*fields).alias(goal))
    hashed = content_hash(quoted("doc_id"), quoted("source"), quoted("text"))
    copies = F.col(goal)["rounds"] + F.when(F.col(place) <= F.col(goal)["last"], 1).otherwise(0)
    taken = (
        docs.filter(word_count(quoted("text")) > 0)
        .withColumn(place, hashed)
        .join(goals, quoted("source").eqNullSafe(F.col(of)))
        .filter(copies > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    )
    width = 1 << (HASH_BITS - MARK_BITS)
    part = F.shiftright(F.col(place), HASH_BITS - MARK_BITS).cast("int")
    low, high = (F.element_at(F.col(goal)["marks"], part + k) for k in (1, 2))
    words = F.col(copy) * F.col(goal)["source_size"] + low + (high - low) * ((F.col(place) % width) / width)
    placed = taken.withColumn(at, _position(words, F.col(goal)["target"], F.col(goal)["rank"], schedules))
    kept = [quoted(c) for c in docs.columns]
    ordered = placed.repartitionByRange(F.col(at), F.col(place)).sortWithinPartitions(at, place)
    return ordered.select(*kept, *([F.col(at).alias(position)] if position else []))
