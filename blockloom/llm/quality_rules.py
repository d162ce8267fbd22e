"""Quality rules whose thresholds adapt to language and source.

Every text is measured once. The measures of the documents that pass the base rules go into mergeable
quantile sketches, one per (language, source) and measure: counts over integer bins whose width is at
most 1/64 of the value, so sketches merge by adding counts, in any order, with the same result.
Sketches of a language, and of everything, are sums of the finer ones and stand in for a group
with too few documents. A document is kept when its measures lie within the fences of its group.

Null text counts as empty, and empty texts fail the base rules. Null languages and sources are groups
like any other. Rows are judged one by one: repeated rows get equal verdicts. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import free_name, quoted, slices
from blockloom.session import written

SYMBOLS = "#*$%&|<>"  # fixed values
SPACES = " \t\n\v\f\r"  # fixed values
WINDOW = 5  # words
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Measures as integers in thousandths, which side is judged, and the least spread a fence allows for.
MEASURES = {
    "word_length": ("n_words", "word_chars", True, 1000),
    "symbols": ("n_words", "n_symbols", False, 30),
    "dup_lines": ("n_words", "n_dup_lines", False, 30),
    "repeats": ("n_words", "n_repeat_words", False, 70),
}
SPREADS = 3  # a fence lies this many spreads beyond a quartile
MIN_GROUP = 200  # documents; smaller groups use their language's sketch, or that of all


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the list, the first included."""
    import numpy as np

    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # Windows that differ never count as equal: those whose hashes meet are compared in full.
    first: dict[tuple[bytes, ...], int] = {}
    starts = set()
    for at in np.flatnonzero(np.isin(mixed, twice)).tolist():
        earlier = first.setdefault(tuple(words[at : at + WINDOW]), at)
        if earlier != at:
            starts.update((earlier, at))
    covered, upto = 0, 0
    for at in sorted(starts):
        covered += at + WINDOW - max(at, upto)
        upto = at + WINDOW
    return covered


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The values of COUNTS for a text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with a struct column `name` of the COUNTS, in Arrow batches; all columns pass through."""
    at = docs.columns.index(text_col)
    kind = pa.struct([(count, pa.int64()) for count in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_counts(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(values, pa.int64()) for values in zip(*found, strict=True)]
            counts = pa.StructArray.from_arrays(columns, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, name])

    fields = ", ".join(f"{count}: bigint" for count in COUNTS)
    schema = docs.select("*", F.lit(None).cast(f"struct<{fields}>").alias(name)).schema
    return docs.mapInArrow(run, schema)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
    )


def _value(counts: Column, name: str) -> Column:
    below, above, *_ = MEASURES[name]
    return F.floor(F.try_divide(1000 * counts[above], counts[below])).cast("long")


def sketches(counted: DataFrame, counts: str, lang_col: str, source_col: str) -> DataFrame:
    """(level, lang, source, measure, bin, n): bins of every group, of every language and of all.

    A bin is the highest seven bits of a value and how far they are shifted. Counts combine map-side,
    so a source with most of the rows costs no more than any other.
    """
    values = F.array(
        *[F.struct(F.lit(name).alias("measure"), _value(quoted(counts), name).alias("value")) for name in MEASURES]
    )
    passed = counted.filter(~base_failed(quoted(counts))).select(
        quoted(lang_col).alias("lang"), quoted(source_col).alias("source"), F.inline(values)
    )
    shift = F.expr("greatest(length(bin(value)) - 7, 0)")
    finest = (
        passed.withColumn("shift", shift)
        .withColumn("bin", F.expr("shift * 64 + shiftright(value, shift)"))
        .groupBy("lang", "source", "measure", "bin")
        .agg(F.count("*").alias("n"))
    )
    by = ["lang", "source", "measure", "bin"]
    return finest.groupingSets(
        [[F.col(c) for c in kept] for kept in (by, ["lang", "measure", "bin"], ["measure", "bin"])],
        *[F.col(c) for c in by],
    ).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))


def fences(counted: DataFrame, counts: str, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, and low_/high_ of each measure) for every group with a passing document."""
    one = Window.partitionBy("level", "lang", "source", "measure")
    ranked = (
        sketches(counted, counts, lang_col, source_col)
        .withColumn("upto", F.sum("n").over(one.orderBy("bin")))
        .withColumn("total", F.sum("n").over(one))
    )

    def quartile(k: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin")))

    found = (
        ranked.groupBy("level", "lang", "source", "measure")
        .agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
        .select("level", "lang", "source", "measure", "total", *[_bin_floor(q).alias(q) for q in ("q1", "q3")])
    )
    picked = F.struct("total", "q1", "q3")
    own = found.filter("level = 0").select("lang", "source", "measure", picked.alias("own"))
    by_lang = found.filter("level = 4").select(F.col("lang").alias("of"), F.col("measure").alias("m1"), picked.alias("wider"))
    everything = found.filter("level = 12").select(F.col("measure").alias("m2"), picked.alias("widest"))
    enough = F.when(F.col("own.total") >= MIN_GROUP, F.col("own")).when(
        F.col("wider.total") >= MIN_GROUP, F.col("wider")
    )
    chosen = (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("m1")))
        .join(everything, F.col("measure") == F.col("m2"))
        .withColumn("q", enough.otherwise(F.col("widest")))
    )
    limits = []
    for name, (_, _, both_sides, least) in MEASURES.items():
        reach = SPREADS * F.greatest(F.col("q.q3") - F.col("q.q1"), F.lit(least))
        here = F.col("measure") == name
        limits.append(F.max(F.when(here, F.col("q.q3") + reach)).alias(f"high_{name}"))
        if both_sides:
            limits.append(F.max(F.when(here, F.col("q.q1") - reach)).alias(f"low_{name}"))
    return chosen.groupBy("lang", "source").agg(*limits)


def _bin_floor(name: str) -> Column:
    """The least value of a bin."""
    return F.expr(f"shiftleft({name} - 64 * greatest({name} div 64 - 1, 0), int(greatest({name} div 64 - 1, 0)))")


def judged(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> tuple[DataFrame, str, str]:
    """`docs` with a struct of counts and a boolean verdict, and the names of these two columns.

    Texts are read once: measured rows are written to the shared folder, the sketches are taken from
    there and the fences joined back. Both sides of that join may shuffle, so that a hot source is
    split between tasks. Pass only the columns that are needed.
    """
    counts = free_name(docs, "counts")
    table = written(measured(docs, counts, text_col), "measured")
    limits = fences(table, counts, lang_col, source_col)
    lang, source, fence, verdict = (free_name(table, c) for c in ("fence_lang", "fence_source", "fence", "verdict"))
    packed = F.struct(*[c for c in limits.columns if c not in ("lang", "source")])
    limits = limits.select(F.col("lang").alias(lang), F.col("source").alias(source), packed.alias(fence))
    joined = table.join(
        limits,
        quoted(lang_col).eqNullSafe(F.col(lang)) & quoted(source_col).eqNullSafe(F.col(source)),
        "left",
    )
    inside = F.lit(True)
    for name, (_, _, both_sides, _) in MEASURES.items():
        value = _value(F.col(counts), name)
        inside &= value <= F.col(fence)[f"high_{name}"]
        if both_sides:
            inside &= value >= F.col(fence)[f"low_{name}"]
    kept = ~base_failed(F.col(counts)) & F.coalesce(inside, F.lit(True))
    return joined.withColumn(verdict, kept).drop(lang, source, fence), counts, verdict


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, the COUNTS, base_failed, kept) of every row of `docs` (doc_id, text, lang, source)."""
    rows, counts, verdict = judged(docs.select("doc_id", "text", "lang", "source"))
    return rows.select(
        "doc_id", F.col(counts + ".*"), base_failed(F.col(counts)).alias("base_failed"), F.col(verdict).alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns."""
    rows, _, verdict = judged(docs)
    return rows.filter(F.col(verdict)).select(*[quoted(c) for c in docs.columns])
