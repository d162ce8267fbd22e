"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The prompt is the longest run of turns that both conversations begin with, rendered once. What
follows in each is its completion: a list of segments, of which only the texts of assistant turns are
trained on and everything else (turn headers, other roles) is masked.

A conversation is one row of the result, so its turns meet in one task: that is the size of a training
example, whatever the number of conversations. Turns without a conversation id belong to none
and are left out. Null roles and texts count as empty. Repeated rows of one turn count once; different
rows with the same turn number follow each other by role and text; null turn numbers come first. A
conversation that only one side has gives no pair. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted

TRAINED_ROLE = "assistant"


def _turns(turns: DataFrame, side: str) -> DataFrame:
    return turns.filter(quoted("conv_id").isNotNull()).select(
        quoted("conv_id").alias("conv_id"),
        F.lit(side).alias("side"),
        F.struct(
            quoted("turn").alias("turn"),
            F.coalesce(quoted("role"), F.lit("")).alias("role"),
            F.coalesce(quoted("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )


def _segments(turns: Column) -> Column:
    """Header, text and line end of every turn, with a flag for what is trained on."""

    def of_turn(said: Column) -> Column:
        piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
        return F.array(
            piece(F.concat(F.lit("<|"), said["role"], F.lit("|>\n")), F.lit(False)),
            piece(said["text"], said["role"] == TRAINED_ROLE),
            piece(F.lit("\n"), F.lit(False)),
        )

    return F.flatten(F.transform(turns, of_turn))


def rendered(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def trained_chars(segments: Column) -> Column:
    lengths = F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: F.length(s["text"]).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, prompt_turns, prompt, chosen, rejected) per conversation that both (conv_id, turn, role, text) have.

    `prompt` is text; `chosen` and `rejected` are arrays of (text, trained) segments. One shuffle.
    """
    both = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))

    def of(side: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("said")))).alias(side)

    pairs = both.groupBy("conv_id").agg(of("chosen"), of("rejected"))
    pairs = pairs.filter((F.size("chosen") > 0) & (F.size("rejected") > 0))
    same = F.zip_with(
        "chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("prompt_turns", F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("prompt_turns") + 1, F.size(side))
    return pairs.select(
        "conv_id",
        "prompt_turns",
        rendered(_segments(F.slice("chosen", F.lit(1), F.col("prompt_turns")))).alias("prompt"),
        _segments(rest("chosen")).alias("chosen"),
        _segments(rest("rejected")).alias("rejected"),
    )


def weaker(turns: DataFrame) -> DataFrame:
    """A stand-in for rejected conversations: up to the last assistant turn, of which half the words stay."""
    last = turns.filter(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max("turn").alias("last"))
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    cut = (F.col("turn") == F.col("last")) & (F.col("role") == TRAINED_ROLE)
    return (
        turns.join(last, "conv_id", "left")
        .filter(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
        .select("conv_id", "turn", "role", F.when(cut, half).otherwise(F.col("text")).alias("text"))
    )
