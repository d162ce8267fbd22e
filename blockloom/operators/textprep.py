"""Prompt de-duplication, column mapping, tokenising, batching and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.operators.ordered import number_rows


def _hash(df: DataFrame, text: str) -> Column:
    """MD5 of the text; rows without text get a key of their own, so they do not pile up in one task."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.concat(F.lit("-"), F.xxhash64(*df.columns).cast("string")))


def dedup_prompts(records: DataFrame, order: str, prompt: str = "prompt") -> DataFrame:
    """Keep each prompt once; later copies refer to it by id.

    The first record of a prompt, in `order`, keeps the text and gets `id`, the number of distinct
    prompts before it; later ones get `prompt_ref`. One row per distinct prompt is sorted, never
    the records, and first-seen positions combine map-side, so a prompt with a third of all copies
    costs one row per map task. The closing join is keyed uniquely on one side and left to AQE's
    skew split on the other.
    """
    hashed = records.withColumn("_hash", _hash(records, prompt))
    firsts = hashed.filter(F.col(prompt).isNotNull()).groupBy("_hash").agg(F.min(order).alias("_first"))
    ids = number_rows(firsts, [], ["_first"], "_n").select("_hash", "_first", (F.col("_n") - 1).alias("_id"))
    first = F.col(order) == F.col("_first")
    return (
        hashed.join(ids, "_hash", "left")
        .withColumn(prompt, F.when(first, F.col(prompt)))
        .withColumn("id", F.when(first, F.col("_id")))
        .withColumn("prompt_ref", F.when(~first, F.col("_id")))
        .drop("_hash", "_first", "_id")
    )


def resolve_prompt_refs(records: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Put the kept text back where a record only refers to it.

    Records without a reference join on negative keys of their own: ids are never negative, and a
    shared null key would send all of them to one task.
    """
    kept = records.filter(F.col("id").isNotNull()).select(F.col("id").alias("_key"), F.col(prompt).alias("_text"))
    spread = -1 - F.pmod(F.xxhash64(*records.columns), F.lit(1 << 40))
    return (
        records.withColumn("_key", F.coalesce("prompt_ref", spread))
        .join(kept, "_key", "left")
        .withColumn(prompt, F.coalesce(F.col(prompt), F.col("_text")))
        .drop("_key", "_text", "id", "prompt_ref")
    )


def _as_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.array_join(name, " ")
    return F.col(name).cast("string")


def prepare_pairs(df: DataFrame, input_column: str, target_column: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(input, target) text per row; lists joined by a space, target defaults to input, rows without input left out."""
    source = _as_text(df, input_column)
    has_target = target_column is not None and target_column in df.columns
    target = F.coalesce(_as_text(df, target_column), source) if has_target else source
    return df.select(*keys, source.alias("input"), target.alias("target")).filter(F.col("input").isNotNull())


ID_DIGITS = 15  # hex digits of a word's id: 60 bits, so that different words share one by no practical chance


def token_ids(text: Column, vocabulary: int | None = None) -> Column:
    """Default tokenizer: whitespace words to ids from 1 up; 0 is padding.

    An id is the start of the word's MD5, the same in every run and engine. A `vocabulary` folds ids into so many
    numbers, and then words may share one.
    """

    def id_of(word: Column) -> Column:
        found = F.conv(F.substring(F.md5(word.cast("binary")), 1, ID_DIGITS), 16, 10).cast("bigint")
        return (found if vocabulary is None else F.pmod(found, F.lit(vocabulary))) + 1

    return F.transform(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), id_of)


def tokenize_pad(
    pairs: DataFrame, max_length: int = 512, pad_id: int = 0, tokenizer: Callable[[Column], Column] = token_ids
) -> DataFrame:
    """Fixed-length input_ids, attention_mask and labels; labels copy the input unless the target differs."""

    def fixed(ids: Column) -> Column:
        cut = F.slice(ids, 1, max_length)
        return F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(cut)))

    differs = F.coalesce((F.col("target") != "") & (F.col("target") != F.col("input")), F.lit(False))
    size = F.least(F.size("_ids"), F.lit(max_length))
    mask = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.lit(max_length) - size))
    return (
        pairs.withColumn("_ids", tokenizer(F.col("input")))
        .withColumn("input_ids", fixed(F.col("_ids")))
        .withColumn("attention_mask", mask)
        .withColumn("labels", F.when(differs, fixed(tokenizer(F.col("target")))).otherwise(F.col("input_ids")))
        .drop("_ids", "input", "target")
    )


def batched_tokenizer(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A tokenizer for `tokenize_pad` from a function that encodes a list of texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(encode(text.fillna("").tolist()), dtype=object)

    return run


def loader_batches(df: DataFrame, key: str, seed: int = 0, batch_size: int = 8, shuffle: bool = True) -> DataFrame:
    """Shuffle rows by a seeded hash of their key and cut them into batches of `batch_size`."""
    place = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")) if shuffle else F.lit("")
    numbered = number_rows(df.withColumn("_place", place), [], ["_place", key], "_n")
    return numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / batch_size).cast("bigint")).drop("_place", "_n")


def assign_batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Fixed-size batches in order; the last one of a key may be short."""
    numbered = number_rows(df, keys, order, "_n")
    return numbered.withColumn("batch_id", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def batch_infer(
    prompts: DataFrame, prompt: str, generate: Callable[[list[str]], list[tuple[str, int]]], max_length: int, batch_size: int = 32
) -> DataFrame:
    """Run a model function over prompts, each distinct prompt once.

    `generate` maps a list of at most `batch_size` prompts to (text, token count) pairs. Adds
    generated, tokens and finish_reason.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                answers = generate(part["_prompt"].tolist())
                yield pd.DataFrame(
                    {
                        "_hash": part["_hash"].tolist(),
                        "generated": [a[0] for a in answers],
                        "tokens": [a[1] for a in answers],
                    }
                )

    hashed = prompts.withColumn("_hash", _hash(prompts, prompt))
    distinct = hashed.filter(F.col(prompt).isNotNull()).groupBy("_hash").agg(F.any_value(prompt).alias("_prompt"))
    answers = distinct.mapInPandas(run, "_hash string, generated string, tokens long")
    reason = F.when(F.col("tokens") >= max_length, "length").when(F.col("tokens").isNotNull(), "stop")
    return hashed.join(answers, "_hash", "left").drop("_hash").withColumn("finish_reason", reason)
