"""Small column expressions: time, falsy coalescing, hashing, text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def epoch_to_iso_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_MICROS)


def parse_iso(text: Column) -> Column:
    """Timestamp of ISO text, null when it does not parse."""
    return F.try_to_timestamp(text)


def cutoff(as_of: str, days: int) -> Column:
    """`days` whole days before `as_of`."""
    if days <= 0:
        raise ValueError("days must be a positive integer")
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days from `ts` to `as_of`, rounded down; 0 where there is no usable time."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.coalesce(F.floor(seconds / 86400).cast("bigint"), F.lit(0).cast("bigint"))


def first_truthy(number: Column, fallback: Column) -> Column:
    """`number or fallback`: 0 and null count as missing."""
    return F.coalesce(F.nullif(number, F.lit(0)), fallback)


def first_nonempty(text: Column, fallback: Column) -> Column:
    """`text or fallback`: '' and null count as missing."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def ratio(numerator: Column, divisor: Column) -> Column:
    """Quotient as a double, 0 when the divisor is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), divisor.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def pseudonym(text: Column) -> Column:
    """Stable stand-in for an identifying value."""
    return F.sha2(text, 256)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_url(base: Column, endpoint: Column) -> Column:
    """Base and endpoint joined by exactly one slash."""
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.regexp_replace(endpoint, "^/+", ""))


def is_contiguous(numbers: Column) -> Column:
    """True when each array element is one more than the one before it."""
    return _neighbours(numbers, lambda a, b: b - a == 1)


def is_sorted(values: Column) -> Column:
    """True when no array element is below the one before it."""
    return _neighbours(values, lambda a, b: a <= b)


def _neighbours(values: Column, test) -> Column:
    size = F.size(values)
    left = F.slice(values, 1, F.greatest(size - 1, F.lit(0)))
    right = F.slice(values, 2, F.greatest(size - 1, F.lit(0)))
    return F.forall(F.zip_with(left, right, test), lambda ok: F.coalesce(ok, F.lit(False)))
