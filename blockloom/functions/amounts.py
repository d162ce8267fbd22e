"""Exact integer amounts of any length, as decimal text.

Chains count in units so small that amounts need 256 bits, more than a decimal column or a double holds. They are
kept as text without sign or leading zeros. Such texts compare by (length, text), and add up limb by limb: 18 digits
make a limb, the sums of limbs stay decimals that combine map-side, and only the few sums at the end are put together.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIMB = 18  # digits
LIMBS = 5  # by default: 90 digits, of which 256 bits need 78


def canonical(text: Column) -> Column:
    """Amount text without leading zeros; null for what is no such integer."""
    plain = F.regexp_replace(F.trim(text), "^0+(?=[0-9])", "")
    return F.when(plain.rlike("^[0-9]+$"), plain)


def order_of(amount: Column) -> Column:
    """A value that orders amounts."""
    return F.struct(F.length(amount).alias("digits"), amount.alias("text"))


def limb_sums(amount: Column, times: Column | int = 1, limbs: int = LIMBS) -> Column:
    """Sum of amounts as a struct of limb sums, lowest first, and of how many there are; an error for longer ones.

    `times` is how many rows a row stands for.
    """
    times = F.lit(times) if isinstance(times, int) else times
    times = F.when(amount.isNotNull(), times).cast("decimal(19,0)")
    width = limbs * LIMB
    checked = F.when(F.length(amount) > width, F.raise_error(F.lit(f"an amount has more than {width} digits")).cast("string")).otherwise(amount)
    padded = F.lpad(checked, width, "0")
    parts = [F.substring(padded, width - LIMB * (k + 1) + 1, LIMB).cast("decimal(18,0)") for k in range(limbs)]
    return F.struct(
        F.array(*[F.coalesce(F.sum((p * times).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts]).alias("sums"),
        F.coalesce(F.sum(times), F.lit(0)).cast("long").alias("n"),
    )


def _total(sums) -> int:
    return sum(int(s) * 10 ** (LIMB * k) for k, s in enumerate(sums))


def decimal_text(value: Fraction, digits: int) -> str:
    """A number rounded half up to so many digits."""
    scaled = (value * 10**digits * 2 + 1) // 2
    whole, rest = divmod(int(scaled), 10**digits)
    return f"{whole}.{rest:0{digits}d}" if digits else str(whole)


# The two below work on aggregated rows, one per group.


@F.pandas_udf(StringType())
def total_text(sums: pd.Series) -> pd.Series:
    """Limb sums as one integer."""
    return sums.map(lambda parts: str(_total(parts)))


def mean_text(summed: Column, digits: int = 4) -> Column:
    """Mean of a `limb_sums` struct; null without amounts."""

    @F.pandas_udf(StringType())
    def run(sums: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([decimal_text(Fraction(_total(s), int(k)), digits) if k else None for s, k in zip(sums, n, strict=True)])

    return run(summed["sums"], summed["n"])


def between_text(low: Column, high: Column, share: Column, digits: int = 4) -> Column:
    """low + (high - low) * share of amounts, `share` being an exact binary fraction such as 0.5."""

    @F.pandas_udf(StringType())
    def run(lows: pd.Series, highs: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if a is None else decimal_text(int(a) + (int(b) - int(a)) * Fraction(s), digits)
                for a, b, s in zip(lows, highs, shares, strict=True)
            ]
        )

    return run(low, high, share)
