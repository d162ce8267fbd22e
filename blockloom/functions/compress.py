"""zlib text codecs. Spark has no zlib expression, so these are Arrow-batched."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _each(series: pd.Series, convert) -> pd.Series:
    return series.map(lambda v: None if v is None else convert(v))


@F.pandas_udf(StringType())
def zlib_hex(text: pd.Series) -> pd.Series:
    return _each(text, lambda v: zlib.compress(v.encode()).hex())


@F.pandas_udf(StringType())
def unzlib_hex(text: pd.Series) -> pd.Series:
    return _each(text, lambda v: zlib.decompress(bytes.fromhex(v)).decode())


@F.pandas_udf(StringType())
def zlib_base64(text: pd.Series) -> pd.Series:
    return _each(text, lambda v: base64.b64encode(zlib.compress(v.encode())).decode())


@F.pandas_udf(StringType())
def unzlib_base64(text: pd.Series) -> pd.Series:
    return _each(text, lambda v: zlib.decompress(base64.b64decode(v)).decode())
