"""Record encryption with Spark's AES functions.

Keys are read from the session configuration when the plan is built and marked redacted, so pass
them as `spark.blockloom.key.<id>` and keep that prefix in `spark.redaction.regex`.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_PREFIX = "spark.blockloom.key."


def key_column(spark: SparkSession, key_id: str) -> Column:
    """The 16/24/32-byte key configured under `key_id`, as a binary column."""
    text = spark.conf.get(_PREFIX + key_id, None)
    if text is None:
        raise ValueError(f"no key configured under {_PREFIX}{key_id}")
    return F.lit(text).cast("binary")


def encrypt(text: Column, key: Column) -> Column:
    """Base64 text of the AES-GCM cipher."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def decrypt(cipher: Column, key: Column) -> Column:
    """Plain text, null for a wrong key or damaged cipher."""
    return F.try_aes_decrypt(F.unbase64(cipher), key, F.lit("GCM")).cast("string")


def encrypt_record(record: Column, key: Column) -> Column:
    return encrypt(F.to_json(record, {"ignoreNullFields": "false"}), key)


def rotate(cipher: Column, old_key: Column, new_key: Column) -> Column:
    """Re-encrypt under a new key; the old key no longer reads the result."""
    return encrypt(decrypt(cipher, old_key), new_key)
