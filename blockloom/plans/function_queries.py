"""Scalar function families, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import compress, crypto
from blockloom.functions import scalars as sc
from blockloom.plans.registry import query
from blockloom.plans.standins import AS_OF

ISO = "'%Y-%m-%d %H:%M:%S.%f'"


@query(
    "fn_epoch_date",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate)::BIGINT AS seconds FROM orders",
)
def _(t):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", sc.epoch_to_iso_date(seconds).alias("day"), seconds.alias("seconds"))


@query(
    "fn_iso",
    f"""SELECT event_id, strftime(ts, {ISO}) AS text, CASE WHEN event_type <> 'view' THEN strftime(date_trunc('second', ts), {ISO}) END AS parsed
        FROM events""",
)
def _(t):
    text = F.when(F.col("event_type") == "view", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select(
        "event_id", sc.iso_text(F.col("ts")).alias("text"), sc.iso_text(sc.parse_iso(text)).alias("parsed")
    )


@query(
    "fn_date_format",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y_%m') AS month, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp,
              strftime(o_orderdate, '%Y-%m-%d') AS parsed_day FROM orders""",
)
def _(t):
    stamp = F.date_format("o_orderdate", "yyyyMMdd_HHmmss")
    return t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy_MM").alias("month"),
        stamp.alias("stamp"),
        sc.iso_date(F.to_timestamp(stamp, "yyyyMMdd_HHmmss")).alias("parsed_day"),
    )


@query(
    "fn_age_days",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0
        ELSE floor((epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400)::BIGINT END AS age_days FROM orders""",
)
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.orders.select("o_orderkey", sc.age_days(sc.parse_iso(text), AS_OF).alias("age_days"))


@query("fn_hashes", "SELECT doc_id, md5(text) AS md5_hex, sha256(text) AS sha256_hex FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("md5_hex"), sc.pseudonym(F.col("text")).alias("sha256_hex")
    )


@query("fn_zlib_roundtrip", "SELECT doc_id, text AS from_hex, text AS from_base64 FROM documents")
def _(t):
    packed = t.documents.select("doc_id", compress.zlib_hex("text").alias("h"), compress.zlib_base64("text").alias("b"))
    return packed.select(
        "doc_id", compress.unzlib_hex("h").alias("from_hex"), compress.unzlib_base64("b").alias("from_base64")
    )


@query(
    "fn_json_fields",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k, '{"kind":"' || event_type || '","note":null}' AS encoded FROM events""",
)
def _(t):
    record = F.struct(F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("note"))
    return t.events.select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("encoded"),
    )


@query(
    "fn_encode",
    "SELECT c_custkey, hex(c_name) AS hex_text, base64(encode(c_name)) AS base64_text, c_name AS decoded FROM customer",
)
def _(t):
    packed = F.base64(F.col("c_name").cast("binary"))
    return t.customer.select(
        "c_custkey",
        F.hex(F.col("c_name").cast("binary")).alias("hex_text"),
        packed.alias("base64_text"),
        F.unbase64(packed).cast("string").alias("decoded"),
    )


@query("fn_round4", "SELECT event_id, round(value / 3, 4) AS rounded FROM events")
def _(t):
    return t.events.select("event_id", F.round(F.col("value") / 3, 4).alias("rounded"))


@query(
    "fn_strings",
    r"""SELECT page_id, length(html) AS n_chars, lower(url) AS lower_url, split_part(url, '/', -1) AS last_part,
               replace(url, 'http://', '') AS bare, starts_with(url, 'http://') AS plain_http,
               upper(left(split_part(url, '/', 4), 1)) || lower(substr(split_part(url, '/', 4), 2)) AS capitalised,
               'https://api.example.com/v1/' || page_id AS joined FROM pages""",
)
def _(t):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        F.char_length("html").cast("bigint").alias("n_chars"),
        F.lower(url).alias("lower_url"),
        sc.file_name(url).alias("last_part"),
        F.replace(url, F.lit("http://"), F.lit("")).alias("bare"),
        F.startswith(url, F.lit("http://")).alias("plain_http"),
        F.initcap(F.split_part(url, F.lit("/"), F.lit(4))).alias("capitalised"),
        sc.join_url(F.lit("https://api.example.com/v1/"), F.concat(F.lit("/"), F.col("page_id").cast("string"))).alias("joined"),
    )


@query(
    "fn_math",
    """SELECT event_id, greatest(0, value - 10) AS clamped, round(exp(value / 1000), 6) AS exponent,
              (props->>'$.k')::BIGINT // 7 AS whole, (props->>'$.k')::DOUBLE * 100 / 250 AS percent FROM events""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        "event_id",
        F.greatest(F.lit(0.0), F.col("value") - 10).alias("clamped"),
        F.round(F.exp(F.col("value") / 1000), 6).alias("exponent"),
        F.floor(k / 7).cast("bigint").alias("whole"),
        sc.percent(k, F.lit(250)).alias("percent"),
    )


@query(
    "fn_encrypt_roundtrip",
    """SELECT c_custkey, '{"c_name":"' || c_name || '","c_mktsegment":null}' AS decrypted, NULL::VARCHAR AS wrong_key,
              '{"c_name":"' || c_name || '","c_mktsegment":null}' AS rotated, NULL::VARCHAR AS old_key FROM customer""",
)
def _(t):
    t.spark.conf.set("spark.blockloom.key.old", "0123456789abcdef")
    t.spark.conf.set("spark.blockloom.key.new", "fedcba9876543210")
    old, new = crypto.key_column(t.spark, "old"), crypto.key_column(t.spark, "new")
    record = F.struct("c_name", F.lit(None).cast("string").alias("c_mktsegment"))
    stored = t.customer.select("c_custkey", crypto.encrypt_record(record, old).alias("cipher"))
    rotated = stored.withColumn("turned", crypto.rotate(F.col("cipher"), old, new))
    return rotated.select(
        "c_custkey",
        crypto.decrypt(F.col("cipher"), old).alias("decrypted"),
        crypto.decrypt(F.col("cipher"), new).alias("wrong_key"),
        crypto.decrypt(F.col("turned"), new).alias("rotated"),
        crypto.decrypt(F.col("turned"), old).alias("old_key"),
    )


@query(
    "fn_arrays",
    """SELECT doc_id, len(w) AS n, array_to_string(w[1:3], '|') AS head, w[1] AS first,
              len(list_filter(w, lambda x: length(x) > 0)) = len(w) AS all_filled, list_contains(w, '') AS any_blank
       FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def _(t):
    words = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n"),
        F.array_join(F.slice("w", 1, 3), "|").alias("head"),
        F.element_at("w", 1).alias("first"),
        F.forall("w", lambda x: F.length(x) > 0).alias("all_filled"),
        F.exists("w", lambda x: x == "").alias("any_blank"),
    )


@query(
    "fn_maps",
    """SELECT event_id, 'at,kind' AS keys, COALESCE(CASE WHEN event_type = 'view' THEN 1 END, 0)::BIGINT AS fallback,
              event_type = 'view' AS has_view, event_type AS merged FROM events""",
)
def _(t):
    kind = F.create_map(F.lit("kind"), F.col("event_type"))
    merged = F.map_concat(kind, F.create_map(F.lit("at"), F.lit("x")))
    counts = F.create_map(F.col("event_type"), F.lit(1))
    return t.events.select(
        "event_id",
        F.array_join(F.array_sort(F.map_keys(merged)), ",").alias("keys"),
        F.coalesce(F.try_element_at(counts, F.lit("view")), F.lit(0)).cast("bigint").alias("fallback"),
        F.map_contains_key(counts, F.lit("view")).alias("has_view"),
        F.element_at(merged, "kind").alias("merged"),
    )
