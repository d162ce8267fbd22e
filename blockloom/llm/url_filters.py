"""URL filters: pattern rules looked up by their rarest literal token.

Every rule is a regular expression with the tokens (runs of a-z, 0-9) that any URL it matches must contain.
The tokens are counted over all URLs and each rule is filed under its rarest. A URL fetches the rules
filed under its own tokens, and only those run their expressions. Equal URLs are judged once.

Host rules name a host, meant with all its subdomains, and the start of a path; the longest that fits
decides. Where none fits, a matching block pattern blocks and every other URL is allowed.

A null URL, or one without `://`, has an empty host and path, and no rule fits it. Rules without a
token are filed under the empty one, which every URL has. Repeated rows get equal verdicts; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Block patterns over the lower-case URL, each with tokens that every match contains whole.
PATTERNS = (
    *((rf"[/?&.=_-]{w}([/?&.=_#-]|$)", [w]) for w in ("casino", "poker", "viagra", "porn", "xxx", "torrent")),
    *((rf"/{w}([/?#]|$)", [w]) for w in ("login", "signin", "signup", "register", "cart", "checkout", "logout")),
    *((rf"\.{w}([?#]|$)", [w]) for w in ("jpg", "jpeg", "png", "gif", "css", "js", "zip", "exe", "mp4", "mp3")),
    *((rf"[?&]{w}=", [w]) for w in ("sessionid", "phpsessid", "jsessionid")),
    (r"^[a-z]+://(ads|adserver|doubleclick)\.", []),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^a-z0-9]+"), lambda t: t != ""))


def host_rules(rules: DataFrame) -> DataFrame:
    """Rows (verdict, host, path) as pattern rules over host and path."""
    quote = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    # The end of a path's start may lie within a token of a URL.
    whole = F.regexp_replace(path, r"[A-Za-z0-9]+$", "")
    return rules.select(
        F.concat(host, path).alias("rule"),
        "verdict",
        F.concat(F.lit(r"^([^/]*\.)?"), quote(host), F.when(path == "", F.lit("(/|$)")).otherwise(quote(path))).alias("pattern"),
        _tokens(F.concat_ws(" ", host, whole)).alias("tokens"),
        F.lit(True).alias("by_host"),
    )


def block_patterns(spark: SparkSession, patterns=PATTERNS) -> DataFrame:
    rows = [(None, "block", pattern, tokens, False) for pattern, tokens in patterns]
    return spark.createDataFrame(
        rows, "rule string, verdict string, pattern string, tokens array<string>, by_host boolean"
    )


def filed(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Rules with `token`, the rarest of theirs among the (url, token) rows; ties go to the longer, then smaller one."""
    listed = rules.withColumn("id", F.struct("pattern", "by_host")).withColumn(
        "own", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    )
    wanted = listed.select(F.explode("own").alias("token")).distinct()
    seen = url_tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    best = (
        listed.select("id", F.explode("own").alias("token"))
        .join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token"))["token"].alias("token"))
    )
    return listed.drop("own", "tokens").join(best, "id").drop("id")


def url_verdicts(pages: DataFrame, rules: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages` (page_id, url).

    `rules` has (verdict, host, path). Rules and URLs meet in a join on tokens, so neither has to be small.
    """
    spark = pages.sparkSession
    every_rule = host_rules(rules).unionByName(patterns if patterns is not None else block_patterns(spark))
    urls = pages.select(quoted("url").alias("url")).filter("url IS NOT NULL").distinct()
    host, path = host_and_path(F.col("url"))
    tokens = urls.select(
        "url",
        F.concat(host, path).alias("place"),
        F.explode(F.array_append(_tokens(F.col("url")), F.lit(""))).alias("token"),
    )
    index = filed(every_rule, tokens.select("token"))
    hit = F.when(F.col("by_host"), F.expr("place RLIKE pattern")).otherwise(
        F.expr(f"translate(url, '{UPPER}', '{LOWER}') RLIKE pattern")
    )
    decided = (
        tokens.join(index, "token")
        .filter(hit)
        .groupBy("url")
        .agg(F.max(F.struct("by_host", F.length(F.coalesce("rule", F.lit(""))).alias("l"), "rule", "verdict")).alias("best"))
        .select(F.col("url").alias("judged"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    host, path = host_and_path(quoted("url"))
    return (
        pages.select(quoted("page_id").alias("page_id"), quoted("url").alias("url"), host.alias("host"), path.alias("path"))
        .join(decided, F.col("url") == F.col("judged"), "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    )
