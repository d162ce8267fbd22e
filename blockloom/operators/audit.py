"""Access-log audits: permissions, revoked tokens and lock-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.ordered import BLOCK, LABEL, streaks, to_blocks
from blockloom.schemas import ROLES

MAX_FAILURES = 3
LOCK_SECONDS = 300


def authorized(events: DataFrame, role: Column, permission: Column) -> DataFrame:
    """Events whose role holds the permission; a missing role is 'user', an unknown one holds nothing."""
    pairs = [F.struct(F.lit(r).alias("_role"), F.lit(p).alias("_permission")) for r, granted in ROLES.items() for p in granted]
    table = events.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    asked = events.withColumns({"_role": F.coalesce(role, F.lit("user")), "_permission": permission})
    # The role table is a constant of a few rows.
    return asked.join(F.broadcast(table), ["_role", "_permission"], "left_semi").drop("_role", "_permission")


def unrevoked(events: DataFrame, revocations: DataFrame, token: str, as_of: str) -> DataFrame:
    """Events whose token is not on the revocation list, expired entries aside."""
    live = revocations.filter(F.col("exp") > F.lit(as_of).cast("timestamp")).select(token).distinct()
    return events.join(live, token, "left_anti")


def lockout(attempts: DataFrame, user: str, order: list[str], ts: str, failed: Column) -> DataFrame:
    """Consecutive failures up to each attempt; from the third on the user is locked for 300 s.

    One pass over blocks, so the attempts of one user may be spread over many tasks.
    """
    blocks = to_blocks(attempts.withColumn("_failed", failed.cast("bigint")), [user], order)
    ran = streaks(blocks, [user], order, F.col("_failed"), F.col("_failed") == 0, "consecutive_failures")
    locked = F.col("consecutive_failures") >= MAX_FAILURES
    return (
        ran.withColumn("locked", locked)
        .withColumn("locked_until", F.when(locked, F.col(ts) + F.expr(f"INTERVAL {LOCK_SECONDS} SECONDS")))
        .drop("_failed", BLOCK, LABEL)
    )
