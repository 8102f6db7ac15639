"""User, session and request tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_column_search(df: DataFrame, needle: str, columns: tuple[str, ...] = ("name", "id", "department", "email")) -> DataFrame:
    """Rows with the lower-cased text in any of the columns; a blank text keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(wanted)
    return df.where(hit)


def stored_plus_seed_users(stored: DataFrame, seed: DataFrame, columns: list[str]) -> DataFrame:
    """Stored users newest first, then seed users whose id is not stored."""
    absent = seed.join(stored.select("id"), "id", "left_anti")
    parts = stored.select(*columns, F.lit(0).alias("part")).unionByName(absent.select(*columns, F.lit(1).alias("part")))
    return parts.orderBy("part", F.col("created_at").desc_nulls_last(), "id")


def intersect_allowed(df: DataFrame, column: str, valid: list[str], name: str | None = None) -> DataFrame:
    """Keep only permitted values of an array column, in their own order; null becomes empty."""
    options = F.array(*[F.lit(v) for v in valid])
    values = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return df.withColumn(name or column, F.filter(values, lambda v: F.array_contains(options, v)))


def active_session(as_of: Column, idle_minutes: int) -> Column:
    """Active, not revoked, not expired, and seen (or, if never seen, created) within the idle time."""
    oldest = as_of - F.expr(f"INTERVAL {idle_minutes} MINUTES")
    seen = F.coalesce(F.col("last_seen_at") >= oldest, F.lit(False))
    new = F.col("last_seen_at").isNull() & F.coalesce(F.col("created_at") >= oldest, F.lit(False))
    alive = F.col("is_active") & F.col("revoked_at").isNull() & (F.col("expires_at") >= as_of)
    return F.coalesce(alive, F.lit(False)) & (seen | new)


def session_activity(sessions: DataFrame, as_of: dt.datetime, idle_minutes: int = 120) -> DataFrame:
    """Per user: active sessions, last seen and the app of the latest session. One aggregate."""
    now = F.lit(as_of).cast("timestamp_ntz")
    # A session that was never seen sorts below every seen one.
    order = F.struct("last_seen_at", "created_at", "source_app")
    out = sessions.groupBy("user_id").agg(
        F.count_if(active_session(now, idle_minutes)).alias("active_session_count"),
        F.max_by(F.struct("last_seen_at", "created_at", "source_app"), order).alias("_l"),
    )
    return out.select(
        "user_id",
        "active_session_count",
        F.coalesce("_l.last_seen_at", "_l.created_at").alias("last_seen_at"),
        F.coalesce("_l.source_app", F.lit("-")).alias("last_source_app"),
    )


def pending_requests(requests: DataFrame, status: str = "pending", kind: str | None = None) -> DataFrame:
    """Requests of a status (and type), newest first."""
    rows = requests.where(F.col("status") == status)
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.orderBy(F.col("requested_at").desc_nulls_last(), "login_id")
