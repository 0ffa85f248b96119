"""Per-user notification feeds, unread counts, staff recipients, read marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import STAFF_ROLES, newest_first, ntz
from mercato.operators.topk import top_k_per_key

NOTIFICATION_COLS = ["id", "user_id", "type", "title", "body", "meta", "read_at", "created_at"]


def latest_notifications(notifications: DataFrame, k: int = 30) -> DataFrame:
    """Newest ``k`` notifications of every user (reference: one user at a time)."""
    return top_k_per_key(notifications.select(*NOTIFICATION_COLS), ["user_id"], newest_first(), k)


def unread_counts(notifications: DataFrame, k: int = 30) -> DataFrame:
    """Unread among each user's **latest k** (what the bell shows), not among all."""
    latest = latest_notifications(notifications, k)
    return latest.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"),
                                         F.count(F.lit(1)).alias("n_latest"))


def staff(users: DataFrame) -> DataFrame:
    return users.where(F.col("role").isin(list(STAFF_ROLES)))


def first_staff(users: DataFrame) -> DataFrame:
    """Oldest staff user: the recipient of messages written by a request owner."""
    return staff(users).select("id", "name", "role", "created_at").orderBy(
        F.col("created_at").asc_nulls_last(), F.col("id").asc()).limit(1)


def staff_sample(users: DataFrame, k: int = 10) -> DataFrame:
    """Ten staff to notify. The reference takes LIMIT 10 without ORDER BY; we
    order by (created_at, id) so the pick is reproducible."""
    return staff(users).select("id", "name", "role", "created_at").orderBy(
        F.col("created_at").asc_nulls_last(), F.col("id").asc()).limit(k)


def mark_read(notifications: DataFrame, reads: DataFrame, now) -> DataFrame:
    """Set ``read_at = now`` for the given ids **owned by** the reader;
    already-read rows are overwritten too. ``reads(user_id, id)``; duplicate
    reads collapse (distinct before the join keeps the join 1:1)."""
    r = reads.select(F.col("id").alias("_rid"), F.col("user_id").alias("_ruid")).distinct()
    j = notifications.join(r, (notifications["id"] == r["_rid"]) & (notifications["user_id"] == r["_ruid"]), "left")
    now_col = ntz(now).cast(notifications.schema["read_at"].dataType)
    return (j.withColumn("read_at", F.when(F.col("_rid").isNotNull(), now_col).otherwise(F.col("read_at")))
            .drop("_rid", "_ruid"))
