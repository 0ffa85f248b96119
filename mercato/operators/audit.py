"""Audit rows for logins and registrations (append-only, never read back)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import new_id

AUDIT_COLS = ["id", "actor_user_id", "action", "entity", "entity_id", "meta", "created_at"]


def _rows(df: DataFrame, action: str) -> DataFrame:
    actor = F.col("user_id").cast("string")
    return df.select(new_id("audit", F.lit(action), F.col("seq")).alias("id"), actor.alias("actor_user_id"),
                     F.lit(action).alias("action"), F.lit("user").alias("entity"), actor.alias("entity_id"),
                     F.to_json(F.struct(F.lower("email").alias("email"))).alias("meta"),
                     F.col("ts").cast("timestamp_ntz").alias("created_at"))


def audit_events(logins: DataFrame | None, registrations: DataFrame | None) -> DataFrame:
    """logins / registrations (seq, user_id, email, ts) -> audit rows
    ``user.login`` / ``user.register``, entity ``user``, entity_id = actor,
    meta = {"email": lower-cased email}. Actor ids are strings, as minted
    user ids are. Sink: ``write_partitioned(.., 'action')``."""
    parts = []
    if logins is not None:
        parts.append(_rows(logins, "user.login"))
    if registrations is not None:
        parts.append(_rows(registrations, "user.register"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
