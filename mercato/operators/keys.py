"""Key tests and key-based joins: existence (404/409 checks), login lookup,
audience fan-out, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import wall_micros


def existing_keys(rows: DataFrame, table: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Rows whose reference ``rows[on[0]]`` exists as ``table[on[1]]`` (semi join)."""
    t = table.select(F.col(on[1]).alias("_k"))
    return rows.join(t, rows[on[0]] == t["_k"], "left_semi")


def missing_keys(rows: DataFrame, table: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Rows with a non-null reference that does not exist (anti join)."""
    t = table.select(F.col(on[1]).alias("_k"))
    return rows.where(F.col(on[0]).isNotNull()).join(t, rows[on[0]] == t["_k"], "left_anti")


def account_by_email(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attach the user to each login attempt by lower-cased email; no match
    means invalid credentials."""
    u = users.select(F.col("email").alias("_email"), F.col("id").alias("user_id"), F.col("role").alias("user_role"))
    a = attempts.withColumn("normalized_email", F.lower(F.col("email")))
    j = a.join(u, a["normalized_email"] == u["_email"], "left").drop("_email")
    return j.withColumn("outcome", F.when(F.col("user_id").isNull(), "invalid").otherwise("ok"))


def audience_cross(messages: DataFrame, users: DataFrame, salts: int = 16) -> DataFrame:
    """One row per (message, recipient): role given -> users of that role,
    no role -> every user. The fan-out *is* the output (one notification per
    recipient).

    Expressed as an equi join on an audience key: each user is listed under
    its role and under ``all``. Both sides are salted by the user, so the
    ``all`` key, which matches every user, is spread over ``salts`` tasks; a
    message is repeated once for each salt. Whether a side is small enough in
    bytes to broadcast is left to the planner's size check."""
    m = messages.withColumn("_aud", F.coalesce(F.col("role"), F.lit("all")))
    u = users.select(F.col("id").alias("user_id"), F.col("role").alias("user_role"))
    u = u.withColumn("_aud", F.explode(F.array(F.col("user_role"), F.lit("all"))))
    u = u.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(salts)))
    m = m.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return u.join(m, ["_aud", "_salt"], "inner").drop("_salt", "_aud")


def active_sessions(logins: DataFrame, events: DataFrame, lifetime: str = "7 days", width: str = "1 day") -> DataFrame:
    """Every (login, event) pair of a user where the login covers the event:
    ``login_ts <= ts < login_ts + lifetime`` (a login covers itself). Columns
    user_id, event_id, ts, login_id, login_ts.

    A binned interval join: time is cut into bins of ``width``, a login is
    listed under each bin it covers (lifetime / width + 1 of them, a fixed
    number), an event under its own, and the join is an equi join on (user,
    bin) with the exact test after it. A user with a third of all events is
    spread over the bins those fall into; AQE splits a bin that is still
    large. Every pair is found once, in the event's bin. Works on streams
    too. Rows without a time or a user pair with nothing; the bins only deal
    out the work (the result does not depend on ``width``)."""
    life, step = _seconds(lifetime) * 1_000_000, _seconds(width) * 1_000_000

    def at(us):
        return F.floor(us / F.lit(step)).cast("long")

    lg = logins.select(F.col("user_id").alias("_user"), F.col("id").alias("login_id"), F.col("ts").alias("login_ts"))
    us = wall_micros("login_ts")
    lg = lg.withColumn("_login_bin", F.explode(F.sequence(at(us), at(us + F.lit(life - 1)))))
    ev = events.select("user_id", "event_id", "ts").withColumn("_bin", at(wall_micros("ts")))
    covered = (F.col("ts") >= F.col("login_ts")) & (F.col("ts") < F.col("login_ts") + F.expr(f"INTERVAL {lifetime}"))
    pairs = ev.join(lg, (F.col("user_id") == F.col("_user")) & (F.col("_bin") == F.col("_login_bin")) & covered)
    return pairs.select("user_id", "event_id", "ts", "login_id", "login_ts")


def latest_session(logins: DataFrame, events: DataFrame, lifetime: str = "7 days",
                   bucket: str = "1 hour") -> DataFrame:
    """Attribute each event to one session covering it: the user's latest
    login with ``login_ts <= ts < login_ts + lifetime`` (a login covers
    itself; ties go to the larger login id). Events with no covering login
    are dropped.

    An as-of join that never pairs a user's logins with its events: logins
    and events form one time-ordered stream and a running
    ``last(login, ignorenulls)`` carries the latest login forward. The
    window is partitioned by (user, hour), so a hot user is split over its
    hours; the bucket only partitions the work (the result does not depend
    on it). The login carried *into* a bucket is the user's last login of
    any earlier bucket: a per-(user, bucket) max, carried forward by a
    window over the user's non-empty buckets (one row per active hour)."""
    life = F.expr(f"INTERVAL {lifetime}")
    bsec = _seconds(bucket)

    def b(ts):
        return F.floor(wall_micros(ts) / F.lit(bsec * 1_000_000)).cast("long")

    login_t = "struct<login_ts:timestamp_ntz,login_id:bigint>"
    lg = logins.select("user_id", F.col("ts").alias("login_ts"), F.col("id").alias("login_id"))
    stream = (lg.select("user_id", F.col("login_ts").alias("ts"), F.lit(0).alias("_kind"),
                        F.col("login_id").alias("_id"), F.struct("login_ts", "login_id").alias("_login"))
              .unionByName(events.select("user_id", "ts", F.lit(1).alias("_kind"), F.col("event_id").alias("_id"),
                                         F.lit(None).cast(login_t).alias("_login")))
              .withColumn("_b", b(F.col("ts"))))
    # Latest login at or before each row, within its (user, bucket).
    w = (Window.partitionBy("user_id", "_b").orderBy("ts", "_kind", "_id")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = stream.withColumn("_in", F.last("_login", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    # Latest login before each bucket: per-(user, bucket) max, carried forward.
    per_bucket = stream.groupBy("user_id", "_b").agg(F.max("_login").alias("_last"))
    wb = Window.partitionBy("user_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select("user_id", "_b", F.max("_last").over(wb).alias("_carry"))
    out = within.join(carry, ["user_id", "_b"], "left")
    chosen = F.coalesce(F.col("_in"), F.col("_carry"))
    res = out.select("user_id", F.col("_id").alias("event_id"), "ts",
                     chosen["login_id"].alias("login_id"), chosen["login_ts"].alias("login_ts"))
    return res.where(F.col("login_ts").isNotNull() & (F.col("ts") < F.col("login_ts") + life))


def _seconds(spec: str) -> int:
    n, unit = spec.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return int(n) * mult
