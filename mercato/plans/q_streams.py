"""Registered time-dependent queries: the batch attempt limiter,
plus rows-only entries for the Structured Streaming jobs (each runs the
stream over files derived from the source tables with availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.operators.limiter import attempt_limiter
from mercato.plans.registry import register

LIMIT, REFILL = 3, "2 days"


def _events_sql():
    """The batch status events (q_changes) as one SQL text for the oracle."""
    from mercato.plans.q_changes import (_ACCEPT_FINAL, _ACCEPT_OUT, _DECLINE_OUT, _DLV_OUT, _EVENTS, _PAID,
                                         _PAY_OUT, _QUOTE_OUT, _STATUS_OUT)

    parts = [_STATUS_OUT, _QUOTE_OUT, _ACCEPT_OUT, _ACCEPT_FINAL, _DECLINE_OUT, _DLV_OUT, _PAY_OUT, _PAID]
    return ("WITH " + ",\n".join(f"{n} AS ({q.strip()})" for n, q in parts) + "\n" + _EVENTS[1].strip())


_EVENTS_SQL = _events_sql()


@register("attempt_limiter", """
WITH RECURSIVE a AS (
  SELECT user_id AS k, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT k, rn, id, ts, ts AS anchor, 3 - 1 AS tokens, true AS allowed FROM a WHERE rn = 1
  UNION ALL
  SELECT a.k, a.rn, a.id, a.ts,
         CASE WHEN a.ts > r.anchor + INTERVAL 2 DAY THEN a.ts ELSE r.anchor END,
         CASE WHEN a.ts > r.anchor + INTERVAL 2 DAY THEN 3 - 1 WHEN r.tokens > 0 THEN r.tokens - 1 ELSE 0 END,
         CASE WHEN a.ts > r.anchor + INTERVAL 2 DAY THEN true ELSE r.tokens > 0 END
  FROM r JOIN a ON a.k = r.k AND a.rn = r.rn + 1)
SELECT k AS user_id, id AS event_id, ts, allowed FROM r
""")
def q_attempt_limiter(d):
    """Every event as an attempt keyed by user: limit 3, refill 2 days."""
    ev = d.source("events").select("user_id", "event_id", "ts")
    out = attempt_limiter(ev, "user_id", LIMIT, REFILL, ts="ts", id_col="event_id")
    return out.select("user_id", "event_id", "ts", "allowed")


# ------------------------------------------------------------ streaming jobs
# Each entry writes stream input derived from the source tables under the
# shared checkpoint folder, runs the stream with availableNow, and returns
# its output table. Where the stream must equal a batch op on the same rows,
# the batch op's oracle text is reused.

def _events_input(d, name, **kw):
    from mercato.session import scratch_path
    from mercato.streaming.jobs import write_stream_input

    path = scratch_path(d.spark, name)
    ev = d.source("events").select("event_id", "user_id", "ts", "event_type")
    return write_stream_input(ev, path, "ts", slices=4, **kw), ev.schema


def _ntz(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


@register("attempt_limiter_stream")
def q_attempt_limiter_stream(d):
    """The limiter as a stateful stream (state = tokens and anchor per user)."""
    from mercato.streaming.jobs import attempt_limiter_stream, read_stream, run_available_now

    path, schema = _events_input(d, "limiter-in")
    out = run_available_now(attempt_limiter_stream(read_stream(d.spark, path, schema), "user_id", LIMIT, REFILL,
                                                   ts="ts", id_col="event_id"), name="limiter")
    res = d.spark.read.parquet(out)
    return _ntz(res.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ts", "allowed"), "ts")


@register("attempt_limiter_late", """
WITH newest AS (SELECT event_id % 4 AS batch, max(ts) AS ts FROM events GROUP BY ALL),
bars AS (SELECT b.batch, max(p.ts) - INTERVAL 10 DAY AS bar FROM newest b LEFT JOIN newest p ON p.batch < b.batch GROUP BY ALL)
SELECT e.event_id, e.user_id, e.ts, coalesce(e.ts < bars.bar, e.ts IS NULL)::BIGINT AS n_late,
       1 - coalesce(e.ts < bars.bar, e.ts IS NULL)::BIGINT AS n_judged
FROM events e JOIN bars ON bars.batch = e.event_id % 4
""")
def q_attempt_limiter_late(d):
    """How often each event is among the late ones, and among the judged ones, of the limiter stream over four shuffled
    micro-batches that each hold all times, with 10 days of lateness. Judged twice, or lost, would show."""
    from mercato.session import scratch_path
    from mercato.streaming.jobs import attempt_limiter_stream, read_stream, run_available_now
    from mercato.streaming.late import split_available_now

    path, ev = scratch_path(d.spark, "shuffled"), d.source("events").select("event_id", "user_id", "ts")
    for i in range(4):
        ev.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(path)
    split = split_available_now(read_stream(d.spark, path, ev.schema, files_per_trigger=1), lateness="10 days")
    out = run_available_now(attempt_limiter_stream(split.on_time(), "user_id", LIMIT, REFILL, id_col="event_id"), name="limiter")
    judged = d.spark.read.parquet(out).select("id", F.lit(0).alias("late"), F.lit(1).alias("judged"))
    both = split.late().select(F.col("event_id").alias("id"), F.lit(1).alias("late"), F.lit(0).alias("judged")).unionByName(judged)
    sums = both.groupBy("id").agg(F.sum("late").alias("n_late"), F.sum("judged").alias("n_judged"))
    return ev.join(sums, ev["event_id"] == sums["id"], "left").select("event_id", "user_id", "ts", "n_late", "n_judged")


@register("session_stream")
def q_session_stream(d):
    """Every login that covers an event, as a stream-stream join over four micro-batches of either stream."""
    from mercato.streaming.jobs import files_for, read_stream, run_available_now, session_stream

    files = files_for(d.source("events"))
    path, schema = _events_input(d, "sessions-in", files_per_slice=files)
    logins = read_stream(d.spark, path, schema, files_per_trigger=files).where(F.col("event_type").isin("signup", "click"))
    events = read_stream(d.spark, path, schema, files_per_trigger=files)
    out = run_available_now(session_stream(logins.select(F.col("event_id").alias("id"), "user_id", "ts"), events), name="sessions")
    return _ntz(d.spark.read.parquet(out).select("user_id", "event_id", "ts", "login_id", "login_ts"),
                "ts", "login_ts")


@register("latest_session_stream")
def q_latest_session_stream(d):
    """Session attribution as a stream (state = latest login per user)."""
    from mercato.streaming.jobs import latest_session_stream, read_stream, run_available_now

    path, schema = _events_input(d, "latest-in")
    ev = read_stream(d.spark, path, schema)
    logins = ev.where(F.col("event_type").isin("signup", "click")).select(F.col("event_id").alias("id"), "user_id", "ts")
    out = run_available_now(latest_session_stream(logins, ev.select("event_id", "user_id", "ts")), name="latest")
    return _ntz(d.spark.read.parquet(out).select("user_id", "event_id", "ts", "login_id", "login_ts"),
                "ts", "login_ts")


@register("unread_stream", """
SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread, count(*) AS n_latest FROM (
  SELECT n.user_id, n.read_at IS NOT NULL OR r.id IS NOT NULL AS is_read FROM d_notifications n
  LEFT JOIN (SELECT DISTINCT id, user_id FROM d_reads) r ON r.id = n.id AND r.user_id = n.user_id
  QUALIFY row_number() OVER (PARTITION BY n.user_id ORDER BY n.created_at DESC NULLS FIRST, n.id DESC) <= 30
) GROUP BY user_id
""")
def q_unread_stream(d):
    """Unread counts kept by streams of notifications and reads over four
    micro-batches, many reads ahead of their notification; the last emitted
    row per user equals the batch count after mark_read."""
    from mercato.session import scratch_path
    from mercato.streaming.jobs import files_for, read_stream, run_available_now, unread_stream, write_stream_input

    files = files_for(d.notifications)
    npath = write_stream_input(d.notifications, scratch_path(d.spark, "unread-n"), "created_at", slices=4, files_per_slice=files)
    rpath = scratch_path(d.spark, "unread-r")
    d.reads.repartition(4, "id").write.parquet(rpath)
    n = read_stream(d.spark, npath, d.notifications.schema, files_per_trigger=files)
    r = read_stream(d.spark, rpath, d.reads.schema, files_per_trigger=1)
    out = run_available_now(unread_stream(n, r, 30, early="60 days"), mode="update", name="unread")
    res = d.spark.read.parquet(out)
    last = res.groupBy("user_id").agg(F.max_by(F.struct("unread", "n_latest"), F.col("batch")).alias("_l"))
    return last.select("user_id", F.col("_l.unread").alias("unread"), F.col("_l.n_latest").alias("n_latest"))


@register("request_status_stream", """
WITH RECURSIVE ev AS (
  SELECT r.id AS request_id, 'init' AS kind, r.status, q.status AS order_id,
         TIMESTAMP '1970-01-01 00:00:00' AS ts, CAST(0 AS BIGINT) AS seq, r.updated_at AS init_at
  FROM d_service_requests r LEFT JOIN d_quotes q ON q.service_request_id = r.id
  UNION ALL
  SELECT request_id, CASE status WHEN 'quoted' THEN 'quote' WHEN 'in_progress' THEN 'accept' WHEN 'declined' THEN 'decline'
                                 WHEN 'delivered' THEN 'deliver' WHEN 'paid' THEN 'pay' ELSE 'set' END,
         status, CAST(seq AS VARCHAR), ts, seq, CAST(NULL AS TIMESTAMP) AS init_at FROM ev0),
e AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, seq) AS rn FROM ev),
r AS (
  SELECT request_id, rn, status, init_at AS updated_at, order_id AS quote_status, CAST([] AS VARCHAR[]) AS paid
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.request_id, e.rn,
         coalesce(x.new_status, r.status),
         CASE WHEN x.new_status IS NOT NULL THEN e.ts ELSE r.updated_at END,
         CASE e.kind WHEN 'quote' THEN 'sent'
                     WHEN 'accept' THEN CASE WHEN r.quote_status IN ('sent', 'draft') THEN 'accepted' ELSE r.quote_status END
                     WHEN 'decline' THEN 'declined' ELSE r.quote_status END,
         CASE WHEN e.kind = 'pay' AND NOT list_contains(r.paid, e.order_id) THEN list_append(r.paid, e.order_id)
              ELSE r.paid END
  FROM r JOIN e ON e.request_id = r.request_id AND e.rn = r.rn + 1
  CROSS JOIN LATERAL (SELECT CASE e.kind
      WHEN 'quote' THEN 'quoted'
      WHEN 'accept' THEN CASE WHEN r.quote_status IN ('sent', 'draft') THEN 'in_progress' END
      WHEN 'decline' THEN 'declined'
      WHEN 'pay' THEN CASE WHEN NOT list_contains(r.paid, e.order_id) THEN 'paid' END
      WHEN 'deliver' THEN 'delivered'
      ELSE e.status END AS new_status) x)
SELECT request_id AS id, status, updated_at, quote_status FROM r
QUALIFY rn = max(rn) OVER (PARTITION BY request_id)
""", ("ev_batch", _EVENTS_SQL), ("ev0", "SELECT request_id, status, ts, seq FROM ev_batch"))
def q_request_status_stream(d):
    """Request statuses from a stream of transition events with sequential
    guards, seeded by one init row per request, over four micro-batches."""
    from mercato.plans.q_changes import status_events
    from mercato.session import scratch_path
    from mercato.streaming.jobs import files_for, read_stream, request_status_stream, run_available_now, write_stream_input

    kinds = {"quoted": "quote", "in_progress": "accept", "declined": "decline", "delivered": "deliver", "paid": "pay"}
    ev = status_events(d)
    kind = F.lit("set")
    for st, k in kinds.items():
        kind = F.when(F.col("status") == st, F.lit(k)).otherwise(kind)
    q = d.quotes.select(F.col("service_request_id").alias("_r"), F.col("status").alias("_qs"))
    init = (d.service_requests.join(q, F.col("id") == F.col("_r"), "left")
            .select(F.col("id").alias("request_id"), F.lit("init").alias("kind"), "status",
                    F.col("_qs").alias("order_id"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                    F.lit(0).cast("long").alias("seq"), F.col("updated_at").alias("init_at")))
    rows = init.unionByName(ev.select("request_id", kind.alias("kind"), "status",
                                      F.col("seq").cast("string").alias("order_id"), "ts", "seq",
                                      F.lit(None).cast("timestamp_ntz").alias("init_at")))
    once = scratch_path(d.spark, "status-once")
    rows.write.parquet(once)
    rows = d.spark.read.parquet(once)
    files = files_for(rows)
    path = write_stream_input(rows, scratch_path(d.spark, "status-in"), "ts", slices=4, files_per_slice=files)
    out = run_available_now(request_status_stream(read_stream(d.spark, path, rows.schema, files_per_trigger=files)),
                            mode="update", name="status")
    res = d.spark.read.parquet(out)
    last = res.groupBy("request_id").agg(F.max_by(F.struct("status", "updated_at", "quote_status"), F.col("batch")).alias("_l"))
    return _ntz(last.select(F.col("request_id").alias("id"), F.col("_l.status").alias("status"),
                            F.col("_l.updated_at").alias("updated_at"), F.col("_l.quote_status").alias("quote_status")),
                "updated_at")


@register("notification_stream")
def q_notification_stream(d):
    """All seven notification branches from one stream of changes in time order, over four micro-batches."""
    from mercato.plans.q_notify import change_frame
    from mercato.session import scratch_path
    from mercato.streaming.jobs import files_for, read_stream, write_stream_input
    from mercato.streaming.notifications import NotificationSink, notification_stream

    once = scratch_path(d.spark, "changes")
    change_frame(d).write.parquet(once)
    rows = d.spark.read.parquet(once)
    files = files_for(rows)
    path = write_stream_input(rows, scratch_path(d.spark, "changes-in"), "ts", slices=4, files_per_slice=files)
    root = scratch_path(d.spark, "notify-out")

    def tables():
        return {"users": d.users, "service_requests": d.service_requests, "services": d.services}

    q = notification_stream(read_stream(d.spark, path, rows.schema, files_per_trigger=files), root, tables,
                            trigger={"availableNow": True})
    q.awaitTermination()
    return NotificationSink(d.spark, root, tables).read("notifications")


def _reuse_oracles():
    """A stream that must equal its batch op is checked with the batch oracle."""
    from mercato.plans import q_joins, q_notify  # noqa: F401  (registers the batch texts first)
    from mercato.plans.registry import ORACLE

    ORACLE["attempt_limiter_stream"] = ORACLE["attempt_limiter"]
    ORACLE["session_stream"] = ORACLE["active_sessions"]
    ORACLE["latest_session_stream"] = ORACLE["latest_session"]
    ORACLE["notification_stream"] = ORACLE["notification_feed"]


_reuse_oracles()
