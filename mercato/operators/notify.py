"""Notification fan-out: the seven branches that insert notifications, and
their union (the notification feed).

Every branch returns rows shaped like the notifications table plus a
``branch`` column; ids are sha256 of (branch, source key, recipient), so a
replayed batch produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import new_id, ntz
from mercato.operators.feeds import first_staff, staff_sample
from mercato.operators.keys import audience_cross

# Notification type, title and body text of each branch.
ORDER_READY = ("order", "Digital order ready", "Your digital purchase is ready to download.")
QUOTE_READY = ("quote", "Quote ready", "A new quote is ready for your review.")
QUOTE_ACCEPTED = ("quote", "Quote accepted")          # body: "<name> accepted a quote for <service>."
QUOTE_DECLINED = ("quote", "Quote declined")          # body: "<name> declined the quote."
MESSAGE_POSTED = ("message", "New message on request", "There is a new message on your service request thread.")
DELIVERABLE_POSTED = ("deliverable", "New deliverable", "A new deliverable has been posted to your request.")
BROADCAST_TYPE = "broadcast"

NOTIFY_COLS = ["id", "user_id", "type", "title", "body", "meta", "read_at", "created_at", "branch"]


def _rows(df: DataFrame, branch: str, source_key: Column, recipient: Column, ntype, title, body,
          meta: Column, ts: Column) -> DataFrame:
    return df.select(
        new_id("notification", F.lit(branch), source_key, recipient).alias("id"),
        recipient.cast("long").alias("user_id"),
        (ntype if isinstance(ntype, Column) else F.lit(ntype)).alias("type"),
        (title if isinstance(title, Column) else F.lit(title)).alias("title"),
        (body if isinstance(body, Column) else F.lit(body)).alias("body"),
        F.to_json(meta).alias("meta"),
        F.lit(None).cast("timestamp_ntz").alias("read_at"),
        ts.cast("timestamp_ntz").alias("created_at"),
        F.lit(branch).alias("branch"))


def order_ready(paid: DataFrame) -> DataFrame:
    """Paid digital orders -> their owner. ``paid`` = apply_payments events."""
    d = paid.where(F.col("order_type") == "digital")
    return _rows(d, "order_ready", F.col("order_id"), F.col("owner_id"), *ORDER_READY,
                 F.struct(F.col("order_id").alias("orderId")), F.col("paid_at"))


def quote_ready(accepted: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each accepted quote submission -> the request owner, with the id of
    the (upserted) quote of that request."""
    q = quotes.select(F.col("service_request_id").alias("_r"), F.col("id").alias("quote_id"))
    a = accepted.join(q, accepted["request_id"] == q["_r"], "left")
    return _rows(a, "quote_ready", F.col("seq"), F.col("owner_id"), *QUOTE_READY,
                 F.struct(F.col("request_id").alias("requestId"), F.col("quote_id").alias("quoteId")), F.col("ts"))


def _recipients(users: DataFrame, k: int) -> Column:
    """Uncorrelated scalar subquery: the array of the k staff to notify
    (k rows at most, a proven bound; no join with the event rows)."""
    s = staff_sample(users, k)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("created_at").alias("c"), F.col("id").alias("i"))))
    return s.agg(F.transform(ordered, lambda x: x["i"]).alias("r")).scalar()


def quote_accepted(accepts: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """accepts(seq, caller_name, service_title, service_request_id, order_id, ts) -> k staff each."""
    e = accepts.withColumn("_staff", F.explode(_recipients(users, k)))
    body = F.concat(F.col("caller_name"), F.lit(" accepted a quote for "), F.col("service_title"), F.lit("."))
    return _rows(e, "quote_accepted", F.col("seq"), F.col("_staff"), *QUOTE_ACCEPTED, body,
                 F.struct(F.col("service_request_id").alias("requestId"), F.col("order_id").alias("orderId")),
                 F.col("ts"))


def quote_declined(declines: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """declines(seq, caller_name, service_request_id, quote_id, ts) -> k staff each."""
    e = declines.withColumn("_staff", F.explode(_recipients(users, k)))
    body = F.concat(F.col("caller_name"), F.lit(" declined the quote."))
    return _rows(e, "quote_declined", F.col("seq"), F.col("_staff"), *QUOTE_DECLINED, body,
                 F.struct(F.col("service_request_id").alias("requestId"), F.col("quote_id").alias("quoteId")),
                 F.col("ts"))


def message_posted(posted: DataFrame, users: DataFrame) -> DataFrame:
    """posted(seq, request_id, sender_id, owner_id, ts): the owner wrote ->
    the oldest staff user; anyone else wrote -> the owner. The owner test
    comes first, so staff who own a request notify staff; no staff -> none."""
    fs = first_staff(users).select("id").scalar()
    recipient = F.when(F.col("sender_id") == F.col("owner_id"), fs).otherwise(F.col("owner_id"))
    p = posted.withColumn("_to", recipient).where(F.col("_to").isNotNull())
    return _rows(p, "message_posted", F.col("seq"), F.col("_to"), *MESSAGE_POSTED,
                 F.struct(F.col("request_id").alias("requestId")), F.col("ts"))


def deliverable_posted(posted: DataFrame) -> DataFrame:
    """posted(seq, request_id, owner_id, deliverable_id, ts) -> the owner."""
    return _rows(posted, "deliverable_posted", F.col("seq"), F.col("owner_id"), *DELIVERABLE_POSTED,
                 F.struct(F.col("request_id").alias("requestId"), F.col("deliverable_id").alias("deliverableId")),
                 F.col("ts"))


def broadcast(messages: DataFrame, users: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """messages(seq, title, body, role) -> (notifications, inserted count per
    message, 0 when the audience is empty). meta = {"role": role or "all"}."""
    fan = audience_cross(messages, users)
    rows = _rows(fan, "broadcast", F.col("seq"), F.col("user_id"), BROADCAST_TYPE, F.col("title"), F.col("body"),
                 F.struct(F.coalesce(F.col("role"), F.lit("all")).alias("role")),
                 ntz(now))
    counts = fan.groupBy(F.col("seq").alias("_s")).agg(F.count(F.lit(1)).alias("inserted"))
    per_msg = (messages.join(counts, messages["seq"] == counts["_s"], "left")
               .select("seq", F.coalesce("inserted", F.lit(0).cast("bigint")).alias("inserted")))
    return rows, per_msg


#: One row for each change that may notify somebody. Of the columns a kind does not use, null. ``seq`` is the source key
#: (of order_ready the order's id), ``caller_id`` who wrote, accepted or declined.
CHANGES = ("kind string, seq long, request_id long, caller_id long, owner_id long, order_type string, order_id string, "
           "quote_id long, deliverable_id string, title string, body string, role string, ts timestamp")
NOTIFY_SCHEMA = ("id string, user_id long, type string, title string, body string, meta string, read_at timestamp_ntz, "
                 "created_at timestamp_ntz, branch string")
#: Kinds that need no request, and those that name their caller.
_DIRECT, _NAMED = ("order_ready", "broadcast"), ("quote_accepted", "quote_declined")


def change_notifications(changes: DataFrame, users: DataFrame, requests: DataFrame,
                         services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notifications, unresolved changes) of changes of all kinds in one
    frame. The frame meets requests (with their service) once and users once
    for names; broadcasts meet users by audience; staff are scalar subqueries.
    Changes that need no request, or no name, are spread over the tasks of that
    join by their source key, so null keys don't meet in one. Unresolved: the
    request, the service or the caller of a change is not in the tables."""
    kind, cols = F.col("kind"), changes.columns
    r = requests.select(F.col("id").alias("_rid"), F.col("user_id").alias("_owner"), F.col("service_id").alias("_service"))
    s = services.select(F.col("id").alias("_sid"), F.col("title").alias("_title"))
    r = r.join(s, r["_service"] == s["_sid"], "left").drop("_service").withColumn("_rz", F.lit(0))
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("_name"), F.lit(0).alias("_uz"))

    def side(needed: Column, key: str) -> Column:
        return F.when(needed & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("seq"), F.lit(61))).cast("int")

    direct, named = kind.isin(*_DIRECT), kind.isin(*_NAMED)
    rows = changes.where(kind != "broadcast").withColumns({"_rs": side(~direct, "request_id"), "_us": side(named, "caller_id")})
    rows = rows.join(r, (F.col("_rs") == F.col("_rz")) & (F.col("request_id") == F.col("_rid")), "left")
    rows = rows.join(u, (F.col("_us") == F.col("_uz")) & (F.col("caller_id") == F.col("_uid")), "left")
    # an accepted quote names its service, so it waits for that too
    found = direct | F.col("_rid").isNotNull() & (~named | F.col("_uid").isNotNull()) & (
        (kind != "quote_accepted") | F.col("_sid").isNotNull())
    unresolved = rows.where(~found).select(*cols)
    rows = rows.where(found & ((kind != "order_ready") | (F.col("order_type") == "digital")))
    staff, first = _recipients(users, 10), first_staff(users).select("id").scalar()
    to = (F.when(named, staff).when(kind == "order_ready", F.array("owner_id"))
          .when((kind == "message_posted") & (F.col("caller_id") == F.col("_owner")), F.array(first))
          .otherwise(F.array("_owner")))
    rows = rows.withColumn("_to", F.explode(to)).where(F.col("_to").isNotNull())
    texts = {"order_ready": ORDER_READY, "quote_ready": QUOTE_READY, "quote_accepted": (*QUOTE_ACCEPTED, None),
             "quote_declined": (*QUOTE_DECLINED, None), "message_posted": MESSAGE_POSTED, "deliverable_posted": DELIVERABLE_POSTED}

    def of(i: int) -> Column:
        return F.coalesce(*[F.when(kind == k, F.lit(t[i])) for k, t in texts.items()])

    body = (F.when(kind == "quote_accepted", F.concat("_name", F.lit(" accepted a quote for "), "_title", F.lit(".")))
            .when(kind == "quote_declined", F.concat("_name", F.lit(" declined the quote."))).otherwise(of(2)))
    request = F.col("request_id").alias("requestId")
    meta = (F.when(kind == "order_ready", F.to_json(F.struct(F.col("seq").alias("orderId"))))
            .when(kind == "quote_accepted", F.to_json(F.struct(request, F.col("order_id").alias("orderId"))))
            .when(kind.isin("quote_ready", "quote_declined"), F.to_json(F.struct(request, F.col("quote_id").alias("quoteId"))))
            .when(kind == "deliverable_posted", F.to_json(F.struct(request, F.col("deliverable_id").alias("deliverableId"))))
            .otherwise(F.to_json(F.struct(request))))
    out = rows.select(
        new_id("notification", kind, F.col("seq"), F.col("_to")).alias("id"), F.col("_to").cast("long").alias("user_id"),
        of(0).alias("type"), of(1).alias("title"), body.alias("body"), meta.alias("meta"),
        F.lit(None).cast("timestamp_ntz").alias("read_at"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        kind.alias("branch"))
    cast = audience_cross(changes.where(kind == "broadcast").select("seq", "title", "body", "role", "ts"), users)
    cast = _rows(cast, "broadcast", F.col("seq"), F.col("user_id"), BROADCAST_TYPE, F.col("title"), F.col("body"),
                 F.struct(F.coalesce(F.col("role"), F.lit("all")).alias("role")), F.col("ts"))
    return out.unionByName(cast.select(*out.columns)), unresolved


def change_rows(kind: str, df: DataFrame, **columns) -> DataFrame:
    """``df`` as changes of a kind: the named columns (name = column or its name), the others null."""
    fields = [c.split() for c in CHANGES.split(", ")]
    pick = lambda c: columns[c] if isinstance(columns[c], Column) else F.col(columns[c])
    return df.select(*[F.lit(kind).alias(c) if c == "kind" else
                       (pick(c) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def notification_feed(*branches: DataFrame) -> DataFrame:
    """UNION ALL of the branch frames."""
    out = branches[0].select(*NOTIFY_COLS)
    for b in branches[1:]:
        out = out.unionByName(b.select(*NOTIFY_COLS))
    return out
