"""Service-request reads: list, detail document, messages, quotes, board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import REQUEST_STATUSES, newest_first, oldest_first, wall_micros


def _services(services: DataFrame) -> DataFrame:
    return services.select(F.col("id").alias("_sid"), F.col("title").alias("service_title"),
                           F.col("slug").alias("service_slug"))


def _customers(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"),
                        F.col("email").alias("customer_email"))


def request_header(requests: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """requests JOIN services JOIN users (inner: a request whose service or
    user is gone is dropped, as in the reference)."""
    s, u = _services(services), _customers(users)
    return (requests.join(s, requests["service_id"] == s["_sid"], "inner")
            .join(u, requests["user_id"] == u["_uid"], "inner")
            .drop("_sid", "_uid"))


def request_list(requests: DataFrame, services: DataFrame, users: DataFrame, user_id=None) -> DataFrame:
    """Request board rows, newest first; ``user_id`` restricts to one owner."""
    r = requests if user_id is None else requests.where(F.col("user_id") == F.lit(user_id))
    return (request_header(r, services, users)
            .select("id", "status", "created_at", "updated_at", "brief", "service_title", "service_slug",
                    "customer_name", "customer_email")
            .orderBy(*newest_first()))


def request_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with their sender (inner join), oldest first."""
    s = users.select(F.col("id").alias("sender_id"), F.col("name").alias("sender_name"),
                     F.col("role").alias("sender_role"))
    return (messages.join(s, messages["sender_user_id"] == s["sender_id"], "inner")
            .select("id", "service_request_id", "body", "attachments", "created_at", "sender_id", "sender_name",
                    "sender_role")
            .orderBy("service_request_id", *oldest_first()))


def request_deliverables(deliverables: DataFrame) -> DataFrame:
    return (deliverables.select("id", "service_request_id", "title", "description", "file_url", "created_at")
            .orderBy("service_request_id", *newest_first()))


def quote_context(quotes: DataFrame, requests: DataFrame, services: DataFrame) -> DataFrame:
    """Who owns each quote and for which service: quotes JOIN requests JOIN services."""
    r = requests.select(F.col("id").alias("_rid"), "user_id", "service_id")
    s = services.select(F.col("id").alias("_sid"), F.col("title").alias("service_title"))
    return (quotes.join(r, quotes["service_request_id"] == r["_rid"], "inner")
            .join(s, F.col("service_id") == s["_sid"], "inner")
            .select("id", "service_request_id", "amount_cents", "status", "notes", "user_id", "service_id",
                    "service_title"))


def quote_owner(quotes: DataFrame, requests: DataFrame) -> DataFrame:
    r = requests.select(F.col("id").alias("_rid"), "user_id")
    return (quotes.join(r, quotes["service_request_id"] == r["_rid"], "inner")
            .select("id", "user_id", F.col("_rid").alias("service_request_id")))


def request_detail(requests, services, users, messages, quotes, deliverables) -> DataFrame:
    """One nested document per request: header + messages (oldest first,
    with sender) + quote (or null) + deliverables (newest first).

    Each child is aggregated by request id *before* the join (so messages x
    deliverables never multiply); collect_list runs partially per map task."""
    header = request_header(requests, services, users).select(
        "id", "status", "brief", "created_at", "updated_at",
        F.struct(F.col("service_id").alias("id"), F.col("service_title").alias("title"),
                 F.col("service_slug").alias("slug")).alias("service"),
        F.struct(F.col("user_id").alias("id"), F.col("customer_name").alias("name"),
                 F.col("customer_email").alias("email")).alias("customer"))
    snd = users.select(F.col("id").alias("sender_id"), F.col("name").alias("sender_name"),
                       F.col("role").alias("sender_role"))
    msgs = (messages.join(snd, messages["sender_user_id"] == snd["sender_id"], "inner")
            .groupBy(F.col("service_request_id").alias("_m"))
            .agg(F.array_sort(F.collect_list(F.struct(
                "created_at", "id", "body", "attachments", "sender_id", "sender_name", "sender_role"))).alias("messages")))
    q = quotes.select(F.col("service_request_id").alias("_q"),
                      F.struct("id", "amount_cents", "notes", "status", "created_at").alias("quote"))
    dl = (deliverables.groupBy(F.col("service_request_id").alias("_d"))
          .agg(F.array_sort(F.collect_list(F.struct(
              (-wall_micros("created_at")).alias("_order"), (-F.col("id")).alias("_oid"),
              "id", "title", "description",
              "file_url", "created_at"))).alias("_dl")))
    out = (header.join(msgs, header["id"] == msgs["_m"], "left")
           .join(q, header["id"] == q["_q"], "left")
           .join(dl, header["id"] == dl["_d"], "left"))
    m_type = msgs.schema["messages"].dataType
    d_type = dl.schema["_dl"].dataType
    return out.select(
        "id", "status", "brief", "created_at", "updated_at", "service", "customer",
        F.coalesce("messages", F.array().cast(m_type)).alias("messages"),
        "quote",
        F.transform(F.coalesce("_dl", F.array().cast(d_type)), lambda x: x.dropFields("_order", "_oid")).alias("deliverables"))


def request_board(requests: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """Kanban board as rows: one row per card under its status column, and a
    status with no cards kept as a single row with null card and n = 0.

    Cards are not collected per status (a status column may hold a third of
    all requests); the board stays row-shaped and each status's count comes
    from a partial aggregate joined back through a broadcast of the 8-row
    status frame."""
    spark = requests.sparkSession
    statuses = spark.createDataFrame([(i, s) for i, s in enumerate(REQUEST_STATUSES)],
                                     "position int, status string")
    cards = request_header(requests, services, users).select(
        F.col("status").alias("_status"), F.col("id").alias("card_id"),
        F.col("service_title").alias("card_title"), F.col("customer_name").alias("card_subtitle"),
        F.col("created_at").alias("card_meta"))
    counts = cards.groupBy(F.col("_status").alias("_cstatus")).agg(F.count(F.lit(1)).alias("n"))
    # counts has one row per distinct status value: bounded by the status domain.
    cols = statuses.join(F.broadcast(counts), F.col("status") == F.col("_cstatus"), "left").select(
        "position", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    # Each card meets its column through a broadcast of the 8-row frame (no
    # shuffle of the cards); empty columns are added as one card-less row.
    filled = cards.join(F.broadcast(cols), cards["_status"] == cols["status"], "inner")
    empty = cols.where(F.col("n") == 0).select(
        "position", "status", "n", *[F.lit(None).cast(cards.schema[c].dataType).alias(c)
                                     for c in ("card_id", "card_title", "card_subtitle", "card_meta")])
    keep = ["position", "status", "n", "card_id", "card_title", "card_subtitle", "card_meta"]
    return filled.select(*keep).unionByName(empty.select(*keep))


def latest_quote(submissions: DataFrame) -> DataFrame:
    """One quote per request from many submissions, applied in (ts, id)
    order: the first submission keeps id and created_at, the last one sets
    amount and notes; status is ``sent``. Uses min/max of structs (partial
    aggregation, no per-request sort)."""
    return (submissions.groupBy("service_request_id")
            .agg(F.min(F.struct("submitted_at", "id")).alias("_first"),
                 F.max(F.struct("submitted_at", "id", "amount_cents", "notes")).alias("_last"),
                 F.count(F.lit(1)).alias("n_submissions"))
            .select(F.col("_first.id").alias("id"), "service_request_id",
                    F.col("_last.amount_cents").alias("amount_cents"), F.col("_last.notes").alias("notes"),
                    F.lit("sent").alias("status"), F.col("_first.submitted_at").alias("created_at"),
                    F.col("_last.submitted_at").alias("updated_at"), "n_submissions"))


def upsert_quotes(quotes: DataFrame, submissions: DataFrame) -> DataFrame:
    """INSERT .. ON CONFLICT (service_request_id) DO UPDATE as a full outer
    join: an existing quote keeps its id and created_at, takes the latest
    amount and notes, and goes back to ``sent`` even if it was accepted."""
    new = latest_quote(submissions).select(
        F.col("service_request_id").alias("_r"), F.col("id").alias("_nid"), F.col("amount_cents").alias("_amt"),
        F.col("notes").alias("_notes"), F.col("created_at").alias("_created"))
    j = quotes.join(new, quotes["service_request_id"] == new["_r"], "full_outer")
    hit = F.col("_r").isNotNull()
    return j.select(
        F.coalesce(F.col("id"), F.col("_nid")).alias("id"),
        F.coalesce(F.col("service_request_id"), F.col("_r")).alias("service_request_id"),
        F.when(hit, F.col("_amt")).otherwise(F.col("amount_cents")).alias("amount_cents"),
        F.when(hit, F.col("_notes")).otherwise(F.col("notes")).alias("notes"),
        F.when(hit, F.lit("sent")).otherwise(F.col("status")).alias("status"),
        F.coalesce(F.col("created_at"), F.col("_created")).alias("created_at"))
