"""The reference's end-to-end flows as batch jobs over change tables.

Each flow takes the current domain tables (a dict of frames) and the
change tables of one batch, and returns the new tables plus what the flow
emits (outcomes, notifications). Nothing is written in place; a caller
persists the returned tables with ``sources.sinks.write_snapshot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import new_id
from mercato.operators import changes, guards, notify, orders, requests


def _append(table: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Append inserted rows to a table. Minted keys are strings while fixture
    keys are longs: where the two sides disagree on a column's type and one
    is a string, both are widened to string; otherwise rows take the
    table's type. Columns the rows lack are null."""
    r_types = dict(rows.dtypes)
    t_cols, r_cols = [], []
    for c, tt in table.dtypes:
        rt = r_types.get(c)
        if rt is None:
            t_cols.append(F.col(c))
            r_cols.append(F.lit(None).cast(tt).alias(c))
        elif rt == tt:
            t_cols.append(F.col(c))
            r_cols.append(F.col(c))
        elif "string" in (rt, tt):
            t_cols.append(F.col(c).cast("string").alias(c))
            r_cols.append(F.col(c).cast("string").alias(c))
        else:
            t_cols.append(F.col(c))
            r_cols.append(F.col(c).cast(tt).alias(c))
    return table.select(*t_cols).unionByName(rows.select(*r_cols))


def purchase_flow(t: dict[str, DataFrame], order_requests: DataFrame, lines: DataFrame, payments_by_seq: DataFrame):
    """Order, then pay: create orders (priced lines, all-or-nothing), then
    pay them (``payments_by_seq(order_seq, caller_id, paid_at)`` refers to
    the orders by their request seq). Returns (tables, order outcomes,
    notifications)."""
    new_orders, new_items, outcomes = orders.create_orders(order_requests, lines, t["products"], t["services"],
                                                           materialize=True)
    ids = outcomes.where(F.col("outcome") == "created").select("order_seq", "order_id")
    pays = payments_by_seq.join(ids, "order_seq", "inner").select("order_id", "caller_id", "paid_at")
    all_orders = _append(t["orders"], new_orders, "orders")
    checked = guards.payable_orders(pays, all_orders, t["users"])
    paid_orders, paid = orders.apply_payments(checked, all_orders)
    out = dict(t)
    out["orders"] = paid_orders
    out["order_items"] = _append(t["order_items"], new_items, "order_items")
    return out, outcomes, notify.order_ready(paid)


def service_flow(t: dict[str, DataFrame], new_requests: DataFrame, posts: DataFrame, quotes_in: DataFrame,
                 accepts: DataFrame, deliveries: DataFrame, now):
    """Request -> message -> quote -> accept (service order) -> deliverable.

    Steps run in that order within the batch, each reading the tables the
    previous step produced; every step's guards apply (customers only,
    owner or staff, staff only, owner accepts a sent/draft quote). Returns
    (tables, notifications)."""
    out = dict(t)
    created, _ = changes.create_requests(new_requests, out["users"], out["services"])
    out["service_requests"] = _append(out["service_requests"], created, "service_requests")

    msgs, mo = changes.post_messages(posts, out["service_requests"], out["users"])
    out["messages"] = _append(out["messages"], msgs, "messages")

    qo = changes.submit_quotes(quotes_in, out["service_requests"], out["users"]).where(F.col("outcome") == "accepted")
    subs = qo.select(F.col("seq").alias("id"), F.col("request_id").alias("service_request_id"), "amount_cents",
                     "notes", F.col("ts").alias("submitted_at"))
    out["quotes"] = requests.upsert_quotes(out["quotes"], subs)

    acc = guards.acceptable_quotes(accepts, out["quotes"], out["service_requests"], out["services"])
    acc = changes.first_claim(acc, "quote_id", "seq", F.col("outcome") == "accept")
    acc = acc.where((F.col("outcome") == "accept") & (F.col("seq") == F.col("_claim_order")))
    order_rows, item_rows = orders.order_from_quote(acc.select(
        F.col("seq").alias("quote_id"), "caller_id", "service_request_id", "amount_cents", "service_id", "ts"),
        out["services"])
    accepted_ids = acc.select(F.col("quote_id").alias("_a")).distinct()
    out["quotes"] = (out["quotes"].join(accepted_ids, F.col("id") == F.col("_a"), "left")
                     .withColumn("status", F.when(F.col("_a").isNotNull(), F.lit("accepted")).otherwise(F.col("status")))
                     .drop("_a"))
    out["orders"] = _append(out["orders"], order_rows, "orders")
    out["order_items"] = _append(out["order_items"], item_rows, "order_items")

    dls, dvo = changes.post_deliverables(deliveries, out["service_requests"], out["users"])
    out["deliverables"] = _append(out["deliverables"], dls, "deliverables")

    ev = lambda df, rid, status, ts, seq: df.select(
        F.col(rid).alias("request_id"), F.lit(status).alias("status"), F.col(ts).alias("ts"),
        F.col(seq).cast("long").alias("seq"))
    events = (ev(qo, "request_id", "quoted", "ts", "seq")
              .unionByName(ev(acc, "service_request_id", "in_progress", "ts", "seq"))
              .unionByName(ev(dvo.where(F.col("outcome") == "created"), "request_id", "delivered", "ts", "seq")))
    out["service_requests"] = changes.request_status(out["service_requests"], events)

    names = out["users"].select(F.col("id").alias("_u"), F.col("name").alias("caller_name"))
    acc_n = acc.join(names, acc["caller_id"] == names["_u"], "inner").select(
        "seq", "caller_name", "service_title", "service_request_id", new_id("quote-order", "seq").alias("order_id"), "ts")
    feed = notify.notification_feed(
        notify.message_posted(mo.where(F.col("outcome") == "created"), out["users"]),
        notify.quote_ready(qo, out["quotes"]),
        notify.quote_accepted(acc_n, out["users"]),
        notify.deliverable_posted(dvo.where(F.col("outcome") == "created")))
    return out, feed
