"""The reference's manual flows as end-to-end batch jobs on the seed data."""

import datetime as dt

from pyspark.sql import functions as F

from mercato.operators import stats
from mercato.plans.workflows import purchase_flow, service_flow

T = dt.datetime(2024, 2, 1)


def test_purchase_then_pay(spark, seed):
    reqs = spark.createDataFrame([(1, 4, "digital", T), (2, 4, "digital", T)],
                                 "order_seq long, user_id long, type string, requested_at timestamp_ntz")
    lines = spark.createDataFrame([(1, 1, 12, None, 2), (1, 2, 13, None, 1), (2, 1, 999, None, 1)],
                                  "order_seq long, line_no int, product_id long, service_id long, quantity int")
    pays = spark.createDataFrame([(1, 4, T), (1, 4, T + dt.timedelta(minutes=5))],
                                 "order_seq long, caller_id long, paid_at timestamp_ntz")
    t, outcomes, notes = purchase_flow(seed, reqs, lines, pays)
    got = {r.order_seq: (r.outcome, r.reason, r.total_cents) for r in outcomes.collect()}
    assert got == {1: ("created", None, 3900 * 2 + 2900), 2: ("rejected", "product_not_found", None)}
    assert stats.paid_revenue(t["orders"]).first()[0] == 4900 + 10700
    assert [r.user_id for r in notes.collect()] == [4]
    assert t["order_items"].count() == 3


def test_service_request_lifecycle(spark, seed):
    new_req = spark.createDataFrame([(1, 4, 21, '{"goal":"launch"}', T), (2, 1, 21, '{"x":1}', T)],
                                    "seq long, user_id long, service_id long, brief string, ts timestamp_ntz")
    from mercato.functions.columns import new_id

    rid = spark.range(1).select(new_id("request", F.lit(1)).alias("r")).first().r
    posts = spark.createDataFrame([(10, rid, 4, "Hello", None, T + dt.timedelta(minutes=1))],
                                  "seq long, request_id string, sender_id long, body string, attachments array<string>, ts timestamp_ntz")
    quotes_in = spark.createDataFrame([(20, rid, 2, 30000, "first cut", T + dt.timedelta(minutes=2))],
                                      "seq long, request_id string, actor_id long, amount_cents int, notes string, ts timestamp_ntz")
    accepts = spark.createDataFrame([(30, 20, 4, T + dt.timedelta(minutes=3))],
                                    "seq long, quote_id long, caller_id long, ts timestamp_ntz")
    deliveries = spark.createDataFrame([(40, rid, 1, "Final deck", None, "https://files.example.com/deck.pdf",
                                         T + dt.timedelta(minutes=4))],
                                       "seq long, request_id string, actor_id long, title string, description string, file_url string, ts timestamp_ntz")
    # Ids of the seed tables are long, minted ones are strings: widen the seed keys for this flow.
    tables = {k: (v.withColumn("id", F.col("id").cast("string")) if k in ("service_requests",) else v)
              for k, v in seed.items()}
    for k in ("messages", "quotes", "deliverables"):
        tables[k] = tables[k].withColumn("service_request_id", F.col("service_request_id").cast("string"))
    tables["orders"] = tables["orders"].withColumn("service_request_id", F.col("service_request_id").cast("string"))
    t, feed = service_flow(tables, new_req, posts, quotes_in, accepts, deliveries, T)
    req = t["service_requests"].where(F.col("id") == rid).first()
    assert req.status == "delivered" and req.user_id == 4
    assert t["service_requests"].count() == 3                 # the admin's request was refused
    q = t["quotes"].where(F.col("service_request_id") == rid).first()
    assert (q.id, q.status, q.amount_cents) == (20, "accepted", 30000)
    order = t["orders"].where(F.col("type") == "service").first()
    assert (order.total_cents, order.status, order.service_request_id) == (30000, "pending", rid)
    kinds = sorted((r.branch, r.user_id) for r in feed.collect())
    assert kinds == [("deliverable_posted", 4), ("message_posted", 1), ("quote_accepted", 1), ("quote_accepted", 2),
                     ("quote_ready", 4)]
