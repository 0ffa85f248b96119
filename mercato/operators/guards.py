"""Guards in front of state changes: who may pay an order, accept a quote.

Each returns the input rows with an ``outcome`` decided by a ``when`` chain
in the reference's order of checks. Joins are equi joins on keys; the user
side is reduced to (id, role) before joining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _callers(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("_caller"), F.col("role").alias("caller_role"))


def payable_orders(payments: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """payments(order_id, caller_id, ...) -> + outcome in
    unauthorized (caller unknown) > not_found > forbidden (foreign order and
    caller is a customer) > already_paid > pay. Also carries the order's
    owner, type, status and request id."""
    o = orders.select(F.col("id").alias("_order"), F.col("user_id").alias("owner_id"),
                      F.col("status").alias("order_status"), F.col("type").alias("order_type"),
                      "service_request_id")
    c = _callers(users)
    j = (payments.join(c, payments["caller_id"] == c["_caller"], "left")
         .join(o, payments["order_id"] == o["_order"], "left"))
    outcome = (F.when(F.col("_caller").isNull(), "unauthorized")
               .when(F.col("_order").isNull(), "not_found")
               .when((F.col("owner_id") != F.col("caller_id")) & (F.col("caller_role") == "customer"), "forbidden")
               .when(F.col("order_status") == "paid", "already_paid")
               .otherwise("pay"))
    return j.withColumn("outcome", outcome).drop("_caller", "_order")


def acceptable_quotes(accepts: DataFrame, quotes: DataFrame, requests: DataFrame,
                      services: DataFrame) -> DataFrame:
    """accepts(quote_id, caller_id, ...) -> + outcome in
    not_found (no quote, or its request or service is gone) > forbidden
    (caller does not own the request) > bad_state (status not sent/draft) >
    accept. Carries the service title for the order item and notice."""
    q = quotes.select(F.col("id").alias("_quote"), "service_request_id", "amount_cents",
                      F.col("status").alias("quote_status"))
    r = requests.select(F.col("id").alias("_req"), F.col("user_id").alias("owner_id"), "service_id")
    s = services.select(F.col("id").alias("_svc"), F.col("title").alias("service_title"))
    qr = (q.join(r, q["service_request_id"] == r["_req"], "inner").drop("_req")
          .join(s, F.col("service_id") == s["_svc"], "inner").drop("_svc"))
    j = accepts.join(qr, accepts["quote_id"] == qr["_quote"], "left")
    outcome = (F.when(F.col("_quote").isNull(), "not_found")
               .when(F.col("owner_id") != F.col("caller_id"), "forbidden")
               .when(~F.col("quote_status").isin("sent", "draft"), "bad_state")
               .otherwise("accept"))
    return j.withColumn("outcome", outcome).drop("_quote")


#: Who may make each admin write. The roles are the access rules'.
ADMIN_WRITES = {"product": ("admin", "editor"), "service": ("admin", "editor"), "user": ("admin",), "broadcast": ("admin",)}


def admin_writes(rows: DataFrame, users: DataFrame, kind: str, caller: str = "caller_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose caller may write, refused rows with an ``outcome``):
    unauthorized where the caller is missing or unknown, forbidden where the
    role may not. Put it in front of catalogue inserts, patches, user writes,
    deletes and broadcasts. Rows without a caller stay out of the join, so
    they do not meet in one task."""
    c = _callers(users)
    known = rows.where(F.col(caller).isNotNull()).join(c, F.col(caller) == c["_caller"], "left")
    outcome = (F.when(F.col("_caller").isNull(), "unauthorized")
               .when(~F.coalesce(F.col("caller_role").isin(*ADMIN_WRITES[kind]), F.lit(False)), "forbidden"))
    known = known.withColumn("outcome", outcome)
    refused = known.where(F.col("outcome").isNotNull()).select(*rows.columns, "outcome")
    missing = rows.where(F.col(caller).isNull()).withColumn("outcome", F.lit("unauthorized"))
    return known.where(F.col("outcome").isNull()).select(*rows.columns), refused.unionByName(missing)
