"""Order reads (nested order lists) and order writes (pricing, totals, creation,
payments, orders from accepted quotes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import INT_MAX, ORDER_TYPES, new_id, newest_first
from mercato.operators.topk import top_k_per_key

ORDER_COLS = ["id", "total_cents", "status", "type", "created_at", "service_request_id"]
ITEM_FIELDS = ["title", "id", "unit_price_cents", "quantity", "subtotal_cents", "product_id", "service_id"]


def item_struct(prefix: str = "") -> Column:
    """Item as a struct whose first fields are (title, id): sorting the
    structs orders items by title, ties by id."""
    return F.struct(*[F.col(prefix + f).alias(f) for f in ITEM_FIELDS])


def order_item_array(items: DataFrame) -> DataFrame:
    """(order_id, items): items of each order as an array sorted by title.

    collect_list is aggregated partially on the map side (one partial list
    per task and order), so the exchange carries per-task lists, and the
    final array is exactly the output row."""
    return (items.groupBy("order_id")
            .agg(F.array_sort(F.collect_list(item_struct())).alias("items")))


def _nest(top: DataFrame, items: DataFrame) -> DataFrame:
    nested = order_item_array(items)
    empty = F.array().cast(nested.schema["items"].dataType)
    return (top.join(nested, top["id"] == nested["order_id"], "left")
            .select(*[top[c] for c in top.columns],
                    F.coalesce(nested["items"], empty).alias("items")))


def orders_with_items(orders: DataFrame, items: DataFrame, user_id=None, limit: int = 50) -> DataFrame:
    """Newest ``limit`` orders (all, or one user's) with their items nested.

    Limit before join: the left join to a per-order aggregate is 1:1, so the
    top orders are picked first (TakeOrderedAndProject), their ids (``limit``
    rows, a proven bound) are broadcast to cut the items scan down, and only
    those items are nested."""
    o = orders if user_id is None else orders.where(F.col("user_id") == F.lit(user_id))
    top = o.select(*ORDER_COLS).orderBy(*newest_first()).limit(limit)
    ids = F.broadcast(top.select(F.col("id").alias("_oid")))
    wanted = items.join(ids, items["order_id"] == ids["_oid"], "left_semi")
    return _nest(top, wanted)


def latest_orders_per_user(orders: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` orders of every user (the ``mine`` list for all users)."""
    return top_k_per_key(orders.select("user_id", *ORDER_COLS), ["user_id"], newest_first(), k)


def latest_orders_with_items(orders: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Every user's order list with nested items: top-k per user first, then
    a semi join of items to those orders (a shuffle join: the kept orders
    grow with the data, so nothing is broadcast here)."""
    top = latest_orders_per_user(orders, k)
    wanted = items.join(top.select(F.col("id").alias("_oid")), items["order_id"] == F.col("_oid"), "left_semi")
    return _nest(top, wanted)


# ---------------------------------------------------------------- writes

def price_lines(lines: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """Attach title and unit price to order lines from the product **or**
    service they name. Outcome per line, in the reference's order:
    bad_quantity > no_key > both_keys > product_not_found /
    service_not_found (unknown or inactive) > overflow (subtotal beyond
    INTEGER) > ok. Replaces one lookup query per item with two joins."""
    p = products.where(F.col("is_active")).select(
        F.col("id").alias("_pid"), F.col("title").alias("_ptitle"), F.col("price_cents").alias("_pprice"))
    s = services.where(F.col("is_active")).select(
        F.col("id").alias("_sid"), F.col("title").alias("_stitle"), F.col("base_price_cents").alias("_sprice"))
    # Most lines lack one of the two keys: such rows get a spread key that the
    # second condition lets match nothing, so they do not meet in one task.
    spread = -1 - F.pmod(F.xxhash64("order_seq", "line_no"), F.lit(1 << 20))
    key = lambda c: F.coalesce(F.col(c), spread.cast(lines.schema[c].dataType))
    j = (lines.join(p, (key("product_id") == p["_pid"]) & lines["product_id"].isNotNull(), "left")
         .join(s, (key("service_id") == s["_sid"]) & F.col("service_id").isNotNull(), "left"))
    has_p, has_s = F.col("product_id").isNotNull(), F.col("service_id").isNotNull()
    unit = F.when(has_p, F.col("_pprice")).otherwise(F.col("_sprice"))
    subtotal = unit.cast("bigint") * F.col("quantity").cast("bigint")
    outcome = (F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), "bad_quantity")
               .when(~has_p & ~has_s, "no_key")
               .when(has_p & has_s, "both_keys")
               .when(has_p & F.col("_pid").isNull(), "product_not_found")
               .when(has_s & ~has_p & F.col("_sid").isNull(), "service_not_found")
               .when(subtotal > INT_MAX, "overflow")
               .otherwise("ok"))
    ok = outcome == "ok"
    return (j.withColumn("outcome", outcome)
            .withColumn("title", F.when(ok, F.when(has_p, F.col("_ptitle")).otherwise(F.col("_stitle"))))
            .withColumn("unit_price_cents", F.when(ok, unit))
            .withColumn("subtotal_cents", F.when(ok, subtotal))
            .drop("_pid", "_ptitle", "_pprice", "_sid", "_stitle", "_sprice"))


def order_totals(priced: DataFrame, order_key: str = "order_seq", line_key: str = "line_no") -> DataFrame:
    """Per order: total (bigint), line count and the reject reason. Payload
    errors (a bad quantity anywhere) come first, as the whole body is
    validated before any lookup; otherwise the first failing line (by line
    number) decides; a total beyond INTEGER is rejected as overflow."""
    bad = F.col("outcome") != "ok"
    agg = priced.groupBy(order_key).agg(
        F.sum("subtotal_cents").alias("total_cents"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(F.col("outcome") == "bad_quantity").alias("_badq"),
        F.min(F.when(bad, F.struct(F.col(line_key).alias("l"), F.col("outcome").alias("o")))).alias("_first"))
    reason = (F.when(F.col("_badq"), F.lit("bad_quantity"))
              .when(F.col("_first").isNotNull(), F.col("_first.o"))
              .when(F.col("total_cents") > INT_MAX, F.lit("overflow")))
    return agg.withColumn("reason", reason).drop("_badq", "_first")


def _batch(batch: str | None) -> list:
    return [] if batch is None else [F.lit(batch)]


def create_orders(requests: DataFrame, lines: DataFrame, products: DataFrame, services: DataFrame,
                  materialize: bool = False, batch: str | None = None):
    """requests(order_seq, user_id, type, requested_at) + lines(order_seq,
    line_no, product_id, service_id, quantity) -> (orders, items, outcomes).

    All-or-nothing per order. New ids are sha256 of the natural key: ``batch``
    (give one wherever order_seq starts again) and order_seq; for items also
    the line number and, as line numbers may repeat, a running number. The
    three outputs share the priced lines; with ``materialize`` (for callers
    that write all three) they are written once to the shared checkpoint
    folder instead of re-running the pricing joins per output."""
    priced = price_lines(lines, products, services)
    if materialize:
        from mercato.session import scratch_path

        path = scratch_path(priced.sparkSession, "priced-lines")
        priced.write.parquet(path)
        priced = priced.sparkSession.read.schema(priced.schema).parquet(path)
    totals = order_totals(priced)
    r = requests.join(totals, "order_seq", "left")
    reason = (F.when(~F.col("type").isin(list(ORDER_TYPES)) | F.col("type").isNull(), "bad_type")
              .when(F.col("n_lines").isNull(), "no_items")
              .otherwise(F.col("reason")))
    outcomes = (r.withColumn("reason", reason)
                .withColumn("outcome", F.when(F.col("reason").isNull(), "created").otherwise("rejected"))
                .withColumn("order_id", F.when(F.col("reason").isNull(), new_id("order", *_batch(batch), "order_seq")))
                .select("order_seq", "user_id", "type", "requested_at", "outcome", "reason", "order_id",
                        F.when(F.col("reason").isNull(), F.col("total_cents").cast("int")).alias("total_cents"),
                        "n_lines"))
    created = outcomes.where(F.col("outcome") == "created")
    orders = created.select(F.col("order_id").alias("id"), "user_id", F.lit("pending").alias("status"),
                            "total_cents", "type", F.col("requested_at").alias("created_at"),
                            F.lit(None).cast("long").alias("service_request_id"))
    same = Window.partitionBy("order_seq", "line_no").orderBy(
        *[F.col(c).asc_nulls_first() for c in ("product_id", "service_id", "quantity", "title", "unit_price_cents")])
    items = (priced.withColumn("_copy", F.row_number().over(same)).join(created.select("order_seq", "order_id"), "order_seq", "inner")
             .select(new_id("item", *_batch(batch), "order_seq", "line_no", "_copy").alias("id"), "order_id", "product_id", "service_id",
                     "title", "unit_price_cents", "quantity", F.col("subtotal_cents").cast("int").alias("subtotal_cents")))
    return orders, items, outcomes


def order_from_quote(accepted: DataFrame, services: DataFrame):
    """Accepted quotes -> (pending service orders, one item each).

    ``accepted`` carries (quote_id, caller_id, service_request_id,
    amount_cents, service_id, ts). Total = amount, quantity 1, item title =
    service title."""
    s = services.select(F.col("id").alias("_sid"), F.col("title").alias("service_title"))
    a = accepted.join(s, accepted["service_id"] == s["_sid"], "left").drop("_sid")
    oid = new_id("quote-order", "quote_id")
    orders = a.select(oid.alias("id"), F.col("caller_id").alias("user_id"), F.lit("pending").alias("status"),
                      F.col("amount_cents").alias("total_cents"), F.lit("service").alias("type"),
                      F.col("ts").alias("created_at"), "service_request_id")
    items = a.select(new_id("quote-item", "quote_id").alias("id"), oid.alias("order_id"),
                     F.lit(None).cast("long").alias("product_id"), "service_id",
                     F.col("service_title").alias("title"), F.col("amount_cents").alias("unit_price_cents"),
                     F.lit(1).alias("quantity"), F.col("amount_cents").alias("subtotal_cents"))
    return orders, items


def apply_payments(checked: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """checked = ``payable_orders`` output. The first permitted payment of an
    order (by paid_at, caller) pays it; later ones and orders already paid
    are no-ops (no second notification). Canceled/refunded orders are set
    to paid too (the reference has no guard).

    Returns (new orders table, paid events(order_id, owner_id, order_type,
    service_request_id, paid_at))."""
    first = (checked.where(F.col("outcome") == "pay")
             .groupBy("order_id")
             .agg(F.min(F.struct("paid_at", "caller_id")).alias("_first"),
                  F.first("owner_id").alias("owner_id"), F.first("order_type").alias("order_type"),
                  F.first("service_request_id").alias("service_request_id"))
             .select("order_id", "owner_id", "order_type", "service_request_id",
                     F.col("_first.paid_at").alias("paid_at"), F.col("_first.caller_id").alias("caller_id")))
    paid_ids = first.select(F.col("order_id").alias("_paid"))
    new_orders = (orders.join(paid_ids, orders["id"] == paid_ids["_paid"], "left")
                  .withColumn("status", F.when(F.col("_paid").isNotNull(), F.lit("paid")).otherwise(F.col("status")))
                  .drop("_paid"))
    return new_orders, first
