"""Registered order queries: nested lists, per-user top-k, pricing, creation,
payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.operators import guards, orders
from mercato.plans.registry import register


def items_canon(col: str = "items"):
    """Nested items, all fields, as one comparable string (title:id:price:...|...)."""
    return F.array_join(F.transform(F.col(col), lambda x: F.concat_ws(
        ":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in orders.ITEM_FIELDS])), "|")


_ITEM_LINE = "concat_ws(':', " + ", ".join(f"coalesce(CAST(i.{f} AS VARCHAR), '-')" for f in orders.ITEM_FIELDS) + ")"
_ITEMS_AGG = f"""count(i.id) AS n_items,
       coalesce(string_agg({_ITEM_LINE}, '|' ORDER BY i.title, i.id) FILTER (WHERE i.id IS NOT NULL), '') AS items_canon"""


@register("orders_with_items", f"""
SELECT t.id, t.total_cents, t.status, t.type, t.created_at, t.service_request_id, {_ITEMS_AGG}
FROM top50 t LEFT JOIN d_order_items i ON i.order_id = t.id
GROUP BY t.id, t.total_cents, t.status, t.type, t.created_at, t.service_request_id
""", ("top50", """SELECT id, total_cents, status, type, created_at, service_request_id FROM d_orders
     ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 50"""))
def q_orders_with_items(d):
    """Newest 50 orders with nested items (items compared as a canonical string)."""
    out = orders.orders_with_items(d.orders, d.order_items, limit=50)
    return out.select(*orders.ORDER_COLS, F.size("items").cast("bigint").alias("n_items"),
                      items_canon().alias("items_canon"))


@register("order_item_array", f"""
SELECT i.order_id, {_ITEMS_AGG}
FROM d_order_items i GROUP BY i.order_id
""")
def q_order_item_array(d):
    out = orders.order_item_array(d.order_items)
    return out.select("order_id", F.size("items").cast("bigint").alias("n_items"), items_canon().alias("items_canon"))


@register("latest_orders_per_user", """
SELECT user_id, id, total_cents, status, type, created_at, service_request_id,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS rank
FROM d_orders
QUALIFY rank <= 50
""")
def q_latest_orders_per_user(d):
    return orders.latest_orders_per_user(d.orders, 50)


@register("latest_orders_with_items", f"""
SELECT t.user_id, t.id, t.total_cents, t.status, t.type, t.created_at, t.service_request_id, t.rank, {_ITEMS_AGG}
FROM top t LEFT JOIN d_order_items i ON i.order_id = t.id
GROUP BY t.user_id, t.id, t.total_cents, t.status, t.type, t.created_at, t.service_request_id, t.rank
""", ("top", """SELECT user_id, id, total_cents, status, type, created_at, service_request_id,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS rank
FROM d_orders QUALIFY rank <= 50"""))
def q_latest_orders_with_items(d):
    """Every user's order list (newest 50) with nested items."""
    out = orders.latest_orders_with_items(d.orders, d.order_items, 50)
    return out.select("user_id", *orders.ORDER_COLS, "rank", F.size("items").cast("bigint").alias("n_items"),
                      items_canon().alias("items_canon"))


PRICED = ("priced", """
SELECT l.order_seq, l.line_no, l.product_id, l.service_id, l.quantity,
       CASE WHEN l.quantity IS NULL OR l.quantity <= 0 THEN 'bad_quantity'
            WHEN l.product_id IS NULL AND l.service_id IS NULL THEN 'no_key'
            WHEN l.product_id IS NOT NULL AND l.service_id IS NOT NULL THEN 'both_keys'
            WHEN l.product_id IS NOT NULL AND p.id IS NULL THEN 'product_not_found'
            WHEN l.product_id IS NULL AND s.id IS NULL THEN 'service_not_found'
            WHEN CAST(CASE WHEN l.product_id IS NOT NULL THEN p.price_cents ELSE s.base_price_cents END AS BIGINT)
                 * CAST(l.quantity AS BIGINT) > 2147483647 THEN 'overflow'
            ELSE 'ok' END AS outcome,
       CASE WHEN l.product_id IS NOT NULL THEN p.title ELSE s.title END AS title0,
       CASE WHEN l.product_id IS NOT NULL THEN p.price_cents ELSE s.base_price_cents END AS unit0
FROM d_order_lines l
LEFT JOIN (SELECT * FROM d_products WHERE is_active) p ON p.id = l.product_id
LEFT JOIN (SELECT * FROM d_services WHERE is_active) s ON s.id = l.service_id
""")

PRICED_OUT = ("priced_out", """
SELECT order_seq, line_no, product_id, service_id, quantity, outcome,
       CASE WHEN outcome = 'ok' THEN title0 END AS title,
       CASE WHEN outcome = 'ok' THEN unit0 END AS unit_price_cents,
       CASE WHEN outcome = 'ok' THEN CAST(unit0 AS BIGINT) * CAST(quantity AS BIGINT) END AS subtotal_cents
FROM priced
""")

TOTALS = ("totals", """
SELECT order_seq, CAST(sum(subtotal_cents) AS BIGINT) AS total_cents, count(*) AS n_lines,
       CASE WHEN bool_or(outcome = 'bad_quantity') THEN 'bad_quantity'
            WHEN bool_or(outcome <> 'ok') THEN substr(min(CASE WHEN outcome <> 'ok'
                 THEN lpad(CAST(line_no AS VARCHAR), 10, '0') || outcome END), 11)
            WHEN sum(subtotal_cents) > 2147483647 THEN 'overflow' END AS reason
FROM priced_out GROUP BY order_seq
""")


@register("price_lines", "SELECT * FROM priced_out", PRICED, PRICED_OUT)
def q_price_lines(d):
    return orders.price_lines(d.order_lines, d.products, d.services)


@register("order_totals", "SELECT * FROM totals", PRICED, PRICED_OUT, TOTALS)
def q_order_totals(d):
    return orders.order_totals(orders.price_lines(d.order_lines, d.products, d.services))


@register("create_orders", """
SELECT r.order_seq, r.user_id, r.type, r.requested_at,
       CASE WHEN x.reason IS NULL THEN 'created' ELSE 'rejected' END AS outcome, x.reason,
       CASE WHEN x.reason IS NULL THEN sha256(concat_ws('~', 'order', CAST(r.order_seq AS VARCHAR))) END AS order_id,
       CASE WHEN x.reason IS NULL THEN CAST(t.total_cents AS INT) END AS total_cents, t.n_lines
FROM d_order_requests r LEFT JOIN totals t ON t.order_seq = r.order_seq
CROSS JOIN LATERAL (SELECT CASE WHEN r.type IS NULL OR r.type NOT IN ('digital', 'service', 'coaching') THEN 'bad_type'
                                WHEN t.n_lines IS NULL THEN 'no_items' ELSE t.reason END AS reason) x
""", PRICED, PRICED_OUT, TOTALS)
def q_create_orders(d):
    """Per order request: created (with minted id and total) or rejected with reason."""
    _, _, outcomes = orders.create_orders(d.order_requests, d.order_lines, d.products, d.services)
    return outcomes


@register("create_order_items", """
SELECT sha256(concat_ws('~', 'item', CAST(p.order_seq AS VARCHAR), CAST(p.line_no AS VARCHAR),
              CAST(row_number() OVER (PARTITION BY p.order_seq, p.line_no ORDER BY p.product_id NULLS FIRST,
                   p.service_id NULLS FIRST, p.quantity NULLS FIRST, p.title NULLS FIRST,
                   p.unit_price_cents NULLS FIRST) AS VARCHAR))) AS id,
       sha256(concat_ws('~', 'order', CAST(p.order_seq AS VARCHAR))) AS order_id,
       p.product_id, p.service_id, p.title, p.unit_price_cents, p.quantity, CAST(p.subtotal_cents AS INT) AS subtotal_cents
FROM priced_out p JOIN totals t ON t.order_seq = p.order_seq
JOIN d_order_requests r ON r.order_seq = p.order_seq
WHERE t.reason IS NULL AND r.type IN ('digital', 'service', 'coaching')
""", PRICED, PRICED_OUT, TOTALS)
def q_create_order_items(d):
    """Item rows inserted for the created orders (all-or-nothing per order)."""
    _, items, _ = orders.create_orders(d.order_requests, d.order_lines, d.products, d.services)
    return items


@register("apply_payments", """
SELECT o.id, o.user_id, CASE WHEN f.order_id IS NOT NULL THEN 'paid' ELSE o.status END AS status,
       o.total_cents, o.type
FROM d_orders o LEFT JOIN (SELECT DISTINCT order_id FROM checked WHERE outcome = 'pay') f ON f.order_id = o.id
""", ("checked", """
SELECT p.order_id,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN o.id IS NULL THEN 'not_found'
            WHEN o.user_id <> p.caller_id AND u.role = 'customer' THEN 'forbidden'
            WHEN o.status = 'paid' THEN 'already_paid' ELSE 'pay' END AS outcome
FROM d_payments p LEFT JOIN d_users u ON u.id = p.caller_id LEFT JOIN d_orders o ON o.id = p.order_id
"""))
def q_apply_payments(d):
    """Orders table after the payment batch."""
    checked = guards.payable_orders(d.payments, d.orders, d.users)
    new_orders, _ = orders.apply_payments(checked, d.orders)
    return new_orders.select("id", "user_id", "status", "total_cents", "type")
