"""Registered dashboard / aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.operators import stats
from mercato.plans.registry import register
from mercato.session import scratch_path
from mercato.sources.domain import load_tables, load_tables_from_binding


#: The time column of each domain table with rows; the items have none.
_TIMES = {t: "NULL" if t == "order_items" else "created_at" for t in (
    "users", "products", "services", "service_requests", "orders", "order_items", "messages", "quotes", "notifications",
    "deliverables", "audit_log")}


@register("load_tables", "\nUNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS n, count(DISTINCT id) AS ids, min(CAST(id AS VARCHAR)) AS least_id, "
     f"max(CAST(id AS VARCHAR)) AS greatest_id, CAST(min({at}) AS TIMESTAMP) AS oldest, CAST(max({at}) AS TIMESTAMP) AS newest "
     f"FROM d_{t}" for t, at in _TIMES.items()] + ["SELECT 'coaching_slots', 0, 0, NULL, NULL, NULL, NULL"]))
def q_load_tables(d):
    """The domain tables, written once and read back by ``load_tables``: rows, ids and times of each."""
    folder = scratch_path(d.spark, "tables")
    for name, df in load_tables_from_binding(d).items():
        df.write.parquet(f"{folder}/{name}")
    out = None
    for name, df in load_tables(d.spark, folder).items():
        at = F.expr(_TIMES.get(name, "starts_at")).cast("timestamp_ntz")
        part = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.col("id").cast("string")).alias("least_id"),
                      F.max(F.col("id").cast("string")).alias("greatest_id"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
        part = part.select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@register("count_entities", """
SELECT 'users' AS entity, count(*) AS n FROM d_users
UNION ALL SELECT 'products', count(*) FROM d_products
UNION ALL SELECT 'services', count(*) FROM d_services
""")
def q_count_entities(d):
    return stats.count_entities(d.users, d.products, d.services)


@register("count_open_requests", """
SELECT count(*) FILTER (WHERE status IN ('open','needs_info','quoted','in_progress')) AS open_requests
FROM d_service_requests
""")
def q_count_open_requests(d):
    return stats.count_open_requests(d.service_requests)


@register("paid_revenue", """
SELECT CAST(coalesce(sum(CASE WHEN status = 'paid' THEN CAST(total_cents AS BIGINT) END), 0) AS BIGINT) AS mock_revenue_cents
FROM d_orders
""")
def q_paid_revenue(d):
    return stats.paid_revenue(d.orders)


@register("admin_dashboard", """
SELECT (SELECT count(*) FROM d_users) AS users,
       (SELECT count(*) FROM d_products) AS products,
       (SELECT count(*) FROM d_services) AS services,
       (SELECT count(*) FROM d_service_requests WHERE status IN ('open','needs_info','quoted','in_progress')) AS open_requests,
       (SELECT CAST(coalesce(sum(CAST(total_cents AS BIGINT)), 0) AS BIGINT) FROM d_orders WHERE status = 'paid') AS mock_revenue_cents
""")
def q_admin_dashboard(d):
    """Flagship: the five dashboard numbers in one row."""
    return stats.dashboard_stats(d.users, d.products, d.services, d.service_requests, d.orders)


@register("recent_orders", """
SELECT id, total_cents, status, type, created_at FROM d_orders
ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 5
""")
def q_recent_orders(d):
    return stats.recent_orders(d.orders, 5)


@register("open_requests", """
SELECT id, user_id, service_id, status, created_at FROM d_service_requests
WHERE status IN ('open','needs_info','quoted','in_progress')
""")
def q_open_requests(d):
    return stats.open_requests(d.service_requests).select("id", "user_id", "service_id", "status", "created_at")


@register("paid_orders", """
SELECT id, user_id, total_cents, type, created_at FROM d_orders WHERE status = 'paid'
""")
def q_paid_orders(d):
    return stats.paid_orders(d.orders).select("id", "user_id", "total_cents", "type", "created_at")
