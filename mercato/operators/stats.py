"""Dashboard aggregates: entity counts, open requests, paid revenue, recent orders.

Each number is a global aggregate: partial counts/sums per task, one
tiny final merge, so the cost is one scan per table with no key shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import OPEN_REQUEST_STATUSES, newest_first


def open_requests(requests: DataFrame) -> DataFrame:
    """Requests still being worked on; ``paid``/``delivered`` are not open."""
    return requests.where(F.col("status").isin(list(OPEN_REQUEST_STATUSES)))


def paid_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") == "paid")


def count_entities(users: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """Row counts of users, products and services (inactive included)."""
    # A global aggregate keeps the row of an empty table (n = 0).
    parts =[df.select().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
             for name, df in (("users", users), ("products", products), ("services", services))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_open_requests(requests: DataFrame) -> DataFrame:
    return requests.select(
        F.count_if(F.col("status").isin(list(OPEN_REQUEST_STATUSES))).alias("open_requests"))


def paid_revenue(orders: DataFrame) -> DataFrame:
    """Sum of paid totals as bigint; no paid rows -> 0, never null."""
    return orders.select(
        F.coalesce(F.sum(F.when(F.col("status") == "paid", F.col("total_cents").cast("bigint"))),
                   F.lit(0).cast("bigint")).alias("mock_revenue_cents"))


def recent_orders(orders: DataFrame, k: int = 5) -> DataFrame:
    """Newest ``k`` orders overall (planned as TakeOrderedAndProject: each
    task keeps its own top k, the driver merges k x tasks rows)."""
    return (orders.select("id", "total_cents", "status", "type", "created_at")
            .orderBy(*newest_first()).limit(k))


def dashboard_stats(users: DataFrame, products: DataFrame, services: DataFrame,
                    requests: DataFrame, orders: DataFrame) -> DataFrame:
    """The five dashboard numbers in one row. Each number is an uncorrelated
    scalar subquery over its table (a global aggregate), so the row needs
    no join at all."""
    n = lambda df: df.select().agg(F.count(F.lit(1))).scalar()
    return users.sparkSession.range(1).select(
        n(users).alias("users"), n(products).alias("products"), n(services).alias("services"),
        count_open_requests(requests).scalar().alias("open_requests"),
        paid_revenue(orders).scalar().alias("mock_revenue_cents"))


def admin_dashboard(users, products, services, requests, orders, k: int = 5):
    """(stats row, newest k orders)."""
    return dashboard_stats(users, products, services, requests, orders), recent_orders(orders, k)
