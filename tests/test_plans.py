"""Plan shapes that matter at scale (checked with explain on sf0.001)."""

import re

from mercato.operators import feeds, limiter, orders, requests
from mercato.sources.binding import bind
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_per_user_topk_is_trimmed_before_the_shuffle(spark):
    d = bind(spark, SF_SMALL)
    p = plan(feeds.latest_notifications(d.notifications, 30))
    assert "WindowGroupLimit" in p


def test_order_list_takes_top_before_join(spark):
    d = bind(spark, SF_SMALL)
    p = plan(orders.orders_with_items(d.orders, d.order_items, limit=50))
    assert "TakeOrderedAndProject" in p


def test_board_does_not_collect_cards_per_status(spark):
    d = bind(spark, SF_SMALL)
    p = plan(requests.request_board(d.service_requests, d.services, d.users))
    assert "collect_list" not in p


def test_scan_reads_only_needed_columns(spark):
    d = bind(spark, SF_SMALL)
    df = d.orders.where("status = 'paid'").select("id", "total_cents")
    text = df._jdf.queryExecution().executedPlan().toString()
    read = text.split("ReadSchema")[-1]
    # the lazy view passes pruning through to the source scan
    assert "o_totalprice" in read and "o_orderdate" not in read and "o_custkey" not in read


def test_limiter_has_no_per_key_collect(spark):
    d = bind(spark, SF_SMALL)
    a = d.source("events").select("user_id", "event_id", "ts")
    out = limiter.attempt_limiter(a, "user_id", 3, "2 days", id_col="event_id")
    assert "collect_list" not in plan(out)


#: Entries that write (sinks, streams and their inputs), or run rounds of joins, while they are built.
EAGER = {"write_snapshot", "read_changes", "load_tables", "attempt_limiter", "attempt_limiter_stream", "attempt_limiter_late", "unread_stream",
         "request_status_stream", "notification_stream", "session_stream", "latest_session_stream", "delete_cascade", "pipeline",
         "accept_quotes", "answered_quotes", "patches_in_turn", "products_in_turn", "delete_cascade_rows"}


def test_building_a_query_starts_no_job(spark):
    import __spark_entry__ as E

    sc, bad = spark.sparkContext, []
    for name, q in sorted(E.queries().items()):
        if name in EAGER or re.match(r"op\d", name):
            continue
        sc.setJobGroup(f"build-{name}", name)
        q(spark, SF_SMALL)
        if sc.statusTracker().getJobIdsForGroup(f"build-{name}"):
            bad.append(name)
    sc.setJobGroup("tests", "tests")
    assert bad == []


def test_no_registered_query_pairs_rows_or_runs_row_python(spark):
    """Across every registered query: no cartesian product, no nested-loop
    join, no row-at-a-time Python UDF in the physical plan."""
    import __spark_entry__ as E

    bad = []
    for name, q in sorted(E.queries().items()):
        text = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            if op in text:
                bad.append((name, op))
    assert bad == []
