"""Hand-computed answers on the reference's seed data."""

import datetime as dt

from pyspark.sql import functions as F

from mercato.operators import catalog, feeds, orders, requests, stats


def test_dashboard_numbers(seed):
    row = stats.dashboard_stats(seed["users"], seed["products"], seed["services"], seed["service_requests"],
                                seed["orders"]).first()
    assert (row.users, row.products, row.services, row.open_requests, row.mock_revenue_cents) == (4, 6, 4, 2, 4900)


def test_revenue_of_no_rows_is_zero(seed):
    none = seed["orders"].where(F.lit(False))
    assert stats.paid_revenue(none).first().mock_revenue_cents == 0


def test_open_excludes_paid_and_delivered(spark, seed):
    extra = spark.createDataFrame([(90, 3, 21, "paid", "{}", None, None), (91, 3, 21, "delivered", "{}", None, None)],
                                  seed["service_requests"].schema)
    assert stats.count_open_requests(seed["service_requests"].unionByName(extra)).first()[0] == 2


def test_unread_of_customer1(seed):
    rows = {r.user_id: r.unread for r in feeds.unread_counts(seed["notifications"]).collect()}
    assert rows == {3: 1}


def test_order_list_nests_items_and_keeps_empty(spark, seed):
    empty = spark.createDataFrame([(72, 4, "pending", 0, "digital", dt.datetime(2024, 1, 2), None)],
                                  seed["orders"].schema)
    out = {r.id: r for r in orders.orders_with_items(seed["orders"].unionByName(empty), seed["order_items"]).collect()}
    assert [i.title for i in out[71].items] == ["Brand Style Guide Template"]
    assert out[72].items == []


def test_order_list_of_one_user(seed):
    out = orders.orders_with_items(seed["orders"], seed["order_items"], user_id=4).collect()
    assert out == []


def test_active_catalogue_newest_first(seed):
    slugs = [r.slug for r in catalog.active_products(seed["products"]).collect()]
    assert slugs[0] == "founder-finance-sheet" and len(slugs) == 6


def test_request_detail_document(seed):
    doc = {r.id: r for r in requests.request_detail(seed["service_requests"], seed["services"], seed["users"],
                                                    seed["messages"], seed["quotes"], seed["deliverables"]).collect()}
    assert [m.id for m in doc[31].messages] == [41, 42]
    assert doc[31].quote.amount_cents == 21000 and doc[32].quote is None
    assert doc[31].customer.name == "Customer One" and doc[31].service.slug == "conversion-copy"


def test_board_keeps_empty_columns(seed):
    rows = requests.request_board(seed["service_requests"], seed["services"], seed["users"]).collect()
    by_status = {}
    for r in rows:
        by_status.setdefault(r.status, []).append(r)
    assert len(by_status) == 8
    assert by_status["open"][0].n == 0 and by_status["open"][0].card_id is None
    assert [r.card_id for r in by_status["quoted"]] == [31]


def test_first_staff_is_oldest(seed):
    assert feeds.first_staff(seed["users"]).first().id == 1
    assert [r.id for r in feeds.staff_sample(seed["users"]).collect()] == [1, 2]
