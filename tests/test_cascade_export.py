"""Deletes of all kinds at once against a loop over the references; the export as rows."""

import datetime as dt
import glob
import json

from pyspark.sql import functions as F

from mercato.operators import cascade, export
from mercato.operators.integrity import REFERENCES
from mercato.session import scratch_path

T = dt.datetime(2024, 1, 1)


def made(spark):
    """Ten users; user 1 has a third of all requests, orders and notifications."""
    owner = lambda i: 1 if i % 3 == 0 else i % 10
    sql = spark.createDataFrame
    return {
        "users": sql([(i, f"u{i}@x.io", f"n{i}", "customer", T) for i in range(10)],
                     "id long, email string, name string, role string, created_at timestamp_ntz"),
        "services": sql([(i, f"s{i}") for i in range(4)], "id long, slug string"),
        "products": sql([(i, f"p{i}") for i in range(5)], "id long, slug string"),
        "service_requests": sql([(i, owner(i), i % 4, "open", "{}", T, T, "extra") for i in range(40)],
                                "id long, user_id long, service_id long, status string, brief string, "
                                "created_at timestamp_ntz, updated_at timestamp_ntz, key string"),
        "orders": sql([(i, owner(i + 1), "paid", 5, "digital", T, i % 50 if i % 2 else None) for i in range(60)],
                      "id long, user_id long, status string, total_cents int, type string, created_at timestamp_ntz, "
                      "service_request_id long"),
        "order_items": sql([(f"i{i}", i % 60, i % 5 if i % 2 else None, None if i % 2 else i % 4, "t", 1, 1, 1) for i in range(120)],
                           "id string, order_id long, product_id long, service_id long, title string, unit_price_cents int, "
                           "quantity int, subtotal_cents int"),
        "messages": sql([(i, i % 40, owner(i + 2), None if i % 5 == 0 else 'a "b"\n', ["x"], T) for i in range(80)],
                        "id long, service_request_id long, sender_user_id long, body string, attachments array<string>, "
                        "created_at timestamp_ntz"),
        "quotes": sql([(i, i, 5, None, "sent", T) for i in range(40)],
                      "id long, service_request_id long, amount_cents int, notes string, status string, created_at timestamp_ntz"),
        "notifications": sql([(i, owner(i), "order", "t", "b", "{}", None, T) for i in range(90)],
                             "id long, user_id long, type string, title string, body string, meta string, "
                             "read_at timestamp_ntz, created_at timestamp_ntz"),
        "deliverables": sql([(i, i % 40, "t", None, "http://x", T) for i in range(30)],
                            "id long, service_request_id long, title string, description string, file_url string, "
                            "created_at timestamp_ntz"),
        "audit_log": sql([(i, None if i % 4 == 0 else i % 10, "a", "user", i, "{}", T) for i in range(20)],
                         "id long, actor_user_id long, action string, entity string, entity_id long, meta string, "
                         "created_at timestamp_ntz"),
    }


def by_loop(tables, doomed):
    gone, rows = set(doomed), {k: [r.asDict() for r in df.collect()] for k, df in tables.items()}
    grown = True
    while grown:
        grown = False
        for (child, c), parent in REFERENCES.items():
            for r in rows.get(child, []):
                if (child, c) not in cascade.SET_NULL and (parent, r[c]) in gone and (child, r["id"]) not in gone:
                    gone.add((child, r["id"]))
                    grown = True
    out = {}
    for k, table in rows.items():
        kept = [dict(r) for r in table if (k, r["id"]) not in gone]
        for r in kept:
            for (child, c), parent in REFERENCES.items():
                if child == k and (parent, r[c]) in gone:
                    r[c] = None
        out[k] = sorted(kept, key=lambda r: str(r["id"]))
    return out


def deleted(spark, tables, doomed, **how):
    keys = spark.createDataFrame([(t, k) for t, k in doomed], "table string, key long")
    got = cascade.delete_all(tables, keys, **how)
    assert {k: df.columns for k, df in got.items()} == {k: df.columns for k, df in tables.items()}
    return {k: sorted((r.asDict() for r in df.collect()), key=lambda r: str(r["id"])) for k, df in got.items()}


def test_all_kinds_at_once_equal_a_loop(spark):
    tables = made(spark)
    doomed = [("users", 1), ("users", 4), ("services", 2), ("products", 3), ("users", 1), ("users", 777)]
    want = by_loop(tables, doomed)
    assert len(want["orders"]) < 45 and any(r["service_request_id"] is None for r in want["orders"] if r["id"] % 2)
    assert deleted(spark, tables, [*doomed, ("users", None)]) == want


def test_nothing_goes_without_keys_and_the_actor_stays(spark):
    tables = made(spark)
    same = by_loop(tables, [])
    assert deleted(spark, tables, []) == same
    assert deleted(spark, tables, [("users", 5)], actor_id=5) == same


def test_export_rows_hold_everything(spark):
    tables = made(spark)
    rows = export.export_rows(tables)
    got = {(r.section, r.row_id): r for r in rows.collect()}
    count = {s: tables[t].count() for s, (t, *_) in export.SECTIONS.items()}
    count["audit"] -= 5  # without an actor
    assert {s: sum(k[0] == s for k in got) for s in count} == count
    body = json.loads(got["message", "1"].payload)
    assert body == {"service_request_id": 1, "body": 'a "b"\n', "attachments": ["x"]} and got["message", "1"].user_id == 1
    assert json.loads(got["message", "0"].payload)["body"] is None
    assert got["quote", "5"].user_id == tables["service_requests"].where("id = 5").first().user_id
    some = export.export_rows(tables, spark.createDataFrame([(4,), (4,), (99,)], "id long"))
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in got.values() if r.user_id == 4}
    assert export.export_rows(tables, spark.createDataFrame([], "id long")).isEmpty()


def test_a_large_history_spreads_over_files(spark):
    tables = made(spark)
    tables["notifications"] = spark.range(30_000).selectExpr(
        "id", "1L AS user_id", "'order' AS type", "'t' AS title", "'b' AS body", "'{}' AS meta",
        "CAST(NULL AS timestamp_ntz) AS read_at", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS created_at")
    path = scratch_path(spark, "export")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        export.write_export(export.export_rows(tables), path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    back = spark.read.parquet(path)
    assert back.count() == export.export_rows(tables).count()
    files = back.where("user_id = 1").groupBy(F.input_file_name().alias("f")).agg(F.min("at"), F.max("at")).count()
    assert files >= 4 and len(glob.glob(f"{path}/*.parquet")) >= 8


def test_export_makes_payloads_after_the_user_is_known(spark):
    """JSON texts were made below the join to the user, and moved by it; items meet their orders as bare lines."""
    from mercato.plans import q_notify
    from mercato.sources.binding import bind
    from tests.conftest import SF_SMALL

    items = {k: v for k, v in made(spark).items()}
    plan = export.export_rows(items)._jdf.queryExecution().optimizedPlan().toString()
    for part in plan.split("Project [")[1:]:
        assert "Join" not in part or "to_json" not in part.split("Join", 1)[1].split("Project [", 1)[0]
    d = bind(spark, SF_SMALL)
    plan = d.owned_order_items()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("p_partkey") < plan.rindex("o_orderkey") and "concat_ws" not in plan.split("Join", 1)[1]
    want = d.order_items.join(d.orders.selectExpr("id AS o", "user_id AS owner_id"), F.col("order_id") == F.col("o")).drop("o")
    got = d.owned_order_items()
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "owner_id" not in q_notify.q_export_rows(d).columns
