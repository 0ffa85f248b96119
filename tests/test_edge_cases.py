"""Edge cases named in the survey's test strategy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercato.operators import changes, guards, keys, limiter, notify, orders, requests

T = dt.datetime(2024, 1, 1)


def _attempts(spark, seconds, key="k"):
    rows = [(key, i, T + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz")


def _allowed(df):
    return [r.allowed for r in df.orderBy("id").collect()]


def test_limiter_refill_exactly_at_limit_is_not_a_reset(spark):
    # limit 2 / 60 s: attempts at 0, 1, 60 (exactly refill: no reset), 61 (reset)
    out = limiter.attempt_limiter(_attempts(spark, [0, 1, 60, 61]), "key", 2, 60)
    assert _allowed(out) == [True, True, False, True]


def test_limiter_login_config(spark):
    secs = list(range(12)) + [70, 71]
    out = limiter.attempt_limiter(_attempts(spark, secs), "key", 10, "60 seconds")
    assert _allowed(out) == [True] * 10 + [False, False] + [True, True]


def test_limiter_denied_attempts_do_not_move_the_anchor(spark):
    # limit 1 / 10 s: 0 allowed, 5 denied, 9 denied, 11 resets (anchor still 0)
    out = limiter.attempt_limiter(_attempts(spark, [0, 5, 9, 11, 20, 22]), "key", 1, 10)
    assert _allowed(out) == [True, False, False, True, False, True]


def test_limiter_matches_brute_force_on_random_data(spark):
    import random

    rnd = random.Random(7)
    rows, i = [], 0
    for key, n in (("a", 300), ("b", 200), ("c", 300)):
        t = 0
        for _ in range(n):
            t += rnd.choice([0, 1, 2, 5, 30, 61, 200])
            rows.append((key, i, T + dt.timedelta(seconds=t)))
            i += 1
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz")
    got = {r.id: r.allowed for r in limiter.attempt_limiter(df, "key", 3, 60).collect()}
    want = {}
    for key in ("a", "b", "c"):
        tokens = anchor = None
        for k, rid, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            s = (ts - T).total_seconds()
            if anchor is None or s - anchor > 60:
                tokens, anchor = 3, s
            want[rid] = tokens > 0
            if tokens > 0:
                tokens -= 1
    assert got == want


def test_patch_null_means_not_given(spark, seed):
    patches = spark.createDataFrame([(11, None, "New Title", None), (12, None, None, None), (999, None, "Zzz", None)],
                                    "id long, slug string, title string, price_cents int")
    table, outcomes = changes.apply_patches(seed["products"], patches, ["slug", "title", "price_cents"], "slug",
                                            T, rules=changes.patch_rules("product"))
    got = {r.id: r.outcome for r in outcomes.collect()}
    assert got == {11: "updated", 12: "no_updates", 999: "not_found"}
    row = table.where("id = 11").first()
    assert row.title == "New Title" and row.sku == "BRND-001" and row.updated_at == T


def test_patch_slug_conflicts(spark, seed):
    patches = spark.createDataFrame([(11, "website-copy-pack"), (12, "fresh-slug"), (13, "fresh-slug"),
                                     (14, "email-sequence")], "id long, slug string")
    _, outcomes = changes.apply_patches(seed["products"], patches, ["slug"], "slug", T,
                                        rules=changes.patch_rules("product"))
    got = {r.id: r.outcome for r in outcomes.collect()}
    assert got == {11: "conflict", 12: "updated", 13: "conflict", 14: "updated"}


def test_requote_after_accept_goes_back_to_sent(spark, seed):
    accepted = seed["quotes"].withColumn("status", F.lit("accepted"))
    subs = spark.createDataFrame([(900, 31, 25000, "v2", T), (901, 31, 26000, None, T + dt.timedelta(hours=1)),
                                  (902, 32, 9000, None, T)],
                                 "id long, service_request_id long, amount_cents int, notes string, submitted_at timestamp_ntz")
    out = {r.service_request_id: r for r in requests.upsert_quotes(accepted, subs).collect()}
    assert (out[31].id, out[31].status, out[31].amount_cents, out[31].notes) == (51, "sent", 26000, None)
    assert out[31].created_at == seed["quotes"].first().created_at
    assert (out[32].id, out[32].status) == (902, "sent")


def test_staff_owner_message_notifies_staff(spark, seed):
    posted = spark.createDataFrame([(1, 31, 3, 3, T), (2, 31, 1, 3, T), (3, 99, 2, 2, T)],
                                   "seq long, request_id long, sender_id long, owner_id long, ts timestamp_ntz")
    got = {r.body and r.user_id for r in notify.message_posted(posted, seed["users"]).collect()}
    # owner wrote -> first staff (1); staff wrote -> owner (3); staff owner wrote -> first staff (1)
    rows = {(r.user_id) for r in notify.message_posted(posted, seed["users"]).collect()}
    assert rows == {1, 3} and got == {1, 3}
    assert notify.message_posted(posted, seed["users"]).count() == 3


def test_delete_user_cascades_to_depth_three(spark, seed):
    ids = spark.createDataFrame([(3,)], "id long")
    t = changes.delete_cascade(seed, "users", ids, actor_id=1)
    assert t["users"].count() == 3
    assert [r.id for r in t["service_requests"].collect()] == [32]
    assert sorted(r.id for r in t["messages"].collect()) == [43]   # 41 sits on request 31: gone with it
    assert t["quotes"].count() == 0 and t["orders"].count() == 0 and t["order_items"].count() == 0
    assert t["notifications"].count() == 0


def test_self_delete_is_refused(spark, seed):
    ids = spark.createDataFrame([(1,)], "id long")
    assert changes.delete_cascade(seed, "users", ids, actor_id=1)["users"].count() == 4


def test_delete_product_sets_item_reference_null(spark, seed):
    ids = spark.createDataFrame([(11,)], "id long")
    t = changes.delete_cascade(seed, "products", ids)
    item = t["order_items"].first()
    assert item.product_id is None and item.title == "Brand Style Guide Template"


def test_payment_twice_notifies_once(spark, seed):
    pending = seed["orders"].withColumn("status", F.lit("pending"))
    pays = spark.createDataFrame([(71, 3, T), (71, 3, T + dt.timedelta(minutes=1)), (71, 4, T), (99, 3, T)],
                                 "order_id long, caller_id long, paid_at timestamp_ntz")
    checked = guards.payable_orders(pays, pending, seed["users"])
    assert sorted(r.outcome for r in checked.collect()) == ["forbidden", "not_found", "pay", "pay"]
    new_orders, paid = orders.apply_payments(checked, pending)
    assert new_orders.first().status == "paid"
    assert notify.order_ready(paid).count() == 1


def test_price_lines_outcomes(spark, seed):
    lines = spark.createDataFrame([(1, 1, 11, None, 2), (1, 2, None, 21, 1), (2, 1, None, None, 1),
                                   (3, 1, 11, 21, 1), (4, 1, 999, None, 1), (5, 1, 11, None, 0),
                                   (6, 1, 11, None, 2_000_000)],
                                  "order_seq long, line_no int, product_id long, service_id long, quantity int")
    got = {(r.order_seq, r.line_no): (r.outcome, r.subtotal_cents)
           for r in orders.price_lines(lines, seed["products"], seed["services"]).collect()}
    assert got[(1, 1)] == ("ok", 9800) and got[(1, 2)] == ("ok", 15000)
    assert got[(2, 1)][0] == "no_key" and got[(3, 1)][0] == "both_keys"
    assert got[(4, 1)][0] == "product_not_found" and got[(5, 1)][0] == "bad_quantity"
    assert got[(6, 1)][0] == "overflow"


def test_register_lowercases_and_rejects_duplicates(spark, seed):
    regs = spark.createDataFrame([(1, "New@Example.com", "long-enough", "Newbie"), (2, "new@example.com", "long-enough", "Dup"),
                                  (3, "Customer1@Example.com", "long-enough", "Again"), (4, "bad", "short", "x")],
                                 "seq long, email string, password string, name string")
    inserts, outcomes = changes.register_users(regs, seed["users"], T)
    got = {r.seq: (r.outcome, list(r.issues)) for r in outcomes.collect()}
    assert got == {1: ("created", []), 2: ("conflict", []), 3: ("conflict", []),
                   4: ("invalid", ["email", "password", "name"])}
    row = inserts.first()
    assert (row.email, row.role) == ("new@example.com", "customer")


def test_active_sessions_picks_latest_covering_login(spark):
    logins = spark.createDataFrame([(1, 7, T), (2, 7, T + dt.timedelta(days=3))], "id long, user_id long, ts timestamp_ntz")
    events = spark.createDataFrame([(10, 7, T + dt.timedelta(days=1)), (11, 7, T + dt.timedelta(days=9)),
                                    (12, 7, T + dt.timedelta(days=10, seconds=1)), (13, 8, T)],
                                   "event_id long, user_id long, ts timestamp_ntz")
    got = {r.event_id: r.login_id for r in keys.latest_session(logins, events).collect()}
    assert got == {10: 1, 11: 2}


@pytest.mark.parametrize("rule", ["orders", "requests", "notifications"])
def test_visibility_never_pairs_all_scope_viewers(spark, rule):
    from mercato.operators.visibility import visible_rows

    viewers = spark.createDataFrame([(1, "admin", False, None), (2, "customer", False, None), (3, "editor", True, None)],
                                    "id long, role string, mine boolean, target_user_id long")
    rows = spark.createDataFrame([(100, 2), (101, 3), (102, 9)], "id long, user_id long")
    out = visible_rows(viewers, rows, rule).collect()
    pairs = {(r.viewer_id, r.row_id) for r in out}
    if rule == "notifications":
        assert pairs == {(3, 101)}          # admin without mine sees own (none); customer refused
    else:
        assert (2, 100) in pairs and (3, 101) in pairs
        assert {r.row_id for r in out if r.viewer_id is None} == {100, 101, 102}


def test_active_sessions_are_all_covering_logins(spark):
    import datetime as dt
    import random

    from mercato.operators import keys

    rng = random.Random(2)
    T = dt.datetime(2024, 3, 30)
    some = lambda n: [(i, rng.choice([1, 1, 1, 2, 3, None]),
                       rng.choice([None] + [T + dt.timedelta(minutes=rng.randrange(30_000)) for _ in range(12)])) for i in range(n)]
    logins, events = some(60), some(200)
    logins += [(90, 1, T), (90, 1, T)]
    events += [(300, 1, T), (301, 1, T + dt.timedelta(days=7)), (302, 1, T + dt.timedelta(days=7) - dt.timedelta(microseconds=1))]
    lg = spark.createDataFrame(logins, "id long, user_id long, ts timestamp_ntz")
    ev = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz")
    want = sorted((e, i) for e, u, t in events for i, v, s in logins
                  if u is not None and u == v and t and s and s <= t < s + dt.timedelta(days=7))
    for width in ("1 day", "7 hours", "30 days"):
        got = sorted((r.event_id, r.login_id) for r in keys.active_sessions(lg, ev, width=width).collect())
        assert got == want


def test_every_table_has_its_insert_defaults(spark):
    from mercato.sources.domain import DOMAIN_SCHEMAS

    for kind, (table, given) in changes.DEFAULTS.items():
        rows = spark.createDataFrame([("a", "extra")], "id string, clash string")
        out = changes.append_with_defaults(rows, kind, T)
        assert out.columns == DOMAIN_SCHEMAS[table].fieldNames()
        row = out.first().asDict()
        times = {"created_at": T} if "created_at" in out.columns else {}
        assert {k: v for k, v in row.items() if v is not None} == {"id": "a", **given, **times}
        assert changes.append_with_defaults(rows.limit(0), kind, T).collect() == []
    kept = changes.append_with_defaults(spark.createDataFrame([(7, "paid")], "id long, status string"), "order", T).first()
    assert (kept.id, kept.status) == (7, "paid")


def test_integrity_report_text_keys_and_empty_tables(spark):
    from mercato.operators.integrity import NOT_NULL, integrity_report
    from mercato.sources.domain import DOMAIN_SCHEMAS

    t = {name: spark.createDataFrame([], DOMAIN_SCHEMAS[name]) for name in NOT_NULL}
    empty = {r.rule: r.violations for r in integrity_report(t).collect()}
    assert len(empty) == 118 and set(empty.values()) == {0}
    # minted ids are text: then all columns of that key space compare as text
    orders = spark.createDataFrame([("a", 1, "paid"), ("a", None, "odd"), ("b", 2, None), (None, 2, "paid")], "id string, user_id long, status string")
    items = spark.createDataFrame([(1, "a", 0), (2, "z", 1), (2, "z", None), (2, None, 3)], "id long, order_id string, quantity int")
    users = spark.createDataFrame([(2, "x"), (3, "x")], "id long, email string")
    for name, df in (("orders", orders), ("order_items", items), ("users", users)):
        rest = [c for c in t[name].columns if c not in df.columns]
        t[name] = df.select("*", *[F.lit(None).cast(t[name].schema[c].dataType).alias(c) for c in rest])
    got = {r.rule: r.violations for r in integrity_report(t).collect()}
    assert (got["orders.id unique"], got["order_items.id unique"], got["users.email unique"]) == (1, 2, 1)
    assert (got["order_items.order_id -> orders"], got["orders.user_id -> users"]) == (2, 1)
    assert (got["orders.id not null"], got["orders.status enum"], got["orders.status not null"]) == (1, 1, 1)
    assert (got["order_items.quantity >= 1"], got["order_items.quantity not null"]) == (1, 1)
