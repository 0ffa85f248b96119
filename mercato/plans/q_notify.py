"""Registered notification branches, the feed, deletes, export, integrity."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators import cascade, changes, export, guards, integrity, notify, requests
from mercato.functions.columns import ntz
from mercato.operators.orders import apply_payments
from mercato.plans.q_changes import (_ACCEPT_FINAL, _ACCEPT_OUT, _DECLINE_OUT, _DLV_OUT, _MSG_OUT, _PAID, _PAY_OUT,
                                     _QUOTE_OUT, accepted_quotes)
from mercato.plans.registry import register
from mercato.sources.domain import DOMAIN_SCHEMAS, load_tables_from_binding

NOW = dt.datetime(2024, 2, 1, 0, 0, 0)


def _nid(branch: str, src: str, to: str) -> str:
    return f"sha256(concat_ws('~', 'notification', '{branch}', CAST({src} AS VARCHAR), CAST({to} AS VARCHAR)))"


_STAFF10 = "(SELECT id FROM d_users WHERE role IN ('admin', 'editor') ORDER BY created_at ASC NULLS LAST, id ASC LIMIT 10)"
_STAFF1 = "(SELECT id FROM d_users WHERE role IN ('admin', 'editor') ORDER BY created_at ASC NULLS LAST, id ASC LIMIT 1)"

_FIRST_SUB = ("fsub", """
SELECT request_id, arg_min(seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(CAST(seq AS VARCHAR), 20, '0')) AS first_seq
FROM qo WHERE outcome = 'accepted' GROUP BY request_id
""")

BRANCH_SQL = {
    "order_ready": (f"""
SELECT {_nid('order_ready', 'order_id', 'owner_id')} AS id, owner_id AS user_id, 'order' AS type,
       'Digital order ready' AS title, 'Your digital purchase is ready to download.' AS body,
       CAST(json_object('orderId', order_id) AS VARCHAR) AS meta, CAST(NULL AS TIMESTAMP) AS read_at,
       paid_at AS created_at, 'order_ready' AS branch
FROM paid WHERE order_type = 'digital'
""", [_PAY_OUT, _PAID]),
    "quote_ready": (f"""
SELECT {_nid('quote_ready', 'a.seq', 'a.owner_id')} AS id, a.owner_id AS user_id, 'quote' AS type,
       'Quote ready' AS title, 'A new quote is ready for your review.' AS body,
       CAST(json_object('requestId', a.request_id, 'quoteId', coalesce(q.id, f.first_seq)) AS VARCHAR) AS meta,
       CAST(NULL AS TIMESTAMP) AS read_at, a.ts AS created_at, 'quote_ready' AS branch
FROM qo a LEFT JOIN d_quotes q ON q.service_request_id = a.request_id
LEFT JOIN fsub f ON f.request_id = a.request_id
WHERE a.outcome = 'accepted'
""", [_QUOTE_OUT, _FIRST_SUB]),
    "quote_accepted": (f"""
SELECT {_nid('quote_accepted', 'a.seq', 'st.id')} AS id, st.id AS user_id, 'quote' AS type, 'Quote accepted' AS title,
       u.name || ' accepted a quote for ' || a.service_title || '.' AS body,
       CAST(json_object('requestId', a.service_request_id,
                        'orderId', sha256(concat_ws('~', 'quote-order', CAST(a.seq AS VARCHAR)))) AS VARCHAR) AS meta,
       CAST(NULL AS TIMESTAMP) AS read_at, a.ts AS created_at, 'quote_accepted' AS branch
FROM acf a JOIN d_users u ON u.id = a.caller_id CROSS JOIN {_STAFF10} st
WHERE a.outcome = 'accept'
""", [_ACCEPT_OUT, _ACCEPT_FINAL]),
    "quote_declined": (f"""
SELECT {_nid('quote_declined', 'a.seq', 'st.id')} AS id, st.id AS user_id, 'quote' AS type, 'Quote declined' AS title,
       u.name || ' declined the quote.' AS body,
       CAST(json_object('requestId', a.service_request_id, 'quoteId', a.quote_id) AS VARCHAR) AS meta,
       CAST(NULL AS TIMESTAMP) AS read_at, a.ts AS created_at, 'quote_declined' AS branch
FROM dco a JOIN d_users u ON u.id = a.caller_id CROSS JOIN {_STAFF10} st
WHERE a.outcome = 'declined'
""", [_DECLINE_OUT]),
    "message_posted": (f"""
SELECT {_nid('message_posted', 'seq', 'rcpt')} AS id, rcpt AS user_id, 'message' AS type,
       'New message on request' AS title, 'There is a new message on your service request thread.' AS body,
       CAST(json_object('requestId', request_id) AS VARCHAR) AS meta, CAST(NULL AS TIMESTAMP) AS read_at,
       ts AS created_at, 'message_posted' AS branch
FROM (SELECT m.*, CASE WHEN m.sender_id = m.owner_id THEN {_STAFF1} ELSE m.owner_id END AS rcpt
      FROM mo m WHERE m.outcome = 'created')
WHERE rcpt IS NOT NULL
""", [_MSG_OUT]),
    "deliverable_posted": (f"""
SELECT {_nid('deliverable_posted', 'seq', 'owner_id')} AS id, owner_id AS user_id, 'deliverable' AS type,
       'New deliverable' AS title, 'A new deliverable has been posted to your request.' AS body,
       CAST(json_object('requestId', request_id,
                        'deliverableId', sha256(concat_ws('~', 'deliverable', CAST(seq AS VARCHAR)))) AS VARCHAR) AS meta,
       CAST(NULL AS TIMESTAMP) AS read_at, ts AS created_at, 'deliverable_posted' AS branch
FROM dvo WHERE outcome = 'created'
""", [_DLV_OUT]),
    "broadcast": (f"""
SELECT {_nid('broadcast', 'b.seq', 'u.id')} AS id, u.id AS user_id, 'broadcast' AS type, b.title, b.body,
       CAST(json_object('role', coalesce(b.role, 'all')) AS VARCHAR) AS meta, CAST(NULL AS TIMESTAMP) AS read_at,
       TIMESTAMP '2024-02-01 00:00:00' AS created_at, 'broadcast' AS branch
FROM d_broadcasts b JOIN d_users u ON b.role IS NULL OR u.role = b.role
""", []),
}


def _paid(d):
    checked = guards.payable_orders(d.payments, d.orders, d.users)
    return apply_payments(checked, d.orders)[1]


def _quote_ready(d):
    qo = changes.submit_quotes(d.quote_posts, d.service_requests, d.users)
    acc_q = qo.where(F.col("outcome") == "accepted")
    new_quotes = requests.upsert_quotes(d.quotes, acc_q.select(
        F.col("seq").alias("id"), F.col("request_id").alias("service_request_id"), "amount_cents", "notes",
        F.col("ts").alias("submitted_at")))
    return notify.quote_ready(acc_q, new_quotes)


def _names(d):
    return d.users.select(F.col("id").alias("_u"), F.col("name").alias("caller_name"))


def _quote_accepted(d):
    acc = accepted_quotes(d).where(F.col("outcome") == "accept")
    names = _names(d)
    acc = acc.join(names, acc["caller_id"] == names["_u"], "inner").select(
        "seq", "caller_name", "service_title", "service_request_id",
        changes.new_id("quote-order", "seq").alias("order_id"), "ts")
    return notify.quote_accepted(acc, d.users)


def _quote_declined(d):
    declines = d.quote_answers.where(F.col("action") == "decline").select("seq", "quote_id", "caller_id", "ts")
    _, dco = changes.decline_quotes(declines, d.quotes, d.service_requests)
    names = _names(d)
    dco = dco.where(F.col("outcome") == "declined").join(names, F.col("caller_id") == names["_u"], "inner")
    return notify.quote_declined(dco, d.users)


def _message_posted(d):
    _, mo = changes.post_messages(d.message_posts, d.service_requests, d.users)
    return notify.message_posted(mo.where(F.col("outcome") == "created"), d.users)


def _deliverable_posted(d):
    _, dvo = changes.post_deliverables(d.deliverable_posts, d.service_requests, d.users)
    return notify.deliverable_posted(dvo.where(F.col("outcome") == "created"))


BRANCHES = {
    "order_ready": lambda d: notify.order_ready(_paid(d)),
    "quote_ready": _quote_ready,
    "quote_accepted": _quote_accepted,
    "quote_declined": _quote_declined,
    "message_posted": _message_posted,
    "deliverable_posted": _deliverable_posted,
    "broadcast": lambda d: notify.broadcast(d.broadcasts, d.users, NOW)[0],
}


def branch_frames(d) -> dict:
    """The seven branch frames over the fixture change tables."""
    return {name: build(d) for name, build in BRANCHES.items()}


def change_frame(d):
    """The changes behind the feed in one frame (``notify.CHANGES``), after their guards."""
    accepted = changes.submit_quotes(d.quote_posts, d.service_requests, d.users).where(F.col("outcome") == "accepted")
    upserted = requests.upsert_quotes(d.quotes, accepted.select(
        F.col("seq").alias("id"), F.col("request_id").alias("service_request_id"), "amount_cents", "notes",
        F.col("ts").alias("submitted_at"))).select(F.col("service_request_id").alias("_r"), F.col("id").alias("quote_id"))
    acc = accepted_quotes(d).where(F.col("outcome") == "accept")
    declines = d.quote_answers.where(F.col("action") == "decline").select("seq", "quote_id", "caller_id", "ts")
    declined = changes.decline_quotes(declines, d.quotes, d.service_requests)[1].where(F.col("outcome") == "declined")
    messages = changes.post_messages(d.message_posts, d.service_requests, d.users)[1].where(F.col("outcome") == "created")
    posted = changes.post_deliverables(d.deliverable_posts, d.service_requests, d.users)[1].where(F.col("outcome") == "created")
    row = notify.change_rows
    frames = [
        row("order_ready", _paid(d), seq="order_id", owner_id="owner_id", order_type="order_type", ts="paid_at"),
        row("quote_ready", accepted.join(upserted, accepted["request_id"] == upserted["_r"], "left"), seq="seq",
            request_id="request_id", quote_id="quote_id", ts="ts"),
        row("quote_accepted", acc, seq="seq", request_id="service_request_id", caller_id="caller_id",
            order_id=changes.new_id("quote-order", "seq"), ts="ts"),
        row("quote_declined", declined, seq="seq", request_id="service_request_id", caller_id="caller_id",
            quote_id="quote_id", ts="ts"),
        row("message_posted", messages, seq="seq", request_id="request_id", caller_id="sender_id", ts="ts"),
        row("deliverable_posted", posted, seq="seq", request_id="request_id", deliverable_id="deliverable_id", ts="ts"),
        row("broadcast", d.broadcasts, seq="seq", title="title", body="body", role="role", ts=ntz(NOW))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _register_branch(name: str):
    sql, ctes = BRANCH_SQL[name]

    @register(f"notify_{name}", sql, *ctes)
    def q(d):
        return BRANCHES[name](d).select(*notify.NOTIFY_COLS)

    q.__doc__ = f"Notifications of the {name} branch."
    return q


for _name in BRANCH_SQL:
    _register_branch(_name)

_ALL_CTES = []
for _sql, _ctes in BRANCH_SQL.values():
    for _c in _ctes:
        if _c not in _ALL_CTES:
            _ALL_CTES.append(_c)


@register("notification_feed", "\nUNION ALL\n".join(f"({sql.strip()})" for sql, _ in BRANCH_SQL.values()),
          *_ALL_CTES)
def q_notification_feed(d):
    """The seven notification branches from one frame of changes, in one pass over requests and one over users for names."""
    rows, _ = notify.change_notifications(change_frame(d), d.users, d.service_requests, d.services)
    return rows.select(*notify.NOTIFY_COLS)


@register("broadcast_counts", """
SELECT b.seq, count(u.id) AS inserted
FROM d_broadcasts b LEFT JOIN d_users u ON b.role IS NULL OR u.role = b.role GROUP BY b.seq
""")
def q_broadcast_counts(d):
    """Inserted notifications per broadcast message (0 for an empty audience)."""
    _, counts = notify.broadcast(d.broadcasts, d.users, NOW)
    return counts


_DEL = [("du", "SELECT id FROM d_users WHERE id % 97 = 0"),
        ("ds", "SELECT id FROM d_services WHERE id % 97 = 0"),
        ("dp", "SELECT id FROM d_products WHERE id % 97 = 0"),
        ("dr", "SELECT id FROM d_service_requests WHERE user_id IN (SELECT id FROM du) OR service_id IN (SELECT id FROM ds)"),
        ("dord", "SELECT id FROM d_orders WHERE user_id IN (SELECT id FROM du)")]


@register("delete_cascade", """
SELECT 'users' AS table_name, count(*) AS n FROM d_users WHERE id NOT IN (SELECT id FROM du)
UNION ALL SELECT 'products', count(*) FROM d_products WHERE id NOT IN (SELECT id FROM dp)
UNION ALL SELECT 'services', count(*) FROM d_services WHERE id NOT IN (SELECT id FROM ds)
UNION ALL SELECT 'service_requests', count(*) FROM d_service_requests WHERE id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'orders', count(*) FROM d_orders WHERE id NOT IN (SELECT id FROM dord)
UNION ALL SELECT 'orders.service_request_id null', count(*) FROM d_orders
  WHERE id NOT IN (SELECT id FROM dord) AND (service_request_id IS NULL OR service_request_id IN (SELECT id FROM dr))
UNION ALL SELECT 'order_items', count(*) FROM d_order_items WHERE order_id NOT IN (SELECT id FROM dord)
UNION ALL SELECT 'order_items.product_id null', count(*) FROM d_order_items
  WHERE order_id NOT IN (SELECT id FROM dord) AND (product_id IS NULL OR product_id IN (SELECT id FROM dp))
UNION ALL SELECT 'order_items.service_id null', count(*) FROM d_order_items
  WHERE order_id NOT IN (SELECT id FROM dord) AND (service_id IS NULL OR service_id IN (SELECT id FROM ds))
UNION ALL SELECT 'messages', count(*) FROM d_messages
  WHERE sender_user_id NOT IN (SELECT id FROM du) AND service_request_id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'quotes', count(*) FROM d_quotes WHERE service_request_id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'notifications', count(*) FROM d_notifications WHERE user_id NOT IN (SELECT id FROM du)
UNION ALL SELECT 'deliverables', count(*) FROM d_deliverables WHERE service_request_id NOT IN (SELECT id FROM dr)
UNION ALL SELECT 'audit_log', count(*) FROM d_audit_log
UNION ALL SELECT 'audit_log.actor_user_id null', count(*) FROM d_audit_log
  WHERE actor_user_id IS NULL OR actor_user_id IN (SELECT id FROM du)
""", *_DEL)
def q_delete_cascade(d):
    """Row counts after deleting users, then services, then products with id % 97 = 0."""
    t = load_tables_from_binding(d)
    for kind, table in (("users", "users"), ("services", "services"), ("products", "products")):
        ids = t[table].where(F.col("id") % 97 == 0).select("id")
        t = changes.delete_cascade(t, kind, ids)
    counts = None

    def add(name, df):
        nonlocal counts
        part = df.select().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = part if counts is None else counts.unionByName(part)

    for name in ("users", "products", "services", "service_requests", "orders"):
        add(name, t[name])
    add("orders.service_request_id null", t["orders"].where(F.col("service_request_id").isNull()))
    add("order_items", t["order_items"])
    add("order_items.product_id null", t["order_items"].where(F.col("product_id").isNull()))
    add("order_items.service_id null", t["order_items"].where(F.col("service_id").isNull()))
    for name in ("messages", "quotes", "notifications", "deliverables", "audit_log"):
        add(name, t[name])
    add("audit_log.actor_user_id null", t["audit_log"].where(F.col("actor_user_id").isNull()))
    return counts


@register("export_user", """
SELECT u.id AS user_id, u.email,
       (SELECT count(*) FROM d_orders o WHERE o.user_id = u.id) AS n_orders,
       (SELECT count(*) FROM d_order_items i JOIN d_orders o ON o.id = i.order_id WHERE o.user_id = u.id) AS n_items,
       (SELECT CAST(coalesce(sum(o.total_cents), 0) AS BIGINT) FROM d_orders o WHERE o.user_id = u.id) AS total_cents,
       (SELECT count(*) FROM d_service_requests r WHERE r.user_id = u.id) AS n_requests,
       (SELECT count(*) FROM d_messages m WHERE m.sender_user_id = u.id) AS n_messages,
       (SELECT count(*) FROM d_notifications n WHERE n.user_id = u.id) AS n_notifications,
       (SELECT count(*) FROM d_audit_log a WHERE a.actor_user_id = u.id) AS n_audit
FROM d_users u
""")
def q_export_user(d):
    """Data export of every user, summarised for comparison."""
    doc = integrity.export_user(load_tables_from_binding(d))
    return doc.select(
        "user_id", F.col("profile.email").alias("email"),
        F.size("orders").cast("bigint").alias("n_orders"),
        F.aggregate("orders", F.lit(0).cast("bigint"), lambda acc, o: acc + F.size(o["items"])).alias("n_items"),
        F.aggregate("orders", F.lit(0).cast("bigint"), lambda acc, o: acc + o["total_cents"]).alias("total_cents"),
        F.size("requests").cast("bigint").alias("n_requests"),
        F.size("messages").cast("bigint").alias("n_messages"),
        F.size("notifications").cast("bigint").alias("n_notifications"),
        F.size("audit").cast("bigint").alias("n_audit"))


def _surviving() -> str:
    """SQL: (table_name, id, refs) of every row that stays."""
    doomed = {"users": "du", "services": "ds", "products": "dp", "service_requests": "dr", "orders": "dord"}
    out = []
    for name in DOMAIN_SCHEMAS:
        if name == "coaching_slots":
            continue
        refs = [(c, p) for (table, c), p in integrity.REFERENCES.items() if table == name]
        goes = [(c, p) for c, p in refs if (name, c) not in cascade.SET_NULL] + [("id", name)] * (name in doomed)
        kept = " AND ".join(f"coalesce({c} NOT IN (SELECT id FROM {doomed[p]}), true)" for c, p in goes) or "true"
        texts = [f"coalesce(CAST({c} AS VARCHAR), '-')" if (name, c) not in cascade.SET_NULL else
                 f"CASE WHEN {c} IN (SELECT id FROM {doomed[p]}) THEN '-' ELSE coalesce(CAST({c} AS VARCHAR), '-') END" for c, p in refs]
        out.append(f"SELECT '{name}' AS table_name, CAST(id AS VARCHAR) AS id, concat_ws(' ', '', {', '.join(texts) or chr(39) * 2}) AS refs "
                   f"FROM d_{name} WHERE {kept}")
    return " UNION ALL ".join(out)


@register("delete_cascade_rows", _surviving(), *_DEL)
def q_delete_cascade_rows(d):
    """Every row that stays, with its references, after users, services and products with id % 97 = 0 went at once."""
    t = {k: v for k, v in load_tables_from_binding(d).items() if k != "coaching_slots"}
    doomed = [t[k].where(F.col("id") % 97 == 0).select(F.lit(k).alias("table"), F.col("id").alias("key"))
              for k in ("users", "services", "products")]
    kept = cascade.delete_all(t, reduce(DataFrame.unionByName, doomed))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rows = [df.select(F.lit(k).alias("table_name"), F.col("id").cast("string").alias("id"), F.concat_ws(
        " ", F.lit(""), *([text(c) for table, c in integrity.REFERENCES if table == k] or [F.lit("")])).alias("refs"))
        for k, df in kept.items()]
    return reduce(DataFrame.unionByName, rows)


def _export_sql() -> str:
    out = []
    for section, (table, key, at, fields) in export.SECTIONS.items():
        types = {f.name: f.dataType for f in DOMAIN_SCHEMAS[table].fields}
        pairs = ", ".join(f"'{f}', " + (f"strftime(x.{f}, '%Y-%m-%d %H:%M:%S.%f')" if isinstance(types[f], T.TimestampNTZType) else f"x.{f}")
                          for f in fields)
        user = "o.user_id" if section in export.THROUGH else f"x.{key}"
        join = f" JOIN d_{export.THROUGH[section]} o ON o.id = x.{key}" if section in export.THROUGH else ""
        out.append(f"SELECT {user} AS user_id, '{section}' AS section, {f'x.{at}' if at else 'CAST(NULL AS TIMESTAMP)'} AS at, "
                   f"CAST(x.id AS VARCHAR) AS row_id, CAST(json_object({pairs}) AS VARCHAR) AS payload "
                   f"FROM d_{table} x{join} WHERE {user} IS NOT NULL")
    return " UNION ALL ".join(out)


@register("export_rows", _export_sql())
def q_export_rows(d):
    """Everything held on every user, one row for each thing, with its contents."""
    t = load_tables_from_binding(d)
    if not d.stored:
        t["order_items"] = d.owned_order_items()
    return export.export_rows(t)


def _planted(table: str) -> list[tuple[list[str], str]]:
    """(expressions, condition) of the rows of a table and of two kinds of broken rows derived from them: a repeated id
    with nothing else, and no id with references, numbers and enums out of range."""
    cols = [f.name for f in DOMAIN_SCHEMAS[table].fields]
    key = "order_id" if table == "order_items" else "id"
    broken = []
    for f in DOMAIN_SCHEMAS[table].fields:
        at = (table, f.name)
        broken.append(f"CAST(NULL AS {SQL_TYPES[type(f.dataType)]}) AS id" if f.name == "id" else
                      f"CAST(-1 AS BIGINT) AS {f.name}" if at in integrity.REFERENCES else
                      f"CAST(-1 AS INT) AS {f.name}" if at in integrity.AT_LEAST else
                      f"'broken' AS {f.name}" if at in integrity.ENUMS else f.name)
    return [(cols, "true"), (["id", *(f"NULL AS {c}" for c in cols if c != "id")], f"{key} % 5 = 0"), (broken, f"{key} % 7 = 0")]


SQL_TYPES = {T.LongType: "BIGINT", T.StringType: "VARCHAR(100)"}
#: No source has slots, so they are made from the services.
SLOTS = ["id", "created_at AS starts_at", "updated_at AS ends_at", "CAST(5 AS INT) AS capacity", "is_active"]


def _integrity_sql() -> str:
    ctes = [f"b_coaching_slots AS (SELECT {', '.join(SLOTS)} FROM d_services)",
            "b_users AS (SELECT *, CAST(NULL AS VARCHAR) AS password_hash FROM d_users)"]
    for t in integrity.NOT_NULL:
        source = f"b_{t}" if t in ("coaching_slots", "users") else f"d_{t}"
        ctes.append(f"p_{t} AS (" + " UNION ALL ".join(
            f"SELECT {', '.join(cols)} FROM {source} WHERE {cond}" for cols, cond in _planted(t)) + ")")
    rules = [(f"{t}.{c} not null", f"count(*) FILTER (WHERE {c} IS NULL) FROM p_{t}")
             for t, cs in integrity.NOT_NULL.items() for c in ["id", *cs]]
    rules += [(f"{t}.{c} enum", f"count(*) FILTER (WHERE {c} NOT IN {tuple(v)}) FROM p_{t}")
              for (t, c), v in integrity.ENUMS.items()]
    rules += [(f"{t}.{c} >= {n}", f"count(*) FILTER (WHERE {c} < {n}) FROM p_{t}") for (t, c), n in integrity.AT_LEAST.items()]
    rules += [(f"{t}.{c} unique", f"count({c}) - count(DISTINCT {c}) FROM p_{t}") for t, c in integrity.UNIQUE]
    rules += [(f"{t}.{c} -> {p}", f"count(*) FROM p_{t} x WHERE x.{c} IS NOT NULL AND NOT EXISTS "
                                  f"(SELECT 1 FROM p_{p} y WHERE y.id = x.{c})") for (t, c), p in integrity.REFERENCES.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, {rest.replace(' FROM', ' AS violations FROM', 1)}" for name, rest in rules)


@register("integrity_report", _integrity_sql())
def q_integrity_report(d):
    """Every declared rule, over the tables with broken rows planted, so that each rule has violations to count."""
    t = load_tables_from_binding(d)
    t["coaching_slots"] = t["services"].selectExpr(*SLOTS)
    planted = {}
    for name in integrity.NOT_NULL:  # all kinds of rows from one scan
        kinds = _planted(name)
        values = zip(*[[c.rsplit(" AS ", 1)[0] for c in cols] for cols, _ in kinds])
        planted[name] = (
            t[name].selectExpr("*", f"explode(sequence(0, {len(kinds) - 1})) AS _kind")
            .where(" OR ".join(f"_kind = {i} AND {cond}" for i, (_, cond) in enumerate(kinds)))
            .selectExpr(*[f"CAST(CASE _kind {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(v))} END AS {f.dataType.simpleString()}) AS {f.name}"
                          for f, v in zip(DOMAIN_SCHEMAS[name].fields, values)]))
    return integrity.integrity_report(planted)
