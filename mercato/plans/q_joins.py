"""Registered request/feed/key queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mercato.operators import feeds, keys, requests
from mercato.operators.catalog import admin_products
from mercato.operators.topk import paginate
from mercato.functions.columns import newest_first, wall_micros
from mercato.plans.registry import register

NOW = dt.datetime(2024, 2, 1, 0, 0, 0)

_HEADER = """d_service_requests sr JOIN d_services s ON s.id = sr.service_id JOIN d_users u ON u.id = sr.user_id"""


@register("request_list", f"""
SELECT sr.id, sr.status, sr.created_at, sr.updated_at, sr.brief, s.title AS service_title, s.slug AS service_slug,
       u.name AS customer_name, u.email AS customer_email
FROM {_HEADER}
""")
def q_request_list(d):
    return requests.request_list(d.service_requests, d.services, d.users)


@register("request_messages", """
SELECT m.id, m.service_request_id, m.body, m.attachments, m.created_at, u.id AS sender_id, u.name AS sender_name,
       u.role AS sender_role
FROM d_messages m JOIN d_users u ON u.id = m.sender_user_id
""")
def q_request_messages(d):
    return requests.request_messages(d.messages, d.users)


@register("request_deliverables", """
SELECT id, service_request_id, title, description, file_url, created_at FROM d_deliverables
""")
def q_request_deliverables(d):
    return requests.request_deliverables(d.deliverables)


@register("quote_context", """
SELECT q.id, q.service_request_id, q.amount_cents, q.status, q.notes, sr.user_id, sr.service_id, s.title AS service_title
FROM d_quotes q JOIN d_service_requests sr ON sr.id = q.service_request_id JOIN d_services s ON s.id = sr.service_id
""")
def q_quote_context(d):
    return requests.quote_context(d.quotes, d.service_requests, d.services)


@register("quote_owner", """
SELECT q.id, sr.user_id, sr.id AS service_request_id
FROM d_quotes q JOIN d_service_requests sr ON sr.id = q.service_request_id
""")
def q_quote_owner(d):
    return requests.quote_owner(d.quotes, d.service_requests)


def _line(*fields: str) -> str:
    """A child's fields as one text, in the oracle."""
    return "concat_ws('~', " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


_MESSAGE_LINE = _line("m.id", "m.body", "array_to_string(m.attachments, ',')", "epoch_us(m.created_at)", "x.id", "x.name", "x.role")
_DELIVERABLE_LINE = _line("id", "title", "description", "file_url", "epoch_us(created_at)")


@register("request_detail", f"""
SELECT sr.id, sr.status, sr.brief, sr.created_at, sr.updated_at, s.id AS service_id, s.title AS service_title, s.slug AS service_slug,
       u.id AS customer_id, u.name AS customer_name, u.email AS customer_email,
       coalesce(m.n, 0) AS n_messages, coalesce(m.ids, '') AS message_ids, coalesce(m.lines, '') AS message_lines,
       q.id AS quote_id, q.amount_cents AS quote_amount_cents, q.status AS quote_status, q.notes AS quote_notes,
       q.created_at AS quote_created_at,
       coalesce(dl.n, 0) AS n_deliverables, coalesce(dl.ids, '') AS deliverable_ids, coalesce(dl.lines, '') AS deliverable_lines
FROM {_HEADER}
LEFT JOIN (SELECT m.service_request_id, count(*) AS n,
                  string_agg(CAST(m.id AS VARCHAR), '|' ORDER BY m.created_at, m.id) AS ids,
                  string_agg({_MESSAGE_LINE}, '|' ORDER BY m.created_at, m.id) AS lines
           FROM d_messages m JOIN d_users x ON x.id = m.sender_user_id GROUP BY m.service_request_id) m
  ON m.service_request_id = sr.id
LEFT JOIN d_quotes q ON q.service_request_id = sr.id
LEFT JOIN (SELECT service_request_id, count(*) AS n,
                  string_agg(CAST(id AS VARCHAR), '|' ORDER BY created_at DESC, id DESC) AS ids,
                  string_agg({_DELIVERABLE_LINE}, '|' ORDER BY created_at DESC, id DESC) AS lines
           FROM d_deliverables GROUP BY service_request_id) dl ON dl.service_request_id = sr.id
""")
def q_request_detail(d):
    """Nested request documents, compared through flat canonical columns that hold every field."""
    doc = requests.request_detail(d.service_requests, d.services, d.users, d.messages, d.quotes, d.deliverables)

    def joined(c, *fields):
        def text(x, f):
            return (wall_micros(x[f]) if f == "created_at" else F.array_join(x[f], ",") if f == "attachments" else x[f]).cast("string")
        return F.array_join(F.transform(F.col(c), lambda x: F.concat_ws("~", *[F.coalesce(text(x, f), F.lit("-")) for f in fields])), "|")

    return doc.select("id", "status", "brief", "created_at", "updated_at",
                      *[F.col(f"service.{f}").alias(f"service_{f}") for f in ("id", "title", "slug")],
                      *[F.col(f"customer.{f}").alias(f"customer_{f}") for f in ("id", "name", "email")],
                      F.size("messages").cast("bigint").alias("n_messages"), joined("messages", "id").alias("message_ids"),
                      joined("messages", "id", "body", "attachments", "created_at", "sender_id", "sender_name", "sender_role").alias("message_lines"),
                      *[F.col(f"quote.{f}").alias(f"quote_{f}") for f in ("id", "amount_cents", "status", "notes", "created_at")],
                      F.size("deliverables").cast("bigint").alias("n_deliverables"), joined("deliverables", "id").alias("deliverable_ids"),
                      joined("deliverables", "id", "title", "description", "file_url", "created_at").alias("deliverable_lines"))


@register("request_board", f"""
SELECT st.position, st.status, coalesce(c.n, 0) AS n, k.card_id, k.card_title, k.card_subtitle, k.card_meta
FROM (VALUES (0, 'open'), (1, 'needs_info'), (2, 'quoted'), (3, 'paid'), (4, 'in_progress'), (5, 'delivered'),
             (6, 'completed'), (7, 'declined')) st(position, status)
LEFT JOIN (SELECT sr.status, count(*) AS n FROM {_HEADER} GROUP BY sr.status) c ON c.status = st.status
LEFT JOIN (SELECT sr.status, sr.id AS card_id, s.title AS card_title, u.name AS card_subtitle,
                  sr.created_at AS card_meta FROM {_HEADER}) k ON k.status = st.status
""")
def q_request_board(d):
    return requests.request_board(d.service_requests, d.services, d.users)


_LATEST_QUOTE = ("latest", """
SELECT f.id, f.service_request_id, l.amount_cents, l.notes, 'sent' AS status, f.submitted_at AS created_at,
       l.submitted_at AS updated_at, f.n AS n_submissions
FROM (SELECT *, row_number() OVER (PARTITION BY service_request_id ORDER BY submitted_at, id) AS rn,
             count(*) OVER (PARTITION BY service_request_id) AS n FROM d_quote_submissions) f
JOIN (SELECT *, row_number() OVER (PARTITION BY service_request_id ORDER BY submitted_at DESC, id DESC) AS rn
      FROM d_quote_submissions) l ON l.service_request_id = f.service_request_id AND l.rn = 1
WHERE f.rn = 1
""")


@register("latest_quote", "SELECT * FROM latest", _LATEST_QUOTE)
def q_latest_quote(d):
    return requests.latest_quote(d.quote_submissions)


@register("upsert_quotes", """
SELECT coalesce(q.id, n.id) AS id, coalesce(q.service_request_id, n.service_request_id) AS service_request_id,
       CASE WHEN n.service_request_id IS NOT NULL THEN n.amount_cents ELSE q.amount_cents END AS amount_cents,
       CASE WHEN n.service_request_id IS NOT NULL THEN n.notes ELSE q.notes END AS notes,
       CASE WHEN n.service_request_id IS NOT NULL THEN 'sent' ELSE q.status END AS status,
       coalesce(q.created_at, n.created_at) AS created_at
FROM d_quotes q FULL OUTER JOIN latest n ON n.service_request_id = q.service_request_id
""", _LATEST_QUOTE)
def q_upsert_quotes(d):
    return requests.upsert_quotes(d.quotes, d.quote_submissions)


@register("existing_keys", """
SELECT m.* FROM d_messages m WHERE EXISTS (SELECT 1 FROM d_users u WHERE u.id = m.sender_user_id)
""")
def q_existing_keys(d):
    """Messages whose sender exists (the 404 check behind posting)."""
    return keys.existing_keys(d.messages, d.users, ("sender_user_id", "id"))


@register("missing_keys", """
SELECT l.* FROM d_order_lines l
WHERE l.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_products p WHERE p.id = l.product_id)
""")
def q_missing_keys(d):
    """Order lines naming a product that does not exist."""
    return keys.missing_keys(d.order_lines, d.products, ("product_id", "id"))


@register("account_by_email", """
SELECT a.seq, a.email, a.ts, lower(a.email) AS normalized_email, u.id AS user_id, u.role AS user_role,
       CASE WHEN u.id IS NULL THEN 'invalid' ELSE 'ok' END AS outcome
FROM d_login_attempts a LEFT JOIN d_users u ON u.email = lower(a.email)
""")
def q_account_by_email(d):
    return keys.account_by_email(d.login_attempts, d.users)


@register("audience_cross", """
SELECT b.seq, b.title, b.body, b.role, u.id AS user_id, u.role AS user_role
FROM d_broadcasts b JOIN d_users u ON b.role IS NULL OR u.role = b.role
""")
def q_audience_cross(d):
    out = keys.audience_cross(d.broadcasts, d.users)
    return out.select("seq", "title", "body", "role", "user_id", "user_role")


@register("active_sessions", """
SELECT e.user_id, e.event_id, e.ts, l.id AS login_id, l.ts AS login_ts
FROM events e JOIN d_logins l ON l.user_id = e.user_id AND l.ts <= e.ts AND e.ts < l.ts + INTERVAL 7 DAY
""")
def q_active_sessions(d):
    """Every login that covers an event of its user."""
    return keys.active_sessions(d.logins, d.source("events"))


@register("latest_session", """
SELECT user_id, event_id, ts, login_id, login_ts FROM (
  SELECT e.user_id, e.event_id, e.ts, l.id AS login_id, l.ts AS login_ts,
         row_number() OVER (PARTITION BY e.event_id ORDER BY l.ts DESC, l.id DESC) AS rn
  FROM events e JOIN d_logins l ON l.user_id = e.user_id AND l.ts <= e.ts AND e.ts < l.ts + INTERVAL 7 DAY
) WHERE rn = 1
""")
def q_latest_session(d):
    """Each event with the latest login that covers it."""
    return keys.latest_session(d.logins, d.source("events"))


@register("first_staff", """
SELECT id, name, role, created_at FROM d_users WHERE role IN ('admin', 'editor')
ORDER BY created_at ASC NULLS LAST, id ASC LIMIT 1
""")
def q_first_staff(d):
    return feeds.first_staff(d.users)


@register("staff_sample", """
SELECT id, name, role, created_at FROM d_users WHERE role IN ('admin', 'editor')
ORDER BY created_at ASC NULLS LAST, id ASC LIMIT 10
""")
def q_staff_sample(d):
    return feeds.staff_sample(d.users, 10)


@register("latest_notifications", """
SELECT id, user_id, type, title, body, meta, read_at, created_at,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS rank
FROM d_notifications QUALIFY rank <= 30
""")
def q_latest_notifications(d):
    return feeds.latest_notifications(d.notifications, 30)


@register("unread_counts", """
SELECT user_id, count(*) FILTER (WHERE read_at IS NULL) AS unread, count(*) AS n_latest FROM (
  SELECT user_id, read_at FROM d_notifications
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id DESC) <= 30
) GROUP BY user_id
""")
def q_unread_counts(d):
    return feeds.unread_counts(d.notifications, 30)


@register("paginate", """
SELECT id, slug, title, description, price_cents, is_active, sku, tags, cover_image_url, digital_file_url,
       created_at, updated_at
FROM d_products ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 40
""")
def q_paginate(d):
    """Third page of 20 of the admin product list."""
    return paginate(admin_products(d.products), newest_first(), limit=20, offset=40)


@register("mark_read", """
SELECT n.id, n.user_id, n.type,
       CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE n.read_at END AS read_at
FROM d_notifications n LEFT JOIN (SELECT DISTINCT id, user_id FROM d_reads) r ON r.id = n.id AND r.user_id = n.user_id
""")
def q_mark_read(d):
    return feeds.mark_read(d.notifications, d.reads, NOW).select("id", "user_id", "type", "read_at")
