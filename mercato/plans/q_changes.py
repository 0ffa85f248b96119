"""Registered bulk-change queries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import ntz
from mercato.functions.rules import EMAIL_RE, URL_RE, validate_rows, issues
from mercato.operators import quote_events as quote_ops
from mercato.operators import changes, guards, handover
from mercato.plans.registry import register

NOW = dt.datetime(2024, 2, 1, 0, 0, 0)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def canon(col="issues"):
    return F.array_join(F.col(col), ",").alias("issues_canon")


def bad(pred: str, code: str) -> str:
    """SQL: the issue code when ``pred`` is not true."""
    return f"CASE WHEN NOT coalesce({pred}, false) THEN '{code}' END"


def opt(col: str, pred: str, code: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL AND NOT coalesce({pred}, false) THEN '{code}' END"


REGISTER_ISSUES = "concat_ws(',', " + ", ".join([
    bad(f"regexp_matches(email, '{EMAIL_RE}')", "email"),
    bad("length(password) >= 8", "password"),
    bad("length(name) BETWEEN 2 AND 80", "name")]) + ")"

PRODUCT_ISSUES = "concat_ws(',', " + ", ".join([
    bad("length(slug) >= 3", "slug"), bad("length(title) >= 3", "title"),
    bad("length(description) >= 10", "description"), bad("price_cents IS NOT NULL AND price_cents >= 0", "price"),
    opt("cover_image_url", f"regexp_matches(cover_image_url, '{URL_RE}')", "cover_image_url"),
    opt("digital_file_url", f"regexp_matches(digital_file_url, '{URL_RE}')", "digital_file_url")]) + ")"


@register("validate_rows", f"""
SELECT seq, {REGISTER_ISSUES} AS issues_canon, {REGISTER_ISSUES} = '' AS valid FROM d_registrations
""")
def q_validate_rows(d):
    """Registration rule set: every issue of every row."""
    good, rejects = validate_rows(d.registrations, "register")
    return (good.select("seq", F.lit("").alias("issues_canon"), F.lit(True).alias("valid"))
            .unionByName(rejects.select("seq", canon(), F.lit(False).alias("valid"))))


@register("validate_products", f"""
SELECT seq, {PRODUCT_ISSUES} AS issues_canon FROM d_product_inserts
""")
def q_validate_products(d):
    """Product rule set (incl. optional URL fields)."""
    return d.product_inserts.select("seq", F.array_join(issues("product"), ",").alias("issues_canon"))


_REG = ("reg", f"""
WITH r AS (SELECT seq, lower(email) AS email, {REGISTER_ISSUES} AS issues_canon FROM d_registrations),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM d_users u WHERE lower(u.email) = r.email) AS taken FROM r),
w AS (SELECT email, min(seq) AS first_seq FROM x WHERE issues_canon = '' AND NOT taken GROUP BY email)
SELECT x.seq, x.email,
       CASE WHEN x.issues_canon <> '' THEN 'invalid' WHEN x.taken OR x.seq <> w.first_seq THEN 'conflict'
            ELSE 'created' END AS outcome,
       x.issues_canon,
       CASE WHEN x.issues_canon = '' AND NOT x.taken AND x.seq = w.first_seq
            THEN sha256(concat_ws('~', 'user', x.email)) END AS user_id
FROM x LEFT JOIN w ON w.email = x.email
""")


@register("register_users", "SELECT * FROM reg", _REG)
def q_register_users(d):
    _, outcomes = changes.register_users(d.registrations, d.users, NOW)
    return outcomes.select("seq", "email", "outcome", canon(), "user_id")


_CATALOG_X = ("cx", f"""
SELECT i.*, {PRODUCT_ISSUES} AS issues_canon,
       EXISTS (SELECT 1 FROM d_products p WHERE p.slug = i.slug) AS taken
FROM d_product_inserts i
""")
_CATALOG_O = ("co", """
SELECT cx.*, CASE WHEN cx.issues_canon <> '' THEN 'invalid'
                  WHEN cx.taken OR cx.seq <> w.first_seq THEN 'conflict' ELSE 'created' END AS outcome
FROM cx LEFT JOIN (SELECT slug, min(seq) AS first_seq FROM cx WHERE issues_canon = '' AND NOT taken GROUP BY slug) w
  ON w.slug = cx.slug
""")


@register("insert_catalog", """
SELECT seq, slug, outcome, issues_canon,
       CASE WHEN outcome = 'created' THEN sha256(concat_ws('~', 'product', slug)) END AS new_id
FROM co
""", _CATALOG_X, _CATALOG_O)
def q_insert_catalog(d):
    _, outcomes = changes.insert_catalog(d.product_inserts, d.products, "product", NOW)
    return outcomes.select("seq", "slug", "outcome", canon(), "new_id")


@register("append_with_defaults", f"""
SELECT sha256(concat_ws('~', 'product', slug)) AS id, slug, title, description, price_cents,
       coalesce(is_active, true) AS is_active, sku, coalesce(tags, CAST([] AS VARCHAR[])) AS tags,
       cover_image_url, digital_file_url, {NOW_SQL} AS created_at, {NOW_SQL} AS updated_at
FROM co WHERE outcome = 'created'
""", _CATALOG_X, _CATALOG_O)
def q_append_with_defaults(d):
    """Product rows as inserted: defaults for is_active, tags and timestamps."""
    inserts, _ = changes.insert_catalog(d.product_inserts, d.products, "product", NOW)
    return inserts


#: Kind -> its source, the column with a default (and that default) that every third row leaves out; every other one has no time.
_APPENDED = {"user": ("users", "role", "customer"), "order": ("orders", "status", "pending"),
             "notification": ("notifications", "meta", "{}"), "audit": ("audit_log", "meta", "{}"),
             "deliverable": ("deliverables", "title", None)}


def _appended_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, id, CASE WHEN id % 3 = 0 THEN {f"'{default}'" if default else 'NULL'} ELSE {col} END AS value, "
        f"CASE WHEN id % 2 = 0 THEN {NOW_SQL} ELSE coalesce(created_at, {NOW_SQL}) END AS created_at FROM d_{table}"
        for kind, (table, col, default) in _APPENDED.items())


@register("append_other_defaults", _appended_sql())
def q_append_other_defaults(d):
    """Users, orders, notifications, audit rows and deliverables as inserted without some of their fields."""
    out = []
    for kind, (table, col, _) in _APPENDED.items():
        rows = getattr(d, table)
        rows = rows.withColumn(col, F.when(F.col("id") % 3 != 0, F.col(col))).withColumn(
            "created_at", F.when(F.col("id") % 2 != 0, F.col("created_at")))
        out.append(changes.append_with_defaults(rows, kind, NOW).select(
            F.lit(kind).alias("kind"), "id", F.col(col).alias("value"), "created_at"))
    return reduce(DataFrame.unionByName, out)


_PATCH_P = ("pp", """
SELECT pp.*,
       concat_ws(',', CASE WHEN slug IS NOT NULL AND NOT coalesce(length(slug) >= 3, false) THEN 'slug' END,
                      CASE WHEN title IS NOT NULL AND NOT coalesce(length(title) >= 3, false) THEN 'title' END,
                      CASE WHEN price_cents IS NOT NULL AND NOT coalesce(price_cents >= 0, false) THEN 'price' END) AS issues_canon,
       CAST(slug IS NOT NULL AS INT) + CAST(title IS NOT NULL AS INT) + CAST(price_cents IS NOT NULL AS INT) AS n_given,
       EXISTS (SELECT 1 FROM d_products t WHERE t.id = pp.id) AS found,
       EXISTS (SELECT 1 FROM d_products t WHERE t.slug = pp.slug AND t.id <> pp.id) AS clash
FROM d_product_patches pp
""")
_PATCH_O = ("po", """
SELECT p.*, CASE WHEN p.issues_canon <> '' THEN 'invalid'
                 WHEN p.slug IS NOT NULL AND (p.clash OR (w.claim IS NOT NULL AND p.id > w.claim)) THEN 'conflict'
                 WHEN p.n_given = 0 THEN 'no_updates' WHEN NOT p.found THEN 'not_found' ELSE 'updated' END AS outcome
FROM pp p LEFT JOIN (SELECT slug, min(id) AS claim FROM pp
                     WHERE issues_canon = '' AND slug IS NOT NULL AND NOT clash AND found GROUP BY slug) w
  ON w.slug = p.slug
""")


def _product_patch(d):
    return changes.apply_patches(d.products, d.product_patches, ["slug", "title", "price_cents"], "slug", NOW,
                                 rules=changes.patch_rules("product"))


@register("apply_patches", "SELECT id, outcome, issues_canon FROM po", _PATCH_P, _PATCH_O)
def q_apply_patches(d):
    """Outcome of every product patch."""
    _, outcomes = _product_patch(d)
    return outcomes.select("id", "outcome", canon())


@register("patched_products", f"""
SELECT t.id, coalesce(u.slug, t.slug) AS slug, coalesce(u.title, t.title) AS title,
       coalesce(u.price_cents, t.price_cents) AS price_cents, t.is_active,
       CASE WHEN u.id IS NOT NULL THEN {NOW_SQL} ELSE t.updated_at END AS updated_at
FROM d_products t LEFT JOIN (SELECT * FROM po WHERE outcome = 'updated') u ON u.id = t.id
""", _PATCH_P, _PATCH_O)
def q_patched_products(d):
    """Products table after the patch batch."""
    table, _ = _product_patch(d)
    return table.select("id", "slug", "title", "price_cents", "is_active", "updated_at")


#: One patch after the other: who holds each slug (-1: no one) and which slug each product has, where they changed.
_MOVES = ("mv", f"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER (ORDER BY m.seq) AS rn, m.*, t.id IS NOT NULL AS found, t.slug AS own, h.id AS holder,
         concat_ws(',', {opt("m.slug", "length(m.slug) >= 3", "slug")}, {opt("m.title", "length(m.title) >= 3", "title")},
                   {opt("m.description", "length(m.description) >= 10", "description")},
                   {opt("m.price_cents", "m.price_cents >= 0", "price")},
                   {opt("m.cover_image_url", f"regexp_matches(m.cover_image_url, '{URL_RE}')", "cover_image_url")},
                   {opt("m.digital_file_url", f"regexp_matches(m.digital_file_url, '{URL_RE}')", "digital_file_url")}) AS issues_canon
  FROM d_product_moves m LEFT JOIN d_products t ON t.id = m.id LEFT JOIN d_products h ON h.slug = m.slug),
r AS (
  SELECT CAST(0 AS BIGINT) AS rn, true AS ok, MAP(CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])) AS owner,
         MAP(CAST([] AS BIGINT[]), CAST([] AS VARCHAR[])) AS held
  UNION ALL
  SELECT m.rn, x.ok,
         CASE WHEN NOT y.takes THEN r.owner
              WHEN y.prev = m.slug THEN map_concat(r.owner, MAP([m.slug], [CAST(m.id AS BIGINT)]))
              ELSE map_concat(r.owner, MAP([y.prev, m.slug], [CAST(-1 AS BIGINT), CAST(m.id AS BIGINT)])) END,
         CASE WHEN NOT y.takes THEN r.held ELSE map_concat(r.held, MAP([CAST(m.id AS BIGINT)], [m.slug])) END
  FROM r JOIN m ON m.rn = r.rn + 1
  CROSS JOIN LATERAL (SELECT m.slug IS NULL OR coalesce(r.owner[m.slug], m.holder, -1) IN (-1, m.id) AS ok) x
  CROSS JOIN LATERAL (SELECT m.slug IS NOT NULL AND m.found AND m.issues_canon = '' AND x.ok AS takes,
                             coalesce(r.held[CAST(m.id AS BIGINT)], m.own) AS prev) y)
SELECT m.*, CASE WHEN issues_canon <> '' THEN 'invalid' WHEN NOT ok THEN 'conflict'
                 WHEN slug IS NULL AND title IS NULL AND description IS NULL AND price_cents IS NULL AND is_active IS NULL
                      AND sku IS NULL AND tags IS NULL AND cover_image_url IS NULL AND digital_file_url IS NULL THEN 'no_updates'
                 WHEN NOT found THEN 'not_found' ELSE 'updated' END AS outcome
FROM m JOIN r USING (rn)
""")
_PRODUCT_FIELDS = ["slug", "title", "description", "price_cents", "is_active", "sku", "tags", "cover_image_url", "digital_file_url"]


def _product_moves(d):
    return handover.apply_patches_in_turn(d.products, d.product_moves, _PRODUCT_FIELDS, "slug", NOW,
                                          rules=changes.patch_rules("product"))


@register("patches_in_turn", "SELECT seq, id, outcome, issues_canon FROM mv", _MOVES)
def q_patches_in_turn(d):
    """Outcome of every product patch, each in its turn: slugs are handed over inside the batch."""
    return _product_moves(d)[1].select("seq", "id", "outcome", canon())


@register("products_in_turn", f"""
SELECT t.id, {", ".join(f"coalesce(u.{f}, t.{f}) AS {f}" for f in _PRODUCT_FIELDS if f != "tags")},
       array_to_string(coalesce(u.tags, t.tags), ',') AS tags_canon,
       CASE WHEN u.id IS NOT NULL THEN {NOW_SQL} ELSE t.updated_at END AS updated_at
FROM d_products t LEFT JOIN (
  SELECT id, {", ".join(f"max_by({f}, seq) FILTER ({f} IS NOT NULL) AS {f}" for f in _PRODUCT_FIELDS)}
  FROM mv WHERE outcome = 'updated' GROUP BY id) u ON u.id = t.id
""", _MOVES)
def q_products_in_turn(d):
    """Products table after the patches, each in its turn, with every field of a patch."""
    table, _ = _product_moves(d)
    return table.select("id", *[f for f in _PRODUCT_FIELDS if f != "tags"],
                        F.array_join("tags", ",").alias("tags_canon"), "updated_at")


#: Callers of the product patches: no one, unknown ones, customers and staff.
_CALLER = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN -1 ELSE id % 50 + 1 END"


@register("admin_writes", f"""
SELECT p.id, CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN u.role NOT IN ('admin', 'editor') THEN 'forbidden'
                  ELSE 'allowed' END AS outcome
FROM (SELECT id, {_CALLER} AS caller_id FROM d_product_patches) p LEFT JOIN d_users u ON u.id = p.caller_id
""")
def q_admin_writes(d):
    """Every product patch with the decision on its caller."""
    rows = d.product_patches.selectExpr("id", f"{_CALLER} AS caller_id")
    allowed, refused = guards.admin_writes(rows, d.users, "product")
    return allowed.select("id", F.lit("allowed").alias("outcome")).unionByName(refused.select("id", "outcome"))


_UPATCH = ("up", f"""
  SELECT up.id, lower(up.email) AS email, up.name, up.role,
         concat_ws(',', CASE WHEN email IS NOT NULL AND NOT coalesce(regexp_matches(lower(email), '{EMAIL_RE}'), false) THEN 'email' END,
                        CASE WHEN name IS NOT NULL AND NOT coalesce(length(name) >= 2, false) THEN 'name' END,
                        CASE WHEN role IS NOT NULL AND NOT coalesce(role IN ('customer', 'editor', 'admin'), false) THEN 'role' END) AS issues_canon,
         CAST(email IS NOT NULL AS INT) + CAST(name IS NOT NULL AS INT) + CAST(role IS NOT NULL AS INT) AS n_given,
         EXISTS (SELECT 1 FROM d_users t WHERE t.id = up.id) AS found,
         EXISTS (SELECT 1 FROM d_users t WHERE t.email = lower(up.email) AND t.id <> up.id) AS clash
  FROM d_user_patches up
""")


@register("apply_user_patches", """
SELECT p.id, CASE WHEN p.issues_canon <> '' THEN 'invalid'
                  WHEN p.email IS NOT NULL AND (p.clash OR (w.claim IS NOT NULL AND p.id > w.claim)) THEN 'conflict'
                  WHEN p.n_given = 0 THEN 'no_updates' WHEN NOT p.found THEN 'not_found' ELSE 'updated' END AS outcome,
       p.issues_canon
FROM up p LEFT JOIN (SELECT email, min(id) AS claim FROM up
                  WHERE issues_canon = '' AND email IS NOT NULL AND NOT clash AND found GROUP BY email) w
  ON w.email = p.email
""", _UPATCH)
def q_apply_user_patches(d):
    """Admin user updates: email lower-cased and unique, no updated_at on users."""
    _, outcomes = changes.apply_patches(
        d.users, d.user_patches, ["email", "name", "role"], "email", NOW,
        rules=changes.patch_rules("user"), touch=None, normalize={"email": F.lower("email")})
    return outcomes.select("id", "outcome", canon())


@register("create_requests", """
SELECT r.seq,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN u.role IN ('admin', 'editor') THEN 'forbidden'
            WHEN NOT (coalesce(r.service_id >= 0, false) AND coalesce(json_valid(r.brief), false)
                      AND coalesce(ltrim(r.brief) LIKE '{%', false)) THEN 'invalid'
            WHEN s.id IS NULL THEN 'not_found' ELSE 'created' END AS outcome,
       CASE WHEN u.id IS NOT NULL AND u.role NOT IN ('admin', 'editor') AND r.service_id >= 0 AND json_valid(r.brief)
                 AND ltrim(r.brief) LIKE '{%' AND s.id IS NOT NULL
            THEN sha256(concat_ws('~', 'request', CAST(r.seq AS VARCHAR))) END AS request_id
FROM d_request_rows r LEFT JOIN d_users u ON u.id = r.user_id
LEFT JOIN (SELECT id FROM d_services WHERE is_active) s ON s.id = r.service_id
""")
def q_create_requests(d):
    _, outcomes = changes.create_requests(d.request_rows, d.users, d.services)
    return outcomes


_MSG_OUT = ("mo", f"""
SELECT m.seq, m.request_id, m.sender_id, u.role AS caller_role, sr.user_id AS owner_id, m.ts,
       CASE WHEN u.id IS NULL THEN 'unauthorized'
            WHEN NOT (coalesce(length(m.body) >= 1, false) AND (m.attachments IS NULL OR NOT EXISTS (
                 SELECT 1 FROM unnest(m.attachments) t(x) WHERE NOT coalesce(regexp_matches(x, '{URL_RE}'), false))))
                 THEN 'invalid'
            WHEN sr.id IS NULL THEN 'not_found'
            WHEN sr.user_id <> m.sender_id AND u.role NOT IN ('admin', 'editor') THEN 'forbidden'
            ELSE 'created' END AS outcome
FROM d_message_posts m LEFT JOIN d_users u ON u.id = m.sender_id
LEFT JOIN d_service_requests sr ON sr.id = m.request_id
""")


@register("post_messages", """
SELECT seq, request_id, sender_id, caller_role, owner_id, ts, outcome,
       CASE WHEN outcome = 'created' THEN sha256(concat_ws('~', 'message', CAST(seq AS VARCHAR))) END AS message_id
FROM mo
""", _MSG_OUT)
def q_post_messages(d):
    _, outcomes = changes.post_messages(d.message_posts, d.service_requests, d.users)
    return outcomes


_DLV_OUT = ("dvo", f"""
SELECT p.seq, p.request_id, p.actor_id, sr.user_id AS owner_id, p.ts,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN NOT coalesce(u.role IN ('admin', 'editor'), false) THEN 'forbidden'
            WHEN NOT (coalesce(length(p.title) >= 2, false) AND coalesce(regexp_matches(p.file_url, '{URL_RE}'), false))
                 THEN 'invalid'
            WHEN sr.id IS NULL THEN 'not_found' ELSE 'created' END AS outcome
FROM d_deliverable_posts p LEFT JOIN d_users u ON u.id = p.actor_id
LEFT JOIN d_service_requests sr ON sr.id = p.request_id
""")


@register("post_deliverables", """
SELECT seq, request_id, actor_id, owner_id, ts, outcome,
       CASE WHEN outcome = 'created' THEN sha256(concat_ws('~', 'deliverable', CAST(seq AS VARCHAR))) END AS deliverable_id
FROM dvo
""", _DLV_OUT)
def q_post_deliverables(d):
    _, outcomes = changes.post_deliverables(d.deliverable_posts, d.service_requests, d.users)
    return outcomes


_QUOTE_OUT = ("qo", """
SELECT p.seq, p.request_id, p.actor_id, sr.user_id AS owner_id, p.amount_cents, p.notes, p.ts,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN NOT coalesce(u.role IN ('admin', 'editor'), false) THEN 'forbidden'
            WHEN NOT coalesce(p.amount_cents >= 0, false) THEN 'invalid'
            WHEN sr.id IS NULL THEN 'not_found' ELSE 'accepted' END AS outcome
FROM d_quote_posts p LEFT JOIN d_users u ON u.id = p.actor_id
LEFT JOIN d_service_requests sr ON sr.id = p.request_id
""")


@register("submit_quotes", "SELECT * FROM qo", _QUOTE_OUT)
def q_submit_quotes(d):
    return changes.submit_quotes(d.quote_posts, d.service_requests, d.users)


_STATUS_OUT = ("so", """
SELECT p.seq, p.request_id, p.actor_id, p.status, p.ts,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN NOT coalesce(u.role IN ('admin', 'editor'), false) THEN 'forbidden'
            WHEN NOT coalesce(p.status IN ('open', 'needs_info', 'quoted', 'paid', 'in_progress', 'delivered',
                                          'completed', 'declined'), false) THEN 'invalid'
            WHEN sr.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM d_status_posts p LEFT JOIN d_users u ON u.id = p.actor_id
LEFT JOIN d_service_requests sr ON sr.id = p.request_id
""")


@register("set_status", "SELECT * FROM so", _STATUS_OUT)
def q_set_status(d):
    return changes.set_status(d.status_posts, d.service_requests, d.users)


_DECLINE_OUT = ("dco", """
SELECT a.seq, a.quote_id, a.caller_id, qo.service_request_id, qo.owner_id, a.ts,
       CASE WHEN qo.id IS NULL THEN 'not_found' WHEN qo.owner_id <> a.caller_id THEN 'forbidden' ELSE 'declined' END AS outcome
FROM d_quote_answers a
LEFT JOIN (SELECT q.id, q.service_request_id, sr.user_id AS owner_id FROM d_quotes q
           JOIN d_service_requests sr ON sr.id = q.service_request_id) qo ON qo.id = a.quote_id
WHERE a.action = 'decline'
""")


@register("decline_quotes", "SELECT * FROM dco", _DECLINE_OUT)
def q_decline_quotes(d):
    declines = d.quote_answers.where(F.col("action") == "decline").select("seq", "quote_id", "caller_id", "ts")
    _, outcomes = changes.decline_quotes(declines, d.quotes, d.service_requests)
    return outcomes


_ACCEPT_OUT = ("aco", """
SELECT a.seq, a.quote_id, a.caller_id, a.ts, x.service_request_id, x.amount_cents, x.service_id, x.service_title,
       CASE WHEN x.id IS NULL THEN 'not_found' WHEN x.user_id <> a.caller_id THEN 'forbidden'
            WHEN x.status NOT IN ('sent', 'draft') THEN 'bad_state' ELSE 'accept' END AS outcome0
FROM d_quote_answers a
LEFT JOIN (SELECT q.id, q.service_request_id, q.amount_cents, q.status, sr.user_id, sr.service_id, s.title AS service_title
           FROM d_quotes q JOIN d_service_requests sr ON sr.id = q.service_request_id
           JOIN d_services s ON s.id = sr.service_id) x ON x.id = a.quote_id
WHERE a.action = 'accept'
""")
_ACCEPT_FINAL = ("acf", """
SELECT aco.*, CASE WHEN outcome0 = 'accept' AND seq <> w.first_seq THEN 'bad_state' ELSE outcome0 END AS outcome
FROM aco LEFT JOIN (SELECT quote_id, min(seq) AS first_seq FROM aco WHERE outcome0 = 'accept' GROUP BY quote_id) w
  ON w.quote_id = aco.quote_id
""")


@register("order_from_quote", """
SELECT sha256(concat_ws('~', 'quote-order', CAST(seq AS VARCHAR))) AS id, caller_id AS user_id, 'pending' AS status,
       amount_cents AS total_cents, 'service' AS type, ts AS created_at, service_request_id,
       sha256(concat_ws('~', 'quote-item', CAST(seq AS VARCHAR))) AS item_id, service_title AS item_title
FROM acf WHERE outcome = 'accept'
""", _ACCEPT_OUT, _ACCEPT_FINAL)
def q_order_from_quote(d):
    """Pending service orders (one item each) created by accepted quotes."""
    acc = accepted_quotes(d)
    orders_df, items_df = changes_order_from_quote(acc, d)
    return (orders_df.join(items_df.select(F.col("order_id").alias("_o"), F.col("id").alias("item_id"),
                                           F.col("title").alias("item_title")), F.col("id") == F.col("_o"))
            .drop("_o"))


#: Submissions that pass their guard, accepts and declines as the events of one batch. An answer's quote has its request's id.
_QUOTE_EVENTS = ("qev", """
SELECT 3 * seq AS seq, request_id, 'quote' AS kind, actor_id AS caller_id, amount_cents, notes, ts FROM qo WHERE outcome = 'accepted'
UNION ALL
SELECT 3 * seq + 1, quote_id, action, caller_id, NULL, NULL, ts FROM d_quote_answers
UNION ALL
SELECT 3 * e.event_id + 2, e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations), CASE WHEN e.event_id % 2 = 0 THEN 'accept' ELSE 'decline' END,
       e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations) + 2, NULL, NULL, e.ts FROM events e WHERE e.event_type = 'click'
""")
_QUOTE_STEPS = """
WITH RECURSIVE e AS (
  SELECT v.*, r.id IS NOT NULL AS found, coalesce(v.caller_id = r.user_id, false) AS mine,
         row_number() OVER (PARTITION BY v.request_id ORDER BY v.ts NULLS FIRST, v.seq) AS rn
  FROM qev v LEFT JOIN d_service_requests r ON r.id = v.request_id),
steps AS (
  SELECT x.request_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, q.status,
         q.amount_cents, q.amount_cents AS stood, q.notes, q.id, q.created_at
  FROM (SELECT DISTINCT request_id FROM qev) x LEFT JOIN d_quotes q ON q.service_request_id = x.request_id
  UNION ALL
  SELECT e.request_id, e.rn, e.seq,
         CASE WHEN NOT e.found THEN 'not_found' WHEN e.kind = 'quote' THEN 'quoted' WHEN s.status IS NULL THEN 'not_found'
              WHEN NOT e.mine THEN 'forbidden' WHEN e.kind = 'accept' AND s.status NOT IN ('draft', 'sent') THEN 'bad_state'
              WHEN e.kind = 'accept' THEN 'accepted' ELSE 'declined' END,
         CASE WHEN NOT e.found THEN s.status WHEN e.kind = 'quote' THEN 'sent' WHEN s.status IS NULL OR NOT e.mine THEN s.status
              WHEN e.kind = 'accept' THEN CASE WHEN s.status IN ('draft', 'sent') THEN 'accepted' ELSE s.status END ELSE 'declined' END,
         CASE WHEN e.found AND e.kind = 'quote' THEN e.amount_cents ELSE s.amount_cents END,
         CASE WHEN e.kind = 'quote' THEN e.amount_cents WHEN s.status IS NOT NULL THEN s.amount_cents END,
         CASE WHEN e.found AND e.kind = 'quote' THEN e.notes ELSE s.notes END,
         coalesce(s.id, CASE WHEN e.found AND e.kind = 'quote' THEN e.seq END),
         coalesce(s.created_at, CASE WHEN e.found AND e.kind = 'quote' THEN e.ts END)
  FROM steps s JOIN e ON e.request_id = s.request_id AND e.rn = s.rn + 1)
"""


def quote_events(d):
    """The batch's events: submissions that pass their guard, the answers, and more answers by the owners."""
    n = d.service_requests.select(F.col("id").alias("request_id")).agg(F.count(F.lit(1)).alias("n")).scalar()
    sent = changes.submit_quotes(d.quote_posts, d.service_requests, d.users).where(F.col("outcome") == "accepted")
    sent = sent.select((3 * F.col("seq")).alias("seq"), "request_id", F.lit("quote").alias("kind"),
                       F.col("actor_id").alias("caller_id"), "amount_cents", "notes", "ts")
    blank = [F.lit(None).cast("int").alias("amount_cents"), F.lit(None).cast("string").alias("notes"), "ts"]
    answers = d.quote_answers.select((3 * F.col("seq") + 1).alias("seq"), F.col("quote_id").alias("request_id"),
                                     F.col("action").alias("kind"), "caller_id", *blank)
    clicks = d.source("events").where(F.col("event_type") == "click")
    owners = clicks.select((3 * F.col("event_id") + 2).alias("seq"), (F.col("event_id") % n).alias("request_id"),
                           F.when(F.col("event_id") % 2 == 0, "accept").otherwise("decline").alias("kind"),
                           (F.col("event_id") % n + 2).alias("caller_id"), *blank)
    return sent.unionByName(answers).unionByName(owners)


@register("accept_quotes", _QUOTE_STEPS + """
SELECT s.seq, e.request_id, e.kind, e.caller_id, e.ts, s.outcome, s.stood AS amount_cents
FROM steps s JOIN e ON e.request_id = s.request_id AND e.rn = s.rn
""", _QUOTE_OUT, _QUOTE_EVENTS)
def q_accept_quotes(d):
    """What became of each submission, accept and decline of a batch, each in its turn."""
    return quote_ops.apply_quote_events(d.quotes, quote_events(d), d.service_requests)[1]


@register("answered_quotes", _QUOTE_STEPS + """
SELECT id, request_id AS service_request_id, amount_cents, notes, status, created_at FROM steps
WHERE status IS NOT NULL QUALIFY rn = max(rn) OVER (PARTITION BY request_id)
UNION ALL
SELECT id, service_request_id, amount_cents, notes, status, created_at FROM d_quotes
WHERE service_request_id NOT IN (SELECT request_id FROM qev)
""", _QUOTE_OUT, _QUOTE_EVENTS)
def q_answered_quotes(d):
    """The quotes after the batch."""
    return quote_ops.apply_quote_events(d.quotes, quote_events(d), d.service_requests)[0]


def accepted_quotes(d):
    """Quote accepts that pass the guard; of several accepts of one quote in a
    batch only the first (by seq) succeeds, later ones find it accepted."""
    checked = guards.acceptable_quotes(d.quote_answers.where(F.col("action") == "accept"), d.quotes,
                                       d.service_requests, d.services)
    checked = changes.first_claim(checked, "quote_id", "seq", F.col("outcome") == "accept")
    return checked.withColumn("outcome", F.when((F.col("outcome") == "accept") & (F.col("seq") != F.col("_claim_order")),
                                                "bad_state").otherwise(F.col("outcome")))


def changes_order_from_quote(acc, d):
    from mercato.operators.orders import order_from_quote

    ok = acc.where(F.col("outcome") == "accept").select(
        F.col("seq").alias("quote_id"), "caller_id", "service_request_id", "amount_cents", "service_id", "ts")
    return order_from_quote(ok, d.services)


_PAY_OUT = ("pyo", """
SELECT p.order_id, p.caller_id, p.paid_at, o.user_id AS owner_id, o.type AS order_type, o.service_request_id,
       CASE WHEN u.id IS NULL THEN 'unauthorized' WHEN o.id IS NULL THEN 'not_found'
            WHEN o.user_id <> p.caller_id AND u.role = 'customer' THEN 'forbidden'
            WHEN o.status = 'paid' THEN 'already_paid' ELSE 'pay' END AS outcome
FROM d_payments p LEFT JOIN d_users u ON u.id = p.caller_id LEFT JOIN d_orders o ON o.id = p.order_id
""")
_PAID = ("paid", """
SELECT order_id, min(owner_id) AS owner_id, min(order_type) AS order_type, min(service_request_id) AS service_request_id,
       min(paid_at) AS paid_at
FROM pyo WHERE outcome = 'pay' GROUP BY order_id
""")

_EVENTS = ("ev", """
SELECT request_id, status, ts, seq FROM so WHERE outcome = 'updated'
UNION ALL SELECT request_id, 'quoted', ts, seq FROM qo WHERE outcome = 'accepted'
UNION ALL SELECT service_request_id, 'in_progress', ts, seq FROM acf WHERE outcome = 'accept'
UNION ALL SELECT service_request_id, 'declined', ts, seq FROM dco WHERE outcome = 'declined'
UNION ALL SELECT request_id, 'delivered', ts, seq FROM dvo WHERE outcome = 'created'
UNION ALL SELECT service_request_id, 'paid', paid_at, order_id FROM paid
  WHERE order_type = 'service' AND service_request_id IS NOT NULL
""")


@register("request_status", """
SELECT r.id, coalesce(l.status, r.status) AS status, coalesce(l.ts, r.updated_at) AS updated_at
FROM d_service_requests r
LEFT JOIN (SELECT request_id, arg_max(status, ts_seq) AS status, max(ts) AS ts
           FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(CAST(seq AS VARCHAR), 20, '0') || status AS ts_seq FROM ev)
           GROUP BY request_id) l ON l.request_id = r.id
""", _STATUS_OUT, _QUOTE_OUT, _ACCEPT_OUT, _ACCEPT_FINAL, _DECLINE_OUT, _DLV_OUT, _PAY_OUT, _PAID, _EVENTS)
def q_request_status(d):
    """Request statuses after one batch of every transition: staff status
    posts, quotes, accepts, declines, deliverables and service payments."""
    return changes.request_status(d.service_requests, status_events(d)).select("id", "status", "updated_at")


def status_events(d):
    from mercato.operators.orders import apply_payments

    so = changes.set_status(d.status_posts, d.service_requests, d.users)
    qo = changes.submit_quotes(d.quote_posts, d.service_requests, d.users)
    acc = accepted_quotes(d)
    declines = d.quote_answers.where(F.col("action") == "decline").select("seq", "quote_id", "caller_id", "ts")
    _, dco = changes.decline_quotes(declines, d.quotes, d.service_requests)
    _, dvo = changes.post_deliverables(d.deliverable_posts, d.service_requests, d.users)
    _, paid = apply_payments(guards.payable_orders(d.payments, d.orders, d.users), d.orders)
    ev = lambda df, rid, status, ts, seq: df.select(
        F.col(rid).alias("request_id"), (F.col(status) if status in df.columns else F.lit(status)).alias("status"),
        F.col(ts).alias("ts"), F.col(seq).cast("long").alias("seq"))
    return (ev(so.where(F.col("outcome") == "updated"), "request_id", "status", "ts", "seq")
            .unionByName(ev(qo.where(F.col("outcome") == "accepted"), "request_id", "quoted", "ts", "seq"))
            .unionByName(ev(acc.where(F.col("outcome") == "accept"), "service_request_id", "in_progress", "ts", "seq"))
            .unionByName(ev(dco.where(F.col("outcome") == "declined"), "service_request_id", "declined", "ts", "seq"))
            .unionByName(ev(dvo.where(F.col("outcome") == "created"), "request_id", "delivered", "ts", "seq"))
            .unionByName(ev(paid.where((F.col("order_type") == "service") & F.col("service_request_id").isNotNull()),
                            "service_request_id", "paid", "paid_at", "order_id")))


@register("audit_events", """
SELECT sha256(concat_ws('~', 'audit', action, CAST(src AS VARCHAR))) AS id, actor_user_id, action, 'user' AS entity,
       actor_user_id AS entity_id, meta, created_at
FROM (SELECT a.seq AS src, CAST(u.id AS VARCHAR) AS actor_user_id, 'user.login' AS action,
             CAST(json_object('email', lower(a.email)) AS VARCHAR) AS meta, a.ts AS created_at
      FROM d_login_attempts a JOIN d_users u ON u.email = lower(a.email)
      UNION ALL
      SELECT seq, user_id, 'user.register', CAST(json_object('email', email) AS VARCHAR), TIMESTAMP '2024-02-01 00:00:00'
      FROM reg WHERE outcome = 'created')
""", _REG)
def q_audit_events(d):
    """Audit rows of successful logins and registrations."""
    from mercato.operators.audit import audit_events
    from mercato.operators.keys import account_by_email

    logins = account_by_email(d.login_attempts, d.users).where(F.col("outcome") == "ok").select(
        "seq", "user_id", F.col("normalized_email").alias("email"), "ts")
    _, reg = changes.register_users(d.registrations, d.users, NOW)
    regs = reg.where(F.col("outcome") == "created").select("seq", "user_id", "email", ntz(NOW).alias("ts"))
    return audit_events(logins, regs)


@register("read_changes", """
SELECT CASE WHEN seq % 19 = 0 THEN NULL ELSE seq END AS seq,
       CASE WHEN seq % 19 = 0 THEN NULL ELSE lower(email) END AS email,
       seq % 19 = 0 AS is_corrupt
FROM d_registrations
""")
def q_read_changes(d):
    """Registrations round-tripped through JSON-lines change files, every
    19th line damaged: good rows parse, damaged ones are kept aside."""
    from mercato.session import scratch_path
    from mercato.sources.changes import CORRUPT, read_changes, write_changes

    path = write_changes(d.registrations, scratch_path(d.spark, "changes"), F.col("seq") % 19 == 0)
    good, bad = read_changes(d.spark, path, d.registrations.schema)
    return (good.select("seq", F.lower("email").alias("email"), F.lit(False).alias("is_corrupt"))
            .unionByName(bad.select("seq", F.lower("email").alias("email"),
                                    F.col(CORRUPT).isNotNull().alias("is_corrupt"))))


@register("write_snapshot", f"""
SELECT t.id, coalesce(u.slug, t.slug) AS slug, coalesce(u.title, t.title) AS title,
       coalesce(u.price_cents, t.price_cents) AS price_cents, t.is_active,
       CASE WHEN u.id IS NOT NULL THEN {NOW_SQL} ELSE t.updated_at END AS updated_at
FROM d_products t LEFT JOIN (SELECT * FROM po WHERE outcome = 'updated') u ON u.id = t.id
""", _PATCH_P, _PATCH_O)
def q_write_snapshot(d):
    """The patched products table written as a new snapshot and read back
    through the snapshot pointer."""
    from mercato.session import scratch_path
    from mercato.sources.sinks import read_snapshot, write_snapshot

    root = scratch_path(d.spark, "products")
    write_snapshot(d.products, root)
    table, _ = _product_patch(d)
    write_snapshot(table, root)
    return read_snapshot(d.spark, root).select("id", "slug", "title", "price_cents", "is_active", "updated_at")


ADMIN_USER_ISSUES = "concat_ws(',', " + ", ".join([
    bad(f"regexp_matches(email, '{EMAIL_RE}')", "email"), bad("length(password) >= 8", "password"),
    bad("length(name) >= 2", "name"), bad("role IN ('customer', 'editor', 'admin')", "role")]) + ")"


@register("admin_create_users", f"""
WITH r AS (SELECT seq, lower(email) AS email, role, {ADMIN_USER_ISSUES} AS issues_canon FROM d_admin_users),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM d_users u WHERE lower(u.email) = r.email) AS taken FROM r),
w AS (SELECT email, min(seq) AS first_seq FROM x WHERE issues_canon = '' AND NOT taken GROUP BY email)
SELECT x.seq, x.email, x.role,
       CASE WHEN x.issues_canon <> '' THEN 'invalid' WHEN x.taken OR x.seq <> w.first_seq THEN 'conflict'
            ELSE 'created' END AS outcome,
       x.issues_canon,
       CASE WHEN x.issues_canon = '' AND NOT x.taken AND x.seq = w.first_seq
            THEN sha256(concat_ws('~', 'user', x.email)) END AS user_id
FROM x LEFT JOIN w ON w.email = x.email
""")
def q_admin_create_users(d):
    """Admin user creation: the admin rule set and the chosen role."""
    inserts, outcomes = changes.register_users(d.admin_users, d.users, NOW, admin=True)
    roles = d.admin_users.select(F.col("seq").alias("_s"), "role")
    return (outcomes.join(roles, outcomes["seq"] == roles["_s"], "left")
            .select("seq", "email", "role", "outcome", canon(), "user_id"))


SERVICE_ISSUES = "concat_ws(',', " + ", ".join([
    bad("length(slug) >= 3", "slug"), bad("length(title) >= 3", "title"),
    bad("length(description) >= 10", "description"),
    bad("base_price_cents IS NOT NULL AND base_price_cents >= 0", "price")]) + ")"


@register("insert_services", f"""
WITH x AS (SELECT i.*, {SERVICE_ISSUES} AS issues_canon,
                  EXISTS (SELECT 1 FROM d_services s WHERE s.slug = i.slug) AS taken FROM d_service_inserts i),
o AS (SELECT x.*, CASE WHEN x.issues_canon <> '' THEN 'invalid'
                       WHEN x.taken OR x.seq <> w.first_seq THEN 'conflict' ELSE 'created' END AS outcome
      FROM x LEFT JOIN (SELECT slug, min(seq) AS first_seq FROM x WHERE issues_canon = '' AND NOT taken GROUP BY slug) w
        ON w.slug = x.slug)
SELECT o.seq, o.slug, o.outcome, o.issues_canon,
       CASE WHEN o.outcome = 'created' THEN sha256(concat_ws('~', 'service', o.slug)) END AS id,
       CASE WHEN o.outcome = 'created' THEN coalesce(o.is_active, true) END AS is_active,
       CASE WHEN o.outcome = 'created' THEN coalesce(o.tags, CAST([] AS VARCHAR[])) END AS tags
FROM o
""")
def q_insert_services(d):
    """Service inserts: slug-unique check and defaults (is_active true, tags [])."""
    inserts, outcomes = changes.insert_catalog(d.service_inserts, d.services, "service", NOW)
    ins = inserts.select(F.col("slug").alias("_slug"), "id", "is_active", "tags")
    return (outcomes.join(ins, outcomes["slug"] == ins["_slug"], "left")
            .select("seq", "slug", "outcome", canon(), F.when(F.col("outcome") == "created", F.col("id")).alias("id"),
                    F.when(F.col("outcome") == "created", F.col("is_active")).alias("is_active"),
                    F.when(F.col("outcome") == "created", F.col("tags")).alias("tags")))


@register("validate_orders", """
SELECT r.order_seq,
       concat_ws(',',
         CASE WHEN NOT coalesce(r.type IN ('digital', 'service', 'coaching'), false) THEN 'type' END,
         CASE WHEN NOT coalesce(l.n >= 1, false) THEN 'items' END,
         CASE WHEN NOT coalesce(l.q_ok, false) THEN 'quantity' END,
         CASE WHEN NOT coalesce(l.k_ok, false) THEN 'key' END) AS issues_canon
FROM d_order_requests r
LEFT JOIN (SELECT order_seq, count(*) AS n, bool_and(coalesce(quantity > 0, false)) AS q_ok,
                  bool_and((product_id IS NULL OR product_id >= 0) AND (service_id IS NULL OR service_id >= 0)) AS k_ok
           FROM d_order_lines GROUP BY order_seq) l ON l.order_seq = r.order_seq
""")
def q_validate_orders(d):
    """Order payloads (type + nested items) against the order rule set."""
    items = d.order_lines.groupBy("order_seq").agg(
        F.collect_list(F.struct("product_id", "service_id", "quantity")).alias("items"))
    body = d.order_requests.join(items, "order_seq", "left")
    return body.select("order_seq", F.array_join(issues("order"), ",").alias("issues_canon"))


@register("validate_payments", """
SELECT order_id, caller_id, CASE WHEN NOT coalesce(order_id >= 0, false) THEN 'key' ELSE '' END AS issues_canon
FROM d_payments
""")
def q_validate_payments(d):
    return d.payments.select("order_id", "caller_id", F.array_join(issues("payment"), ",").alias("issues_canon"))


@register("validate_broadcasts", """
SELECT seq, concat_ws(',', CASE WHEN NOT coalesce(length(title) >= 3, false) THEN 'title' END,
                           CASE WHEN NOT coalesce(length(body) >= 3, false) THEN 'body' END,
                           CASE WHEN role IS NOT NULL AND NOT coalesce(role IN ('customer', 'editor', 'admin'), false)
                                THEN 'role' END) AS issues_canon
FROM d_broadcasts
""")
def q_validate_broadcasts(d):
    return d.broadcasts.select("seq", F.array_join(issues("broadcast"), ",").alias("issues_canon"))


_SPATCH = ("sp", """
SELECT sp.*,
       concat_ws(',', CASE WHEN slug IS NOT NULL AND NOT coalesce(length(slug) >= 3, false) THEN 'slug' END,
                      CASE WHEN title IS NOT NULL AND NOT coalesce(length(title) >= 3, false) THEN 'title' END,
                      CASE WHEN base_price_cents IS NOT NULL AND NOT coalesce(base_price_cents >= 0, false) THEN 'price' END) AS issues_canon,
       CAST(slug IS NOT NULL AS INT) + CAST(title IS NOT NULL AS INT) + CAST(base_price_cents IS NOT NULL AS INT) AS n_given,
       EXISTS (SELECT 1 FROM d_services t WHERE t.id = sp.id) AS found,
       EXISTS (SELECT 1 FROM d_services t WHERE t.slug = sp.slug AND t.id <> sp.id) AS clash
FROM d_service_patches sp
""")


@register("apply_service_patches", """
SELECT p.id, CASE WHEN p.issues_canon <> '' THEN 'invalid'
                  WHEN p.slug IS NOT NULL AND (p.clash OR (w.claim IS NOT NULL AND p.id > w.claim)) THEN 'conflict'
                  WHEN p.n_given = 0 THEN 'no_updates' WHEN NOT p.found THEN 'not_found' ELSE 'updated' END AS outcome,
       p.issues_canon
FROM sp p LEFT JOIN (SELECT slug, min(id) AS claim FROM sp
                     WHERE issues_canon = '' AND slug IS NOT NULL AND NOT clash AND found GROUP BY slug) w
  ON w.slug = p.slug
""", _SPATCH)
def q_apply_service_patches(d):
    """Partial service updates (slug unique among services, updated_at bumped)."""
    _, outcomes = changes.apply_patches(d.services, d.service_patches, ["slug", "title", "base_price_cents"], "slug",
                                        NOW, rules=changes.patch_rules("service"))
    return outcomes.select("id", "outcome", canon())
