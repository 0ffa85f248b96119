"""Registered catalogue, visibility and guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.functions.columns import camel_columns, role_at_least, role_in, STAFF_ROLES
from mercato.operators import catalog, guards, visibility
from mercato.plans.registry import register
from mercato.sources.domain import conform


@register("camel_columns", """
SELECT id, slug, title, description, price_cents AS "priceCents", is_active AS "isActive", sku, tags,
       cover_image_url AS "coverImageUrl", digital_file_url AS "digitalFileUrl",
       created_at AS "createdAt", updated_at AS "updatedAt"
FROM d_products
""")
def q_camel_columns(d):
    return camel_columns(catalog.admin_products(d.products))


@register("active_products", """
SELECT id, slug, title, description, price_cents, tags, cover_image_url FROM d_products WHERE is_active
""")
def q_active_products(d):
    return catalog.active_products(d.products)


@register("active_services", """
SELECT id, slug, title, description, base_price_cents, tags FROM d_services WHERE is_active
""")
def q_active_services(d):
    return catalog.active_services(d.services)


@register("admin_products", """
SELECT id, slug, title, description, price_cents, is_active, sku, tags, cover_image_url, digital_file_url,
       created_at, updated_at FROM d_products
""")
def q_admin_products(d):
    return catalog.admin_products(d.products)


@register("admin_services", """
SELECT id, slug, title, description, base_price_cents, is_active, tags, created_at, updated_at FROM d_services
""")
def q_admin_services(d):
    return catalog.admin_services(d.services)


@register("admin_users", """
SELECT id, email, name, role, created_at FROM d_users
""")
def q_admin_users(d):
    return catalog.admin_users(conform(d.users, "users"))


@register("lookup_products", """
SELECT l.seq, l.slug, p.id, p.title, p.description, p.price_cents, p.tags, p.cover_image_url,
       p.digital_file_url, p.id IS NOT NULL AS found
FROM d_slug_lookups l LEFT JOIN (SELECT * FROM d_products WHERE is_active) p ON p.slug = l.slug
""")
def q_lookup_products(d):
    return catalog.lookup_products(d.slug_lookups, d.products)


@register("lookup_services", """
SELECT l.seq, l.slug, s.id, s.title, s.description, s.base_price_cents, s.tags, s.id IS NOT NULL AS found
FROM d_service_slug_lookups l LEFT JOIN (SELECT * FROM d_services WHERE is_active) s ON s.slug = l.slug
""")
def q_lookup_services(d):
    return catalog.lookup_services(d.service_slug_lookups, d.services)


@register("role_at_least", """
SELECT id, role,
       coalesce(CASE role WHEN 'customer' THEN 1 WHEN 'editor' THEN 2 WHEN 'admin' THEN 3 END >= 2, false) AS at_least_editor,
       coalesce(CASE role WHEN 'customer' THEN 1 WHEN 'editor' THEN 2 WHEN 'admin' THEN 3 END >= 3, false) AS is_admin,
       role IN ('admin', 'editor') AS is_staff
FROM d_users
""")
def q_role_at_least(d):
    return d.users.select("id", "role", role_at_least("role", "editor").alias("at_least_editor"),
                          role_at_least("role", "admin").alias("is_admin"),
                          role_in("role", STAFF_ROLES).alias("is_staff"))


_VIS_ORDERS = """
SELECT v.id AS viewer_id, 'own' AS scope, o.id AS row_id
FROM d_viewers v JOIN d_orders o ON o.user_id = v.id
WHERE v.role = 'customer' OR v.mine
UNION ALL
SELECT CAST(NULL AS BIGINT), 'all', o.id FROM d_orders o
WHERE EXISTS (SELECT 1 FROM d_viewers v WHERE NOT (v.role = 'customer' OR v.mine))
"""


@register("visible_rows", _VIS_ORDERS)
def q_visible_rows(d):
    """Order visibility for every viewer at once."""
    return visibility.visible_rows(d.viewers, d.orders, "orders")


@register("visible_requests", """
SELECT v.id AS viewer_id, 'own' AS scope, r.id AS row_id
FROM d_viewers v JOIN d_service_requests r ON r.user_id = v.id
WHERE v.role = 'customer' OR v.mine OR v.role NOT IN ('admin', 'editor')
UNION ALL
SELECT CAST(NULL AS BIGINT), 'all', r.id FROM d_service_requests r
WHERE EXISTS (SELECT 1 FROM d_viewers v WHERE NOT (v.role = 'customer' OR v.mine OR v.role NOT IN ('admin', 'editor')))
""")
def q_visible_requests(d):
    return visibility.visible_rows(d.viewers, d.service_requests, "requests")


@register("visible_notifications", """
SELECT v.id AS viewer_id, CASE WHEN v.mine THEN 'own' ELSE 'target' END AS scope, n.id AS row_id
FROM d_viewers v JOIN d_notifications n
  ON n.user_id = CASE WHEN v.mine THEN v.id WHEN v.role = 'admin' THEN coalesce(v.target_user_id, v.id) END
""")
def q_visible_notifications(d):
    return visibility.visible_rows(d.viewers, d.notifications, "notifications")


@register("unread_only", """
SELECT id, user_id, type, title, created_at FROM d_notifications WHERE read_at IS NULL
""")
def q_unread_only(d):
    return d.notifications.where(F.col("read_at").isNull()).select("id", "user_id", "type", "title", "created_at")


@register("payable_orders", """
SELECT p.order_id, p.caller_id, p.paid_at, u.role AS caller_role, o.user_id AS owner_id, o.status AS order_status,
       o.type AS order_type, o.service_request_id,
       CASE WHEN u.id IS NULL THEN 'unauthorized'
            WHEN o.id IS NULL THEN 'not_found'
            WHEN o.user_id <> p.caller_id AND u.role = 'customer' THEN 'forbidden'
            WHEN o.status = 'paid' THEN 'already_paid'
            ELSE 'pay' END AS outcome
FROM d_payments p LEFT JOIN d_users u ON u.id = p.caller_id LEFT JOIN d_orders o ON o.id = p.order_id
""")
def q_payable_orders(d):
    return guards.payable_orders(d.payments, d.orders, d.users)


@register("acceptable_quotes", """
SELECT a.seq, a.quote_id, a.caller_id, a.action, a.ts, q.service_request_id, q.amount_cents,
       q.status AS quote_status, r.user_id AS owner_id, r.service_id, s.title AS service_title,
       CASE WHEN q.id IS NULL THEN 'not_found'
            WHEN r.user_id <> a.caller_id THEN 'forbidden'
            WHEN q.status NOT IN ('sent', 'draft') THEN 'bad_state'
            ELSE 'accept' END AS outcome
FROM d_quote_answers a
LEFT JOIN (d_quotes q JOIN d_service_requests r ON r.id = q.service_request_id JOIN d_services s ON s.id = r.service_id)
  ON q.id = a.quote_id
WHERE a.action = 'accept'
""")
def q_acceptable_quotes(d):
    return guards.acceptable_quotes(d.quote_answers.where(F.col("action") == "accept"), d.quotes,
                                    d.service_requests, d.services)


_ENC = "replace(replace(replace(replace(replace(url_encode({c}), '%21', '!'), '%2A', '*'), '%28', '('), '%29', ')'), '%27', '''')"


@register("product_cards", f"""
SELECT id, slug, title,
       '$' || CAST(price_cents // 100 AS VARCHAR) || '.' || lpad(CAST(price_cents % 100 AS VARCHAR), 2, '0') AS price_text,
       '/product.html?slug=' || {_ENC.format(c='slug')} AS href,
       {_ENC.format(c='title')} AS title_encoded,
       CASE WHEN tags IS NULL OR len(tags) = 0 THEN ''
            ELSE '<span class="tag">' || array_to_string(tags, '</span><span class="tag">') || '</span>' END AS tags_html,
       coalesce(cover_image_url, 'https://images.unsplash.com/photo-1454165205744-3b78555e5572') AS cover
FROM d_products WHERE is_active
""")
def q_product_cards(d):
    """Scalar functions of the catalogue page: price text, URI encoding, tag markup."""
    return catalog.product_cards(d.products)


@register("visible_request_detail", """
SELECT v.id AS viewer_id, 'own' AS scope, r.id AS row_id
FROM d_viewers v JOIN d_service_requests r ON r.user_id = v.id
WHERE NOT coalesce(v.role IN ('admin', 'editor'), false)
UNION ALL
SELECT CAST(NULL AS BIGINT), 'all', r.id FROM d_service_requests r
WHERE EXISTS (SELECT 1 FROM d_viewers v WHERE v.role IN ('admin', 'editor'))
""")
def q_visible_request_detail(d):
    """Single-request rule: the owner, or any staff member."""
    return visibility.visible_rows(d.viewers, d.service_requests, "request")


@register("role_in", """
SELECT id, role, created_at FROM d_users WHERE role IN ('admin', 'editor')
""")
def q_role_in(d):
    """Users whose role is in a given set (here: staff)."""
    return d.users.where(role_in("role", STAFF_ROLES)).select("id", "role", "created_at")
