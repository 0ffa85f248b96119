"""Binding of the driver's source tables to the domain schema.

One text per view, run by Spark as a temp view and by DuckDB as a leading
CTE, so both engines start every query from identical rows. The domain
name ``orders`` clashes with the source table, hence the ``d_`` prefix.
Views only read source tables (never each other), so any subset can be
prepended as CTEs in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


DOMAIN_VIEWS: dict[str, str] = {
    "d_users": """
SELECT c.c_custkey AS id,
       concat('user', CAST(c.c_custkey AS STRING), '@example.com') AS email,
       c.c_name AS name,
       CASE c.c_custkey % 50 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'customer' END AS role,
       f.created_at AS created_at
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
""",
    "d_products": """
SELECT p.p_partkey AS id,
       concat(replace(lower(p.p_name), ' ', '-'), '-', CAST(p.p_partkey AS STRING)) AS slug,
       p.p_name AS title,
       concat(p.p_type, ' item by ', p.p_brand) AS description,
       CAST(round(p.p_retailprice * 100) AS INT) AS price_cents,
       p.p_partkey % 10 <> 0 AS is_active,
       CASE WHEN p.p_partkey % 3 <> 0 THEN concat('SKU-', CAST(p.p_partkey AS STRING)) END AS sku,
       split(concat(lower(p.p_type), ',', lower(p.p_brand)), ',') AS tags,
       f.created_at AS created_at,
       CAST(NULL AS STRING) AS cover_image_url,
       CASE WHEN p.p_partkey % 2 = 0 THEN concat('https://files.example.com/p/', CAST(p.p_partkey AS STRING)) END AS digital_file_url,
       f.created_at AS updated_at
FROM part p
LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_partkey) f ON f.l_partkey = p.p_partkey
""",
    "d_services": """
SELECT s.s_suppkey AS id,
       concat('service-', CAST(s.s_suppkey AS STRING)) AS slug,
       s.s_name AS title,
       concat('Service offered by ', s.s_name) AS description,
       CAST(round(abs(s.s_acctbal) * 100) AS INT) AS base_price_cents,
       s.s_suppkey % 10 <> 0 AS is_active,
       f.created_at AS created_at,
       split(concat('service,nation-', CAST(s.s_nationkey AS STRING)), ',') AS tags,
       f.created_at AS updated_at
FROM supplier s
LEFT JOIN (SELECT l_suppkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey) f ON f.l_suppkey = s.s_suppkey
""",
    "d_orders": """
SELECT o.o_orderkey AS id,
       o.o_custkey AS user_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'canceled' END AS status,
       CAST(round(o.o_totalprice * 100) AS INT) AS total_cents,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'service' WHEN '2-HIGH' THEN 'coaching' ELSE 'digital' END AS type,
       o.o_orderdate AS created_at,
       CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderkey % 5 <> 0 THEN o.o_orderkey % (SELECT count(DISTINCT conv_id) FROM conversations) END AS service_request_id
FROM orders o
""",
    "d_order_items": """
SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING),
                 CAST(l.l_suppkey AS STRING), CAST(CAST(l.l_quantity AS INT) AS STRING),
                 CAST(CAST(round(l.l_extendedprice * 100) AS INT) AS STRING)) AS id,
       l.l_orderkey AS order_id,
       CASE WHEN l.l_returnflag <> 'R' THEN l.l_partkey END AS product_id,
       CASE WHEN l.l_returnflag = 'R' THEN l.l_suppkey END AS service_id,
       CASE WHEN l.l_returnflag = 'R' THEN s.s_name ELSE p.p_name END AS title,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(round(abs(s.s_acctbal) * 100) AS INT)
            ELSE CAST(round(p.p_retailprice * 100) AS INT) END AS unit_price_cents,
       CAST(l.l_quantity AS INT) AS quantity,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(round(abs(s.s_acctbal) * 100) AS INT)
            ELSE CAST(round(p.p_retailprice * 100) AS INT) END * CAST(l.l_quantity AS INT) AS subtotal_cents
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
""",
    "d_service_requests": """
SELECT c.conv_id AS id,
       c.conv_id + 2 AS user_id,
       c.conv_id % (SELECT count(*) FROM supplier) AS service_id,
       CASE c.conv_id % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'needs_info' WHEN 2 THEN 'quoted' WHEN 3 THEN 'paid'
            WHEN 4 THEN 'in_progress' WHEN 5 THEN 'delivered' WHEN 6 THEN 'completed' ELSE 'declined' END AS status,
       concat('{"goal":"g', CAST(c.conv_id % 5 AS STRING), '"}') AS brief,
       e.ts AS created_at,
       e.ts AS updated_at
FROM (SELECT DISTINCT conv_id FROM conversations) c
JOIN events e ON e.event_id = c.conv_id
""",
    "d_messages": """
SELECT c.conv_id * 100 + c.turn AS id,
       c.conv_id AS service_request_id,
       CASE c.role WHEN 'user' THEN c.conv_id + 2 WHEN 'assistant' THEN 1 ELSE 0 END AS sender_user_id,
       c.text AS body,
       e.ts AS created_at,
       split(concat('https://files.example.com/m/', CAST(c.conv_id AS STRING), '-', CAST(c.turn AS STRING)), ',') AS attachments
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 8 + c.turn
""",
    "d_quote_submissions": """
SELECT e.event_id AS id, e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS service_request_id,
       CAST(round(e.value * 100) AS INT) AS amount_cents,
       CASE WHEN e.event_id % 2 = 0 THEN e.props END AS notes,
       e.ts AS submitted_at
FROM events e
WHERE e.event_type = 'purchase'
""",
    "d_quotes": """
SELECT e.event_id AS id, e.event_id AS service_request_id,
       CAST(round(e.value * 100) AS INT) AS amount_cents,
       CASE e.event_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent' WHEN 2 THEN 'accepted' ELSE 'declined' END AS status,
       e.ts AS created_at,
       CASE WHEN e.event_id % 2 = 0 THEN e.props END AS notes
FROM events e JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = e.event_id
WHERE e.event_id % 8 >= 2
""",
    "d_notifications": """
SELECT event_id AS id, user_id, event_type AS type, event_type AS title, concat('Event ', event_type) AS body,
       props AS meta, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at, ts AS created_at
FROM events
""",
    "d_deliverables": """
SELECT p.page_id AS id, p.page_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS service_request_id,
       concat('File ', CAST(p.page_id AS STRING)) AS title, p.url AS file_url, e.ts AS created_at,
       CASE WHEN p.page_id % 2 = 0 THEN concat('Delivery ', CAST(p.page_id AS STRING)) END AS description
FROM pages p
JOIN events e ON e.event_id = p.page_id
""",
    "d_audit_log": """
SELECT event_id AS id, user_id AS actor_user_id,
       CASE event_type WHEN 'signup' THEN 'user.register' ELSE 'user.login' END AS action,
       'user' AS entity, user_id AS entity_id, props AS meta, ts AS created_at
FROM events WHERE event_type IN ('signup', 'click')
""",
}

# Change tables for the bulk jobs: each mixes good rows with every kind of reject.
CHANGE_VIEWS: dict[str, str] = {
    "d_registrations": """
SELECT c_custkey AS seq,
       CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email'
            ELSE concat('User', CAST((c_custkey * 7) % 400 AS STRING), '@Example.com') END AS email,
       CASE WHEN c_custkey % 13 = 0 THEN 'short' ELSE 'long-enough-1' END AS password,
       CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_name END AS name
FROM customer
""",
    "d_product_patches": """
SELECT p_partkey + CASE WHEN p_partkey % 40 = 0 THEN 1000000 ELSE 0 END AS id,
       CASE WHEN p_partkey % 20 = 0 THEN 'new-slug' WHEN p_partkey % 60 = 10 THEN (SELECT concat(replace(lower(p_name), ' ', '-'), '-1') FROM part WHERE p_partkey = 1) END AS slug,
       CASE WHEN p_partkey % 4 = 0 THEN concat(part.p_name, ' v2') END AS title,
       CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size * 100 AS INT) END AS price_cents
FROM part
WHERE p_partkey % 2 = 0
""",
    # In turn by seq: from the highest id down, products take over the slug that the next one gave up (or did not, where
    # its own claim failed); many claim one slug; then its holders leave it and others come.
    "d_product_moves": """
SELECT 1000000000 - p.p_partkey AS seq,
       p.p_partkey + CASE WHEN p.p_partkey % 40 = 0 THEN 1000000 ELSE 0 END AS id,
       CASE WHEN p.p_partkey % 50 = 1 THEN 'x' WHEN p.p_partkey % 3 = 0 OR p.p_partkey % 27 = 8 THEN 'front-page'
            WHEN p.p_partkey % 9 = 8 THEN concat('spring-', CAST(p.p_partkey AS STRING))
            WHEN p.p_partkey % 11 <> 4 AND q.p_partkey IS NOT NULL THEN concat(replace(lower(q.p_name), ' ', '-'), '-', CAST(q.p_partkey AS STRING)) END AS slug,
       CASE WHEN p.p_partkey % 4 = 0 THEN concat(p.p_name, ' v2') END AS title,
       CASE WHEN p.p_partkey % 6 = 0 THEN concat('Now from ', p.p_brand, ', ', p.p_type) END AS description,
       CASE WHEN p.p_partkey % 8 = 0 THEN CAST(p.p_size * 100 AS INT) END AS price_cents,
       CASE WHEN p.p_partkey % 12 = 0 THEN p.p_size > 20 END AS is_active,
       CASE WHEN p.p_partkey % 14 = 0 THEN concat('NEW-', CAST(p.p_partkey AS STRING)) END AS sku,
       CASE WHEN p.p_partkey % 10 = 0 THEN split(lower(p.p_brand), ',') END AS tags,
       CASE WHEN p.p_partkey % 16 = 0 THEN concat('https://img.example.com/', CAST(p.p_partkey AS STRING)) END AS cover_image_url,
       CASE WHEN p.p_partkey % 18 = 0 THEN 'https://files.example.com/new' END AS digital_file_url
FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1
UNION ALL
SELECT 1000000001 + p.p_partkey AS seq, p.p_partkey AS id,
       CASE WHEN p.p_partkey % 6 = 0 THEN concat('autumn-', CAST(p.p_partkey AS STRING))
            WHEN p.p_partkey % 6 = 1 THEN 'front-page'
            ELSE concat(replace(lower(p.p_name), ' ', '-'), '-', CAST(p.p_partkey AS STRING)) END AS slug,
       concat(p.p_name, ' v3') AS title, CAST(NULL AS STRING) AS description, CAST(NULL AS INT) AS price_cents,
       CAST(NULL AS BOOLEAN) AS is_active, CAST(NULL AS STRING) AS sku, split(CAST(NULL AS STRING), ',') AS tags,
       CAST(NULL AS STRING) AS cover_image_url, CAST(NULL AS STRING) AS digital_file_url
FROM part p WHERE p.p_partkey % 2 = 0 OR p.p_partkey % 6 = 1
""",
    "d_payments": """
SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS order_id,
       CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS caller_id,
       o_orderdate AS paid_at
FROM orders WHERE o_orderkey % 3 = 0
""",
    "d_order_lines": """
SELECT l_orderkey AS order_seq, l_linenumber AS line_no,
       CASE WHEN l_returnflag <> 'R' OR l_orderkey % 29 = 0 THEN l_partkey + CASE WHEN l_orderkey % 31 = 0 THEN 1000000 ELSE 0 END END AS product_id,
       CASE WHEN l_returnflag = 'R' AND l_orderkey % 23 <> 0 THEN l_suppkey END AS service_id,
       CAST(l_quantity AS INT) AS quantity
FROM lineitem
""",
    "d_order_requests": """
SELECT o_orderkey AS order_seq, o_custkey AS user_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'service' WHEN '2-HIGH' THEN 'coaching' ELSE 'digital' END AS type,
       o_orderdate AS requested_at
FROM orders
""",
    "d_product_inserts": """
SELECT p_partkey AS seq,
       CASE WHEN p_partkey % 9 = 0 THEN concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING))
            WHEN p_partkey % 9 = 1 THEN 'dup-slug'
            WHEN p_partkey % 9 = 2 THEN 'ab'
            ELSE concat('new-', CAST(p_partkey AS STRING)) END AS slug,
       concat(p_brand, ' edition') AS title,
       CASE WHEN p_partkey % 7 = 0 THEN 'too short' ELSE concat('A new edition of ', p_name) END AS description,
       CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE CAST(p_size * 100 AS INT) END AS price_cents,
       CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN true END AS is_active,
       CASE WHEN p_partkey % 4 = 0 THEN concat('SKU-N', CAST(p_partkey AS STRING)) END AS sku,
       CASE WHEN p_partkey % 3 = 0 THEN split(lower(p_brand), ',') END AS tags,
       CASE WHEN p_partkey % 13 = 0 THEN 'not a url' WHEN p_partkey % 13 = 1 THEN concat('https://img.example.com/', CAST(p_partkey AS STRING), '.png') END AS cover_image_url,
       CAST(NULL AS STRING) AS digital_file_url
FROM part
""",
    "d_request_events": """
SELECT e.event_id AS seq, e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS request_id,
       CASE e.event_type WHEN 'signup' THEN 'quote' WHEN 'view' THEN 'accept' WHEN 'click' THEN 'decline'
            WHEN 'purchase' THEN 'pay' ELSE 'deliver' END AS kind,
       e.user_id AS actor_id, e.ts AS ts
FROM events e
""",
    "d_slug_lookups": """
SELECT p_partkey AS seq,
       CASE WHEN p_partkey % 4 = 3 THEN concat('missing-', CAST(p_partkey AS STRING))
            ELSE concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS STRING)) END AS slug
FROM part
""",
    "d_service_slug_lookups": """
SELECT s_suppkey AS seq,
       CASE WHEN s_suppkey % 4 = 3 THEN concat('nope-', CAST(s_suppkey AS STRING))
            ELSE concat('service-', CAST(s_suppkey AS STRING)) END AS slug
FROM supplier
""",
    "d_viewers": """
SELECT c_custkey AS id,
       CASE c_custkey % 50 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'customer' END AS role,
       c_custkey % 3 = 0 AS mine,
       CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 150 END AS target_user_id
FROM customer
""",
    "d_quote_answers": """
SELECT e.event_id AS seq, e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS quote_id,
       CASE WHEN e.event_id % 3 = 0 THEN e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations) + 2 ELSE e.user_id END AS caller_id,
       CASE WHEN e.event_id % 2 = 0 THEN 'accept' ELSE 'decline' END AS action,
       e.ts AS ts
FROM events e
WHERE e.event_type = 'view'
""",
    "d_login_attempts": """
SELECT event_id AS seq,
       CASE WHEN event_id % 5 = 0 THEN concat('ghost', CAST(user_id AS STRING), '@example.com')
            ELSE concat('USER', CAST(user_id AS STRING), '@Example.COM') END AS email,
       ts
FROM events WHERE event_type = 'click'
""",
    "d_broadcasts": """
SELECT n_nationkey AS seq, concat('News for ', n_name) AS title, concat('An update about ', n_name) AS body,
       CASE n_nationkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'editor' WHEN 2 THEN 'admin' END AS role
FROM nation
""",
    "d_reads": """
SELECT event_id AS id, CASE WHEN event_id % 35 = 0 THEN user_id + 1 ELSE user_id END AS user_id
FROM events WHERE event_id % 5 = 0
""",
    "d_logins": """
SELECT event_id AS id, user_id, ts FROM events WHERE event_type IN ('signup', 'click')
""",
    "d_request_rows": """
SELECT e.event_id AS seq, e.user_id + 1 AS user_id, e.event_id % ((SELECT count(*) FROM supplier) + 5) AS service_id,
       CASE WHEN e.event_id % 9 = 0 THEN 'not json' ELSE concat('{"note":"n', CAST(e.event_id % 7 AS STRING), '"}') END AS brief,
       e.ts AS ts
FROM events e WHERE e.event_type = 'error'
""",
    "d_message_posts": """
SELECT c.conv_id * 100 + c.turn AS seq,
       CASE WHEN c.turn % 7 = 6 THEN c.conv_id + 1000 ELSE c.conv_id END AS request_id,
       CASE c.role WHEN 'user' THEN c.conv_id + 2 WHEN 'assistant' THEN 50 * (c.turn % 3 + 1) ELSE c.conv_id + 3 END AS sender_id,
       CASE WHEN c.turn % 11 = 10 THEN '' ELSE c.text END AS body,
       CASE WHEN c.turn % 5 = 4 THEN split('not-a-url', ',')
            WHEN c.turn % 5 = 3 THEN split(concat('https://files.example.com/a/', CAST(c.conv_id AS STRING)), ',') END AS attachments,
       e.ts AS ts
FROM conversations c JOIN events e ON e.event_id = c.conv_id * 8 + c.turn
""",
    "d_deliverable_posts": """
SELECT p.page_id AS seq, p.page_id % ((SELECT count(DISTINCT conv_id) FROM conversations) + 3) AS request_id,
       CASE WHEN p.page_id % 4 = 0 THEN p.page_id % 1500 + 2 ELSE 50 * (p.page_id % 3 + 1) END AS actor_id,
       CASE WHEN p.page_id % 11 = 0 THEN 'x' ELSE concat('Deliverable ', CAST(p.page_id AS STRING)) END AS title,
       CASE WHEN p.page_id % 2 = 0 THEN 'Final files' END AS description,
       CASE WHEN p.page_id % 13 = 0 THEN 'ftp:/bad' ELSE p.url END AS file_url,
       e.ts AS ts
FROM pages p JOIN events e ON e.event_id = p.page_id
""",
    "d_quote_posts": """
SELECT e.event_id AS seq, e.event_id % ((SELECT count(DISTINCT conv_id) FROM conversations) + 3) AS request_id,
       CASE WHEN e.event_id % 6 = 0 THEN e.user_id + 2 ELSE 50 * (e.event_id % 3 + 1) END AS actor_id,
       CASE WHEN e.event_id % 13 = 0 THEN -5 ELSE CAST(round(e.value * 100) AS INT) END AS amount_cents,
       CASE WHEN e.event_id % 2 = 0 THEN e.props END AS notes, e.ts AS ts
FROM events e WHERE e.event_type = 'purchase'
""",
    "d_status_posts": """
SELECT e.event_id AS seq, e.event_id % ((SELECT count(DISTINCT conv_id) FROM conversations) + 3) AS request_id,
       CASE WHEN e.event_id % 5 = 0 THEN e.user_id + 2 ELSE 100 END AS actor_id,
       CASE e.event_id % 9 WHEN 0 THEN 'open' WHEN 1 THEN 'needs_info' WHEN 2 THEN 'quoted' WHEN 3 THEN 'paid'
            WHEN 4 THEN 'in_progress' WHEN 5 THEN 'delivered' WHEN 6 THEN 'completed' WHEN 7 THEN 'declined'
            ELSE 'bogus' END AS status,
       e.ts AS ts
FROM events e WHERE e.event_type = 'error'
""",
    "d_user_patches": """
SELECT c_custkey + CASE WHEN c_custkey % 40 = 0 THEN 1000000 ELSE 0 END AS id,
       CASE WHEN c_custkey % 10 = 0 THEN 'Taken@Example.com'
            WHEN c_custkey % 10 = 1 THEN concat('user', CAST(c_custkey + 1 AS STRING), '@example.com')
            WHEN c_custkey % 10 = 2 THEN 'bad-email' END AS email,
       CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, ' Jr') END AS name,
       CASE WHEN c_custkey % 7 = 0 THEN 'editor' WHEN c_custkey % 7 = 1 THEN 'owner' END AS role,
       CAST(NULL AS STRING) AS password
FROM customer
""",
    "d_admin_users": """
SELECT c_custkey AS seq,
       CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email'
            ELSE concat('Staff', CAST((c_custkey * 3) % 500 AS STRING), '@Example.com') END AS email,
       CASE WHEN c_custkey % 13 = 0 THEN 'short' ELSE 'long-enough-1' END AS password,
       CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_name END AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' WHEN 2 THEN 'customer' ELSE 'owner' END AS role
FROM customer
""",
    "d_service_inserts": """
SELECT s_suppkey AS seq,
       CASE WHEN s_suppkey % 7 = 0 THEN concat('service-', CAST(s_suppkey AS STRING))
            WHEN s_suppkey % 7 = 1 THEN 'dup-service'
            WHEN s_suppkey % 7 = 2 THEN 'sv'
            ELSE concat('svc-new-', CAST(s_suppkey AS STRING)) END AS slug,
       concat(s_name, ' plus') AS title,
       CASE WHEN s_suppkey % 5 = 0 THEN 'short' ELSE concat('Extended offering by ', s_name) END AS description,
       CASE WHEN s_suppkey % 9 = 0 THEN -100 ELSE CAST(s_nationkey * 1000 AS INT) END AS base_price_cents,
       CASE WHEN s_suppkey % 3 = 0 THEN false END AS is_active,
       CASE WHEN s_suppkey % 2 = 0 THEN split(concat('nation-', CAST(s_nationkey AS STRING)), ',') END AS tags
FROM supplier
""",
    "d_service_patches": """
SELECT s_suppkey + CASE WHEN s_suppkey % 40 = 0 THEN 1000000 ELSE 0 END AS id,
       CASE WHEN s_suppkey % 20 = 0 THEN 'new-service-slug' WHEN s_suppkey % 30 = 10 THEN 'service-1' END AS slug,
       CASE WHEN s_suppkey % 4 = 0 THEN concat(s_name, ' v2') END AS title,
       CASE WHEN s_suppkey % 16 = 0 THEN -1 WHEN s_suppkey % 6 = 0 THEN 5000 END AS base_price_cents
FROM supplier WHERE s_suppkey % 2 = 0
""",
}

ALL_VIEWS: dict[str, str] = {**DOMAIN_VIEWS, **CHANGE_VIEWS}

_NAME = re.compile(r"\bd_[a-z_]+\b")


_RAW_REF = re.compile(r"\b(customer|part|supplier|orders|lineitem|events|conversations|nation|pages)\b")


class Domain:
    """Attribute access to the bound domain frames of one source folder.

    Views are bound lazily: touching ``d.orders`` registers only the source
    tables its text reads and analyses only that view, so a query pays for
    the views it uses. Frames are analysed plans, so re-registering a temp
    view later (another folder) does not change them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._frames: dict[str, DataFrame] = {}
        self.stored = False

    @property
    def raw(self) -> dict[str, DataFrame]:
        from mercato.sources.raw import RAW_SCHEMAS

        for name in RAW_SCHEMAS:
            self._source(name)
        return self._raw

    def source(self, name: str) -> DataFrame:
        """The typed scan of one source table."""
        return self._source(name)

    def _source(self, name: str) -> DataFrame:
        from mercato.sources.raw import read_raw

        if name not in self._raw:
            self._raw[name] = read_raw(self.spark, self.sf_dir, name)
        # (Re-)register: another Domain may have pointed the name elsewhere.
        self._raw[name].createOrReplaceTempView(name)
        return self._raw[name]

    def view(self, key: str) -> DataFrame:
        """The binding query itself (recomputed from the sources when run)."""
        sql = ALL_VIEWS[key]
        for t in sorted(set(_RAW_REF.findall(sql))):
            self._source(t)
        return self.spark.sql(sql)

    def frame(self, key: str) -> DataFrame:
        """The bound table: a lazy view over the source scans, so column
        pruning and filters reach them and building a query runs no job."""
        if key not in self._frames:
            self._frames[key] = self.view(key)
        return self._frames[key]

    def owned_order_items(self) -> DataFrame:
        """``d_order_items`` with the user of its order as ``owner_id``. The orders are joined to the bare lines, ahead of
        parts and suppliers, so that titles and ids are made where a line ends up and are not moved."""
        for t in ("lineitem", "orders", "part", "supplier"):
            self._source(t)
        fields, joins = ALL_VIEWS["d_order_items"].split("\nFROM lineitem l ")
        return self.spark.sql(f"{fields},\n       o.o_custkey AS owner_id\n"
                              f"FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey {joins}")

    def store(self) -> str:
        """Write every bound table once (a job of its own, never part of a
        query) and read from there. Returns the folder."""
        from mercato.session import scratch_path

        folder = scratch_path(self.spark, "domain")
        for key in ALL_VIEWS:
            self.view(key).write.parquet(f"{folder}/{key}")
        for key in ALL_VIEWS:
            self._frames[key] = self.spark.read.parquet(f"{folder}/{key}")
        self.stored = True
        return folder

    def __getattr__(self, item: str) -> DataFrame:
        key = item if item.startswith("d_") else f"d_{item}"
        if key in ALL_VIEWS:
            return self.frame(key)
        raise AttributeError(item)

    def tables(self) -> dict[str, DataFrame]:
        """The domain tables keyed by their reference names."""
        names = ["users", "products", "services", "service_requests", "orders", "order_items",
                 "messages", "quotes", "notifications", "deliverables", "audit_log"]
        return {n: self.frame(f"d_{n}") for n in names}


_STORED: dict[str, Domain] = {}


def bind(spark: SparkSession, sf_dir: str) -> Domain:
    """The binding of ``sf_dir``: the tables that ``store_domain`` wrote in
    this session, else lazy views over the files as they are now."""
    stored = _STORED.get(sf_dir.rstrip("/"))
    if stored is not None and stored.spark is spark and spark.sparkContext._jsc is not None:
        return stored
    return Domain(spark, sf_dir)


def store_domain(spark: SparkSession, sf_dir: str) -> str:
    """Write the bound tables of ``sf_dir`` and let later queries of this
    session read them, as a deployment reads its stored domain tables."""
    domain = Domain(spark, sf_dir)
    folder = domain.store()
    _STORED[sf_dir.rstrip("/")] = domain
    return folder


def with_binding(body: str, *extra_ctes: tuple[str, str], bound: bool = True) -> str:
    """Prefix ``body`` with its extra CTEs and, with ``bound``, the binding CTEs they reference."""
    text = body + " ".join(sql for _, sql in extra_ctes)
    needed = [n for n in ALL_VIEWS if n in set(_NAME.findall(text))]
    ctes = [f"{n} AS ({ALL_VIEWS[n].strip()})" for n in needed if bound]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in extra_ctes]
    if not ctes:
        return body.strip()
    text = body.strip()
    head = re.match(r"(?is)^with(\s+recursive)?\s+", text)
    if head:  # the body has its own WITH: merge both lists into one clause
        kw = "WITH RECURSIVE " if head.group(1) else "WITH "
        return kw + ",\n".join(ctes) + ",\n" + text[head.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + text
