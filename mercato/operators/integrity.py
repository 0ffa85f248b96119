"""Whole-data checks: the declared constraints as one report, and the
per-user data export.

``integrity_report`` gives one row per rule with its violation count:
primary keys, NOT NULL columns, CHECKs, enums, unique columns and references
of all 12 tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import (ORDER_STATUSES, ORDER_TYPES, QUOTE_STATUSES, REQUEST_STATUSES, ROLES)
from mercato.operators.orders import order_item_array


#: The declared constraints. Columns, enum values and bounds are the data model's.
NOT_NULL: dict[str, list[str]] = {
    "users": ["email", "password_hash", "name", "role", "created_at"],
    "products": ["slug", "title", "description", "price_cents", "is_active", "tags", "created_at", "updated_at"],
    "services": ["slug", "title", "description", "base_price_cents", "is_active", "tags", "created_at", "updated_at"],
    "service_requests": ["user_id", "service_id", "status", "brief", "created_at", "updated_at"],
    "orders": ["user_id", "status", "total_cents", "type", "created_at"],
    "order_items": ["order_id", "title", "unit_price_cents", "quantity", "subtotal_cents"],
    "messages": ["service_request_id", "sender_user_id", "body", "attachments", "created_at"],
    "quotes": ["service_request_id", "amount_cents", "status", "created_at"],
    "notifications": ["user_id", "type", "title", "body", "meta", "created_at"],
    "deliverables": ["service_request_id", "title", "file_url", "created_at"],
    "coaching_slots": ["starts_at", "ends_at", "capacity", "is_active"],
    "audit_log": ["action", "entity", "meta", "created_at"],
}
ENUMS = {("users", "role"): ROLES, ("service_requests", "status"): REQUEST_STATUSES, ("orders", "status"): ORDER_STATUSES,
         ("orders", "type"): ORDER_TYPES, ("quotes", "status"): QUOTE_STATUSES}
AT_LEAST = {("products", "price_cents"): 0, ("services", "base_price_cents"): 0, ("orders", "total_cents"): 0,
            ("order_items", "unit_price_cents"): 0, ("order_items", "quantity"): 1, ("order_items", "subtotal_cents"): 0,
            ("quotes", "amount_cents"): 0, ("coaching_slots", "capacity"): 1}
UNIQUE = [("users", "email"), ("products", "slug"), ("services", "slug"), ("quotes", "service_request_id"),
          *((t, "id") for t in NOT_NULL)]
REFERENCES = {("service_requests", "user_id"): "users", ("service_requests", "service_id"): "services",
              ("orders", "user_id"): "users", ("orders", "service_request_id"): "service_requests",
              ("order_items", "order_id"): "orders", ("order_items", "product_id"): "products",
              ("order_items", "service_id"): "services", ("messages", "service_request_id"): "service_requests",
              ("messages", "sender_user_id"): "users", ("quotes", "service_request_id"): "service_requests",
              ("notifications", "user_id"): "users", ("deliverables", "service_request_id"): "service_requests",
              ("audit_log", "actor_user_id"): "users"}


def _row_rules(table: str) -> list[tuple[str, str]]:
    """(rule, SQL that says whether a row breaks it); like the declared checks, a null breaks only the not-null rule."""
    rules = [(f"{table}.{c} not null", f"`{c}` IS NULL") for c in ["id", *NOT_NULL[table]]]
    rules += [(f"{t}.{c} enum", f"`{c}` NOT IN ({', '.join(repr(x) for x in v)})") for (t, c), v in ENUMS.items() if t == table]
    return rules + [(f"{t}.{c} >= {n}", f"`{c}` < {n}") for (t, c), n in AT_LEAST.items() if t == table]


def integrity_report(t: dict[str, DataFrame]) -> DataFrame:
    """One row per declared rule with its number of violations, from one scan
    of each table and one shuffle of keys.

    A row turns into one entry for each key it holds and one for each row rule
    it breaks (most break none). An entry is (space, key, slot): a space is the
    ids of one table, or one other unique column, and its slots are the columns
    that hold such keys, slot 0 being the id itself. Entries are counted by
    (space, key) with one count per slot, map-side first, so no key gathers its
    rows; a group alone tells both whether its key repeats and whether a
    reference is without its parent, so nothing is joined. Integer keys stay
    integers; only a space with a column of another type compares text."""
    spaces, rules = _spaces(t)
    width = max(len(columns) for columns in spaces)
    types = {name: dict(df.dtypes) for name, df in t.items()}
    whole = [all(types[x][c] in ("bigint", "int", "smallint", "tinyint") for x, c in columns) for columns in spaces]
    entries = _union([_entries(df, name, spaces, whole, rules) for name, df in t.items()])
    counts = entries.groupBy("space", "key", "text").agg(
        *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(width)])
    n = [F.col(f"n{i}") for i in range(width)]
    sums = counts.groupBy("space").agg(
        F.array(*[F.sum(F.greatest(x - 1, F.lit(0))) for x in n]).alias("repeated"),
        F.array(*[F.sum(F.when(n[0] == 0, x).otherwise(0)) for x in n]).alias("lost"),
        F.sum(n[0]).alias("broken"))
    # one row per declared rule: which sum, of which space and slot, is its number
    declared = ", ".join(f"named_struct('rule', '{rule}', 's', {s}, 'kind', '{kind}', 'slot', {slot})"
                         for rule, (s, kind, slot) in rules.items())
    listed = t["users"].sparkSession.range(1).selectExpr(f"inline(array({declared}))")
    number = (F.when(F.col("kind") == "broken", F.col("broken"))
              .when(F.col("kind") == "lost", F.get("lost", "slot")).otherwise(F.get("repeated", "slot")))
    return listed.join(sums, listed["s"] == sums["space"], "left").select(
        "rule", F.coalesce(number, F.lit(0)).cast("bigint").alias("violations"))


def _spaces(t: dict[str, DataFrame]) -> tuple[list[list[tuple[str, str]]], dict[str, tuple[int, str, int]]]:
    """(the columns of each key space, id first; rule -> (space, kind of sum, slot)). Row rules get the spaces after them."""
    parents = list(dict.fromkeys(REFERENCES.values()))
    spaces = [[(p, "id"), *(at for at, q in REFERENCES.items() if q == p)] for p in parents]
    rules = {}
    for table, column in UNIQUE:
        at = next((i for i, columns in enumerate(spaces) if (table, column) in columns), None)
        if at is None:
            at = len(spaces)
            spaces.append([(table, column)])
        rules[f"{table}.{column} unique"] = (at, "repeated", spaces[at].index((table, column)))
    for (table, column), parent in REFERENCES.items():
        at = parents.index(parent)
        rules[f"{table}.{column} -> {parent}"] = (at, "lost", spaces[at].index((table, column)))
    for table in t:
        for rule, _ in _row_rules(table):
            rules[rule] = (len(rules) + len(spaces), "broken", 0)
    return spaces, rules


def _entries(df: DataFrame, table: str, spaces: list, whole: list[bool], rules: dict) -> DataFrame:
    """(space, key, text, slot) of every key of a row and every row rule it breaks; null keys have none. One scan."""
    def entry(space: int, slot: int, key: str = "NULL", text: str = "NULL") -> str:
        return (f"named_struct('space', {space}, 'key', CAST({key} AS BIGINT), 'text', CAST({text} AS STRING), 'slot', {slot})")

    held = [entry(at, slot, **{"key" if whole[at] else "text": f"`{c}`"})
            for at, columns in enumerate(spaces) for slot, (x, c) in enumerate(columns) if x == table]
    checks = [(bad, entry(rules[rule][0], 0, "0")) for rule, bad in _row_rules(table)]
    broken = (f"if({' OR '.join(bad for bad, _ in checks)}, "
              f"filter(array({', '.join(f'if({bad}, {e}, NULL)' for bad, e in checks)}), e -> e IS NOT NULL), "
              "CAST(array() AS ARRAY<STRUCT<space: INT, key: BIGINT, text: STRING, slot: INT>>))")
    return (df.selectExpr(f"inline(concat(array({', '.join(held)}), {broken}))")
            .where("key IS NOT NULL OR text IS NOT NULL"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def export_user(t: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Everything held on the given users (all users when ``ids`` is None),
    one nested document each: profile, orders (with items), requests, sent
    messages, notifications, audit rows. Each child table is aggregated by
    user *before* the joins, so children never multiply each other."""
    want = None if ids is None else ids.select(F.col("id").alias("user_id")).distinct()
    users = t["users"] if want is None else t["users"].join(want, t["users"]["id"] == want["user_id"], "left_semi")

    def per_user(df: DataFrame, key: str, name: str, cols: list[str]) -> DataFrame:
        kept = df if want is None else df.join(want, df[key] == want["user_id"], "left_semi")
        return kept.groupBy(F.col(key).alias(f"_{name}")).agg(
            F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    items = order_item_array(t["order_items"])
    orders = t["orders"].join(items, t["orders"]["id"] == items["order_id"], "left") \
        .withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    parts = [
        per_user(orders, "user_id", "orders", ["created_at", "id", "status", "type", "total_cents", "items"]),
        per_user(t["service_requests"], "user_id", "requests", ["created_at", "id", "service_id", "status", "brief"]),
        per_user(t["messages"], "sender_user_id", "messages", ["created_at", "id", "service_request_id", "body"]),
        per_user(t["notifications"], "user_id", "notifications", ["created_at", "id", "type", "title", "read_at"]),
        per_user(t["audit_log"], "actor_user_id", "audit", ["created_at", "id", "action"]),
    ]
    doc = users.select(F.col("id").alias("user_id"),
                       F.struct("id", "email", "name", "role", "created_at").alias("profile"))
    for p in parts:
        name = [c for c in p.columns if not c.startswith("_")][0]
        doc = doc.join(p, doc["user_id"] == p[f"_{name}"], "left").drop(f"_{name}")
        doc = doc.withColumn(name, F.coalesce(name, F.array().cast(p.schema[name].dataType)))
    return doc
