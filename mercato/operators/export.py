"""What is held on users as rows of bounded size: one for each thing, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Section -> (table, the column that leads to the user or, below, to the table of the next line, time, payload fields).
SECTIONS = {
    "profile": ("users", "id", "created_at", ["email", "name", "role"]),
    "order": ("orders", "user_id", "created_at", ["status", "type", "total_cents", "service_request_id"]),
    "request": ("service_requests", "user_id", "created_at", ["service_id", "status", "brief", "updated_at"]),
    "message": ("messages", "sender_user_id", "created_at", ["service_request_id", "body", "attachments"]),
    "notification": ("notifications", "user_id", "created_at", ["type", "title", "body", "meta", "read_at"]),
    "audit": ("audit_log", "actor_user_id", "created_at", ["action", "entity", "entity_id", "meta"]),
    "order_item": ("order_items", "order_id", None,
                   ["order_id", "product_id", "service_id", "title", "unit_price_cents", "quantity", "subtotal_cents"]),
    "quote": ("quotes", "service_request_id", "created_at", ["service_request_id", "amount_cents", "notes", "status"]),
    "deliverable": ("deliverables", "service_request_id", "created_at",
                    ["service_request_id", "title", "description", "file_url"]),
}
#: Sections that reach their user through another table.
THROUGH = {"order_item": "orders", "quote": "service_requests", "deliverable": "service_requests"}


def _text(field: T.StructField) -> Column:
    c = F.col(field.name)
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name) if isinstance(field.dataType, T.TimestampNTZType) else c


def export_rows(t: dict[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """(user_id, section, at, row_id, payload) of the given users, or of all where ``ids`` is None.

    ``payload`` is the row's other fields as JSON, nulls kept. A user's history is as
    many rows as there are things in it, so no row, group or task grows with it; rows
    without a user (an audit row of a deleted one) are no one's and left out. A table of
    ``THROUGH`` that already holds its user as ``owner_id`` is not joined again.
    """
    want = None if ids is None else ids.select(F.col("id").alias("user_id")).distinct()
    parts = []
    for section, (table, key, at, fields) in SECTIONS.items():
        df, user = t[table], key
        if section in THROUGH:  # before the payload is made, so that it is not moved
            user = "owner_id"
            if user not in df.columns:
                owner = t[THROUGH[section]].select(F.col("id").alias("_id"), F.col("user_id").alias(user))
                df = df.join(owner, df[key] == owner["_id"])
        types = {f.name: f for f in df.schema}
        rows = df.select(
            F.col(user).alias("user_id"), F.lit(section).alias("section"),
            (F.col(at) if at else F.lit(None)).cast("timestamp_ntz").alias("at"), F.col("id").cast("string").alias("row_id"),
            F.to_json(F.struct(*[_text(types[f]) for f in fields]), {"ignoreNullFields": "false"}).alias("payload"))
        rows = rows.where(F.col("user_id").isNotNull())
        parts.append(rows if want is None else rows.join(want, "user_id", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def write_export(rows: DataFrame, path: str) -> None:
    """Files in the order of user, section, time and id; a user's rows lie together, over several files if they are many."""
    order = ["user_id", "section", "at", "row_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
