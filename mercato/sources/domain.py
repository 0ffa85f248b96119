"""Declared schemas of the 12 domain tables and their typed scans.

Keys of the fixture tables are ``long``; keys minted by our bulk jobs are
sha256 hex strings (see ``functions.columns.new_id``), so on append the id
column is widened to string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _S, _B, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
_ARR = T.ArrayType(T.StringType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DOMAIN_SCHEMAS: dict[str, T.StructType] = {
    "users": _st(("id", _L), ("email", _S), ("password_hash", _S), ("name", _S), ("role", _S), ("created_at", _TS)),
    "products": _st(("id", _L), ("slug", _S), ("title", _S), ("description", _S), ("price_cents", _I),
                    ("is_active", _B), ("sku", _S), ("tags", _ARR), ("cover_image_url", _S),
                    ("digital_file_url", _S), ("created_at", _TS), ("updated_at", _TS)),
    "services": _st(("id", _L), ("slug", _S), ("title", _S), ("description", _S), ("base_price_cents", _I),
                    ("is_active", _B), ("tags", _ARR), ("created_at", _TS), ("updated_at", _TS)),
    "service_requests": _st(("id", _L), ("user_id", _L), ("service_id", _L), ("status", _S), ("brief", _S),
                            ("created_at", _TS), ("updated_at", _TS)),
    "orders": _st(("id", _L), ("user_id", _L), ("status", _S), ("total_cents", _I), ("type", _S),
                  ("created_at", _TS), ("service_request_id", _L)),
    "order_items": _st(("id", _S), ("order_id", _L), ("product_id", _L), ("service_id", _L), ("title", _S),
                       ("unit_price_cents", _I), ("quantity", _I), ("subtotal_cents", _I)),
    "messages": _st(("id", _L), ("service_request_id", _L), ("sender_user_id", _L), ("body", _S),
                    ("attachments", _ARR), ("created_at", _TS)),
    "quotes": _st(("id", _L), ("service_request_id", _L), ("amount_cents", _I), ("notes", _S), ("status", _S),
                  ("created_at", _TS)),
    "notifications": _st(("id", _L), ("user_id", _L), ("type", _S), ("title", _S), ("body", _S), ("meta", _S),
                         ("read_at", _TS), ("created_at", _TS)),
    "deliverables": _st(("id", _L), ("service_request_id", _L), ("title", _S), ("description", _S),
                        ("file_url", _S), ("created_at", _TS)),
    "coaching_slots": _st(("id", _L), ("starts_at", _TS), ("ends_at", _TS), ("capacity", _I), ("is_active", _B)),
    "audit_log": _st(("id", _L), ("actor_user_id", _L), ("action", _S), ("entity", _S), ("entity_id", _L),
                     ("meta", _S), ("created_at", _TS)),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the declared schema: declared order, declared
    types, absent columns as typed nulls."""
    schema = DOMAIN_SCHEMAS[table]
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed scan of stored domain tables ``{folder}/{table}`` (parquet)."""
    return {name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
            for name, schema in DOMAIN_SCHEMAS.items()}


def load_tables_from_binding(domain) -> dict[str, DataFrame]:
    """The 12 domain tables from the bound fixture views (coaching_slots is empty)."""
    spark = domain.spark
    out = {}
    for name, schema in DOMAIN_SCHEMAS.items():
        if name == "coaching_slots":
            out[name] = spark.createDataFrame([], schema)
        else:
            out[name] = conform(getattr(domain, name), name)
    return out
