"""Validation rules of the change tables (the request-body schemas).

Each rule set is an ordered list of (issue code, validity predicate). A row
is good when every predicate holds; a null predicate counts as a failure.
String lengths count code points (JS counts UTF-16 units: they differ only
for characters outside the BMP).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import ORDER_TYPES, QUOTE_ACTIONS, REQUEST_STATUSES, ROLES

# Fixed patterns (our own; the oracle uses the same text).
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
URL_RE = r"^https?://[^\s/$.?#][^\s]*$"
UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_email(c) -> Column:
    return _c(c).rlike(EMAIL_RE)


def is_url(c) -> Column:
    return _c(c).rlike(URL_RE)


def min_len(c, n: int) -> Column:
    return F.length(_c(c)) >= n


def len_between(c, lo: int, hi: int) -> Column:
    return F.length(_c(c)).between(lo, hi)


def optional(c, pred: Column) -> Column:
    return _c(c).isNull() | pred


def is_key(c) -> Column:
    """An entity key: a UUID string, or (fixture keys) a non-negative integer."""
    col = _c(c)
    return F.coalesce(col.cast("string").rlike(UUID_RE), F.lit(False)) | (col.try_cast("bigint") >= 0)


def non_negative_int(c) -> Column:
    return _c(c).isNotNull() & (_c(c) >= 0)


def json_object(c) -> Column:
    col = _c(c)
    return F.coalesce(F.schema_of_variant(F.try_parse_json(col)).startswith("OBJECT"), F.lit(False))


def all_urls(c) -> Column:
    return F.coalesce(F.forall(F.coalesce(_c(c), F.array().cast("array<string>")), lambda x: x.rlike(URL_RE)),
                      F.lit(False))


RULESETS: dict[str, list[tuple[str, Column]]] = {}


def _rules() -> dict[str, list[tuple[str, Column]]]:
    if RULESETS:
        return RULESETS
    RULESETS.update({
        "register": [("email", is_email("email")), ("password", min_len("password", 8)),
                     ("name", len_between("name", 2, 80))],
        "login": [("email", is_email("email")), ("password", min_len("password", 1))],
        "product": [("slug", min_len("slug", 3)), ("title", min_len("title", 3)),
                    ("description", min_len("description", 10)), ("price", non_negative_int("price_cents")),
                    ("cover_image_url", optional("cover_image_url", is_url("cover_image_url"))),
                    ("digital_file_url", optional("digital_file_url", is_url("digital_file_url")))],
        "service": [("slug", min_len("slug", 3)), ("title", min_len("title", 3)),
                    ("description", min_len("description", 10)), ("price", non_negative_int("base_price_cents"))],
        "order": [("type", F.col("type").isin(list(ORDER_TYPES))), ("items", F.size("items") >= 1),
                  ("quantity", F.forall("items", lambda x: x["quantity"] > 0)),
                  ("key", F.forall("items", lambda x: optional(x["product_id"], is_key(x["product_id"]))
                                   & optional(x["service_id"], is_key(x["service_id"]))))],
        "payment": [("key", is_key("order_id"))],
        "request": [("key", is_key("service_id")), ("brief", json_object("brief"))],
        "message": [("body", min_len("body", 1)), ("attachments", optional("attachments", all_urls("attachments")))],
        "quote": [("amount", non_negative_int("amount_cents"))],
        "deliverable": [("title", min_len("title", 2)), ("file_url", is_url("file_url"))],
        "status": [("status", F.col("status").isin(list(REQUEST_STATUSES)))],
        "read_ids": [("ids", (F.size("ids") >= 1) & F.forall("ids", is_key))],
        "broadcast": [("title", min_len("title", 3)), ("body", min_len("body", 3)),
                      ("role", optional("role", F.col("role").isin(list(ROLES))))],
        "user_create": [("email", is_email("email")), ("password", min_len("password", 8)),
                        ("name", min_len("name", 2)), ("role", F.col("role").isin(list(ROLES)))],
        "user_update": [("email", optional("email", is_email("email"))),
                        ("password", optional("password", min_len("password", 8))),
                        ("name", optional("name", min_len("name", 2))),
                        ("role", optional("role", F.col("role").isin(list(ROLES))))],
        "quote_answer": [("action", F.col("action").isin(list(QUOTE_ACTIONS)))],
    })
    return RULESETS


def issues(ruleset: str | list[tuple[str, Column]]) -> Column:
    """array<string> of failing rule codes, in rule order (empty when valid)."""
    rules = _rules()[ruleset] if isinstance(ruleset, str) else ruleset
    arr = F.array(*[F.when(~F.coalesce(pred, F.lit(False)), F.lit(code)) for code, pred in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def validate_rows(df: DataFrame, ruleset) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``issues``): every issue is reported, not the first."""
    checked = df.withColumn("issues", issues(ruleset))
    good = checked.where(F.size("issues") == 0).drop("issues")
    bad = checked.where(F.size("issues") > 0)
    return good, bad
