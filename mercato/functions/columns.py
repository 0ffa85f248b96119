"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain (must equal the reference's enums and weights).
ROLES = ("customer", "editor", "admin")
ROLE_WEIGHTS = {"customer": 1, "editor": 2, "admin": 3}
STAFF_ROLES = ("admin", "editor")
REQUEST_STATUSES = ("open", "needs_info", "quoted", "paid", "in_progress", "delivered", "completed", "declined")
OPEN_REQUEST_STATUSES = ("open", "needs_info", "quoted", "in_progress")
ORDER_STATUSES = ("pending", "paid", "canceled", "refunded")
ORDER_TYPES = ("digital", "service", "coaching")
QUOTE_STATUSES = ("draft", "sent", "accepted", "paid", "declined")
QUOTE_ACTIONS = ("accept", "decline")
INT_MAX = 2147483647


def role_weight(role: Column | str) -> Column:
    """customer 1 < editor 2 < admin 3; unknown roles weigh null."""
    pairs = []
    for k, v in ROLE_WEIGHTS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), F.col(role) if isinstance(role, str) else role)


def role_at_least(role: Column | str, minimum: str) -> Column:
    return F.coalesce(role_weight(role) >= F.lit(ROLE_WEIGHTS[minimum]), F.lit(False))


def role_in(role: Column | str, roles) -> Column:
    c = F.col(role) if isinstance(role, str) else role
    return F.coalesce(c.isin(list(roles)), F.lit(False))


def is_staff(role: Column | str) -> Column:
    return role_in(role, STAFF_ROLES)


def new_id(kind: str, *parts: Column | str) -> Column:
    """Deterministic replacement for a random UUID: sha256 of the natural key,
    so re-running a job yields the same ids."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("~", F.lit(kind), *cols), 256)


def format_price(cents: Column | str) -> Column:
    """cents -> ``$d.dd`` (two decimals, like toFixed(2))."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return F.concat(F.lit("$"), (c.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").cast("string"))


def uri_component(s: Column | str) -> Column:
    """encodeURIComponent: url_encode plus undoing its differences
    (space is ``%20`` not ``+``; ``! ' ( ) * ~`` stay literal)."""
    c = F.col(s) if isinstance(s, str) else s
    out = F.url_encode(c)
    for enc, lit in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"),
                     ("%2A", "*"), ("%7E", "~")):
        out = F.regexp_replace(out, enc, lit)
    return out


def render_tags(tags: Column | str) -> Column:
    """Tag list markup; a null list renders as nothing."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")),
                                    lambda t: F.concat(F.lit('<span class="tag">'), t, F.lit("</span>"))), "")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    """snake_case -> camelCase output names (``price_cents`` -> ``priceCents``)."""
    return df.withColumnsRenamed({c: camel(c) for c in df.columns if "_" in c})


def newest_first(created: str = "created_at", key: str = "id") -> list[Column]:
    """ORDER BY created DESC as the database does (nulls first), ties broken by id."""
    return [F.col(created).desc_nulls_first(), F.col(key).desc()]


def oldest_first(created: str = "created_at", key: str = "id") -> list[Column]:
    return [F.col(created).asc_nulls_last(), F.col(key).asc()]




def wall_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, independent of
    the session time zone (``unix_micros`` of a cast would shift across DST)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))


def ntz(value) -> Column:
    """A wall-clock ``timestamp_ntz`` literal from a Python datetime (or a
    Column cast to it). Building it from text keeps it exact in any session
    time zone; ``lit(datetime)`` would go through the process's zone."""
    import datetime as _dt

    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")
