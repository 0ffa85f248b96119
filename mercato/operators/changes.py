"""Bulk write rules: each job reads a change table, applies the reference's
checks in its order, and returns new frames (never writes in place).

Rows of one batch are applied in their order column; checks read the
state before the batch, except where the batch itself decides (first
claim of an email or slug wins). Outcome codes mirror the HTTP answers:
unauthorized 401, forbidden 403, invalid 400, not_found 404, conflict 409.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import STAFF_ROLES, is_staff, new_id, ntz
from mercato.functions.rules import issues, optional, _rules
from mercato.sources.domain import DOMAIN_SCHEMAS


def _now(now, df: DataFrame, col: str = "created_at") -> Column:
    return ntz(now)


def _callers(users: DataFrame, alias: str = "_caller") -> DataFrame:
    return users.select(F.col("id").alias(alias), F.col("role").alias("caller_role"))


def first_claim(df: DataFrame, key: str, order: str, eligible: Column) -> DataFrame:
    """Mark, per value of ``key`` among ``eligible`` rows, the row with the
    smallest ``order`` (``_claim_order`` = that order). A min aggregate, then
    a join back on the key: no window over a possibly hot key."""
    winners = (df.where(eligible).groupBy(F.col(key).alias("_ck"))
               .agg(F.min(order).alias("_claim_order")))
    return df.join(winners, df[key] == winners["_ck"], "left").drop("_ck")


# ------------------------------------------------------------------ users

def register_users(registrations: DataFrame, users: DataFrame, now, admin: bool = False):
    """registrations(seq, email, password, name[, role]) -> (inserts, outcomes).

    Emails are lower-cased; an email already present, or claimed by an
    earlier row of the batch, is a conflict. Self-registration always gets
    role ``customer``; the admin variant keeps the given role. Password
    hashing is left to the auth system (``password_hash`` stays null)."""
    ruleset = "user_create" if admin else "register"
    r = (registrations.withColumn("issues", issues(ruleset))
         .withColumn("normalized_email", F.lower("email")))
    existing = users.select(F.lower("email").alias("_e")).distinct()
    r = r.join(existing, r["normalized_email"] == existing["_e"], "left")
    valid = F.size("issues") == 0
    r = first_claim(r, "normalized_email", "seq", valid & F.col("_e").isNull())
    outcome = (F.when(~valid, "invalid")
               .when(F.col("_e").isNotNull() | (F.col("seq") != F.col("_claim_order")), "conflict")
               .otherwise("created"))
    out = r.withColumn("outcome", outcome).withColumn(
        "user_id", F.when(F.col("outcome") == "created", new_id("user", "normalized_email")))
    outcomes = out.select("seq", F.col("normalized_email").alias("email"), "outcome", "issues", "user_id")
    role = F.col("role") if admin else F.lit("customer")
    inserts = out.where(F.col("outcome") == "created").select(
        F.col("user_id").alias("id"), F.col("normalized_email").alias("email"),
        F.lit(None).cast("string").alias("password_hash"), "name", role.alias("role"),
        _now(now, out).alias("created_at"))
    return inserts, outcomes


# ---------------------------------------------------------------- catalogue

def insert_catalog(rows: DataFrame, table: DataFrame, kind: str, now):
    """Product/service inserts with the slug-unique check and column
    defaults (``is_active`` true, ``tags`` empty, timestamps = now).
    rows(seq, slug, ...). Returns (inserts, outcomes)."""
    ruleset = "product" if kind == "product" else "service"
    r = rows.withColumn("issues", issues(ruleset))
    taken = table.select(F.col("slug").alias("_taken")).distinct()
    r = r.join(taken, r["slug"] == taken["_taken"], "left")
    valid = F.size("issues") == 0
    r = first_claim(r, "slug", "seq", valid & F.col("_taken").isNull())
    outcome = (F.when(~valid, "invalid")
               .when(F.col("_taken").isNotNull() | (F.col("seq") != F.col("_claim_order")), "conflict")
               .otherwise("created"))
    r = r.withColumn("outcome", outcome).withColumn(
        "new_id", F.when(F.col("outcome") == "created", new_id(kind, "slug")))
    outcomes = r.select("seq", "slug", "outcome", "issues", "new_id")
    created = r.where(F.col("outcome") == "created")
    inserts = append_with_defaults(created.withColumnRenamed("new_id", "id"), kind, now)
    return inserts, outcomes


#: Kind -> its table and the columns with a default beside created_at (now). The data model's.
DEFAULTS = {"user": ("users", {"role": "customer"}), "order": ("orders", {"status": "pending"}), "order_item": ("order_items", {}),
            "notification": ("notifications", {"meta": "{}"}), "deliverable": ("deliverables", {}),
            "audit": ("audit_log", {"meta": "{}"}), "coaching_slot": ("coaching_slots", {"is_active": True})}


def append_with_defaults(rows: DataFrame, kind: str, now) -> DataFrame:
    """Insert-time defaults: COALESCE(is_active, TRUE), COALESCE(tags, '{}'),
    status defaults, created_at/updated_at = now, minted id when absent."""
    ts = _now(now, rows)
    cols = set(rows.columns)
    get = lambda c, t: F.col(c) if c in cols else F.lit(None).cast(t)
    own = get("id", "string")
    if kind in ("product", "service") and dict(rows.dtypes).get("id", "string") == "string":
        own = F.coalesce(own, new_id(kind, "slug"))  # the slug is unique, so it names the row
    empty_tags = F.array().cast("array<string>")
    if kind == "product":
        return rows.select(
            own.alias("id"), "slug", "title", "description", "price_cents",
            F.coalesce(get("is_active", "boolean"), F.lit(True)).alias("is_active"), get("sku", "string").alias("sku"),
            F.coalesce(get("tags", "array<string>"), empty_tags).alias("tags"),
            get("cover_image_url", "string").alias("cover_image_url"),
            get("digital_file_url", "string").alias("digital_file_url"),
            ts.alias("created_at"), ts.alias("updated_at"))
    if kind == "service":
        return rows.select(
            own.alias("id"), "slug", "title", "description", "base_price_cents",
            F.coalesce(get("is_active", "boolean"), F.lit(True)).alias("is_active"),
            F.coalesce(get("tags", "array<string>"), empty_tags).alias("tags"),
            ts.alias("created_at"), ts.alias("updated_at"))
    if kind == "service_request":
        return rows.select("id", "user_id", "service_id", F.coalesce(get("status", "string"), F.lit("open")).alias("status"),
                           "brief", F.coalesce(get("created_at", "timestamp_ntz"), ts).alias("created_at"),
                           F.coalesce(get("created_at", "timestamp_ntz"), ts).alias("updated_at"))
    if kind == "message":
        return rows.select("id", "service_request_id", "sender_user_id", "body",
                           F.coalesce(get("attachments", "array<string>"), empty_tags).alias("attachments"),
                           F.coalesce(get("created_at", "timestamp_ntz"), ts).alias("created_at"))
    if kind == "quote":
        return rows.select("id", "service_request_id", "amount_cents", get("notes", "string").alias("notes"),
                           F.coalesce(get("status", "string"), F.lit("draft")).alias("status"),
                           F.coalesce(get("created_at", "timestamp_ntz"), ts).alias("created_at"))
    if kind in DEFAULTS:
        table, given = DEFAULTS[kind]
        out = []
        for f in DOMAIN_SCHEMAS[table].fields:
            kind_of = dict(rows.dtypes).get(f.name, "string") if f.name == "id" else f.dataType  # minted ids are text
            default = ts if f.name == "created_at" else F.lit(given[f.name]) if f.name in given else None
            value = get(f.name, "string").cast(kind_of)
            out.append((value if default is None else F.coalesce(value, default.cast(kind_of))).alias(f.name))
        return rows.select(out)
    raise ValueError(f"unknown kind {kind!r}")


def merge_given(table: DataFrame, updates: DataFrame, fields: list[str], order_col: str, touch: str | None, now) -> DataFrame:
    """``table`` with the given (non-null) fields of ``updates`` by id, the last by ``order_col`` of each field."""
    merged = updates.groupBy(F.col("id").alias("_pid")).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order_col))).alias(f"_p_{f}") for f in fields])
    j = table.join(merged, table["id"] == merged["_pid"], "left")
    cols = []
    for c in table.columns:
        if c in fields:
            cols.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
        elif touch and c == touch:
            cols.append(F.when(F.col("_pid").isNotNull(), _now(now, table)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def apply_patches(table: DataFrame, patches: DataFrame, fields: list[str], unique_col: str | None, now,
                  rules: list[tuple[str, Column]] | None = None, order_col: str = "id",
                  touch: str | None = "updated_at", normalize: dict[str, Column] | None = None, also: tuple[str, ...] = ()):
    """Partial update by id: only given (non-null) fields are set.

    Outcomes in the reference's order: invalid > conflict (the unique
    value is held by *another* row, or claimed earlier in the batch) >
    no_updates > not_found > updated. A null means "not given", so a patch
    cannot clear a nullable field but can set ``tags`` to ``[]``. Several
    patches of one id apply in ``order_col`` order (last given value wins);
    name a column that orders them wherever ids repeat. ``also`` names columns
    of the patch that count as given though the table does not hold them (a
    password).
    Returns (new table, outcomes)."""
    p = patches
    for c, expr in (normalize or {}).items():
        p = p.withColumn(c, expr)
    rule_list = [(code, optional(code_col, pred)) for code, code_col, pred in (rules or [])
                 if code_col in p.columns]
    p = p.withColumn("issues", issues(rule_list) if rule_list else F.array().cast("array<string>"))
    p = p.withColumn("_n_given", sum(F.col(f).isNotNull().cast("int") for f in [*fields, *also]))
    ids = table.select(F.col("id").alias("_found"))
    p = p.join(ids, p["id"] == ids["_found"], "left")
    valid = F.size("issues") == 0
    if unique_col:
        holders = table.select(F.col(unique_col).alias("_u"), F.col("id").alias("_holder"))
        p = p.join(holders, p[unique_col] == holders["_u"], "left").drop("_u")
        clash_existing = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("id"))
        eligible = valid & F.col(unique_col).isNotNull() & ~clash_existing & F.col("_found").isNotNull()
        p = first_claim(p, unique_col, order_col, eligible)
        conflict = F.col(unique_col).isNotNull() & (
            clash_existing | (F.col("_claim_order").isNotNull() & (F.col(order_col) > F.col("_claim_order"))))
    else:
        conflict = F.lit(False)
    outcome = (F.when(~valid, "invalid").when(conflict, "conflict").when(F.col("_n_given") == 0, "no_updates")
               .when(F.col("_found").isNull(), "not_found").otherwise("updated"))
    p = p.withColumn("outcome", outcome)
    outcomes = p.select("id", "outcome", "issues")
    return merge_given(table, p.where(F.col("outcome") == "updated"), fields, order_col, touch, now), outcomes


def patch_rules(kind: str) -> list[tuple[str, str, Column]]:
    """Rules of a partial (all-optional) product/service/user update."""
    src = {"product": "product", "service": "service", "user": "user_update"}[kind]
    col_of = {"slug": "slug", "title": "title", "description": "description", "price": (
        "price_cents" if kind == "product" else "base_price_cents"),
        "cover_image_url": "cover_image_url", "digital_file_url": "digital_file_url",
        "email": "email", "password": "password", "name": "name", "role": "role"}
    return [(code, col_of[code], pred) for code, pred in _rules()[src]]


# ------------------------------------------------------------- requests

def _guarded(rows: DataFrame, users: DataFrame, requests: DataFrame | None, actor: str, ruleset: str | None,
             staff_only: bool = False, customers_only: bool = False, owner_or_staff: bool = False,
             request_key: str = "request_id") -> DataFrame:
    """Common guard chain: unauthorized > forbidden (role) > invalid >
    not_found (request) > forbidden (ownership) > ok."""
    c = _callers(users)
    r = rows.join(c, rows[actor] == c["_caller"], "left")
    if ruleset:
        r = r.withColumn("issues", issues(ruleset))
    else:
        r = r.withColumn("issues", F.array().cast("array<string>"))
    if requests is not None:
        q = requests.select(F.col("id").alias("_req"), F.col("user_id").alias("owner_id"))
        r = r.join(q, r[request_key] == q["_req"], "left")
    chain = F.when(F.col("_caller").isNull(), "unauthorized")
    if staff_only:
        chain = chain.when(~is_staff("caller_role"), "forbidden")
    if customers_only:
        chain = chain.when(F.col("caller_role").isin(list(STAFF_ROLES)), "forbidden")
    chain = chain.when(F.size("issues") > 0, "invalid")
    if requests is not None:
        chain = chain.when(F.col("_req").isNull(), "not_found")
    if owner_or_staff:
        chain = chain.when((F.col("owner_id") != F.col(actor)) & ~is_staff("caller_role"), "forbidden")
    return r.withColumn("outcome", chain.otherwise("ok")).drop("_caller")


def create_requests(rows: DataFrame, users: DataFrame, services: DataFrame, batch: str | None = None):
    """rows(seq, user_id, service_id, brief, ts) -> (new requests, outcomes).
    Only customers may ask; the service must exist and be active. Ids are made
    from ``batch`` and seq: give a batch wherever seq starts again."""
    g = _guarded(rows, users, None, "user_id", "request", customers_only=True)
    s = services.where(F.col("is_active")).select(F.col("id").alias("_svc"))
    g = g.join(s, g["service_id"] == s["_svc"], "left")
    outcome = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("_svc").isNull(), "not_found") \
        .otherwise("created")
    g = g.withColumn("outcome", outcome).withColumn(
        "request_id", F.when(F.col("outcome") == "created", new_id("request", *([] if batch is None else [F.lit(batch)]), "seq")))
    created = g.where(F.col("outcome") == "created").select(
        F.col("request_id").alias("id"), "user_id", "service_id", F.lit("open").alias("status"), "brief",
        F.col("ts").alias("created_at"))
    return append_with_defaults(created, "service_request", None), g.select("seq", "outcome", "request_id")


def post_messages(rows: DataFrame, requests: DataFrame, users: DataFrame, batch: str | None = None):
    """rows(seq, request_id, sender_id, body, attachments, ts) -> (messages,
    outcomes with the request owner). Owner or staff may post to an existing
    request; attachments default to []."""
    g = _guarded(rows, users, requests, "sender_id", "message", owner_or_staff=True)
    g = g.withColumn("outcome", F.when(F.col("outcome") == "ok", "created").otherwise(F.col("outcome")))
    g = g.withColumn("message_id", F.when(F.col("outcome") == "created", new_id("message", *([] if batch is None else [F.lit(batch)]), "seq")))
    created = g.where(F.col("outcome") == "created").select(
        F.col("message_id").alias("id"), F.col("request_id").alias("service_request_id"),
        F.col("sender_id").alias("sender_user_id"), "body", "attachments", F.col("ts").alias("created_at"))
    return (append_with_defaults(created, "message", None),
            g.select("seq", "request_id", "sender_id", "caller_role", "owner_id", "ts", "outcome", "message_id"))


def post_deliverables(rows: DataFrame, requests: DataFrame, users: DataFrame, batch: str | None = None):
    """rows(seq, request_id, actor_id, title, description, file_url, ts) ->
    (deliverables, outcomes). Staff only; request must exist; each created
    deliverable also moves its request to ``delivered``."""
    g = _guarded(rows, users, requests, "actor_id", "deliverable", staff_only=True)
    g = g.withColumn("outcome", F.when(F.col("outcome") == "ok", "created").otherwise(F.col("outcome")))
    g = g.withColumn("deliverable_id", F.when(F.col("outcome") == "created", new_id("deliverable", *([] if batch is None else [F.lit(batch)]), "seq")))
    created = g.where(F.col("outcome") == "created").select(
        F.col("deliverable_id").alias("id"), F.col("request_id").alias("service_request_id"), "title",
        "description", "file_url", F.col("ts").alias("created_at"))
    return created, g.select("seq", "request_id", "actor_id", "owner_id", "ts", "outcome", "deliverable_id")


def submit_quotes(rows: DataFrame, requests: DataFrame, users: DataFrame):
    """rows(seq, request_id, actor_id, amount_cents, notes, ts) -> outcomes
    (accepted rows then go to ``upsert_quotes``). Staff only."""
    g = _guarded(rows, users, requests, "actor_id", "quote", staff_only=True)
    return g.withColumn("outcome", F.when(F.col("outcome") == "ok", "accepted").otherwise(F.col("outcome"))) \
        .select("seq", "request_id", "actor_id", "owner_id", "amount_cents", "notes", "ts", "outcome")


def set_status(rows: DataFrame, requests: DataFrame, users: DataFrame):
    """rows(seq, request_id, actor_id, status, ts) -> outcomes. Staff only;
    any of the 8 statuses; unknown request -> not_found."""
    g = _guarded(rows, users, requests, "actor_id", "status", staff_only=True)
    return g.withColumn("outcome", F.when(F.col("outcome") == "ok", "updated").otherwise(F.col("outcome"))) \
        .select("seq", "request_id", "actor_id", "status", "ts", "outcome")


def decline_quotes(declines: DataFrame, quotes: DataFrame, requests: DataFrame):
    """declines(seq, quote_id, caller_id, ts) -> (quotes, outcomes). Owner
    only; no status guard: the quote and its request become ``declined``."""
    r = requests.select(F.col("id").alias("_rid"), F.col("user_id").alias("owner_id"))
    qo = quotes.select(F.col("id").alias("_qid"), "service_request_id").join(
        r, F.col("service_request_id") == r["_rid"], "inner").drop("_rid")
    j = declines.join(qo, declines["quote_id"] == qo["_qid"], "left")
    outcome = (F.when(F.col("_qid").isNull(), "not_found")
               .when(F.col("owner_id") != F.col("caller_id"), "forbidden").otherwise("declined"))
    outcomes = j.withColumn("outcome", outcome).select(
        "seq", "quote_id", "caller_id", "service_request_id", "owner_id", "ts", "outcome")
    done = outcomes.where(F.col("outcome") == "declined").select(F.col("quote_id").alias("_d")).distinct()
    new_quotes = (quotes.join(done, quotes["id"] == done["_d"], "left")
                  .withColumn("status", F.when(F.col("_d").isNotNull(), F.lit("declined")).otherwise(F.col("status")))
                  .drop("_d"))
    return new_quotes, outcomes


def request_status(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Current status = the last transition event of each request, by (ts,
    seq); every transition overwrites (guards are applied before). events
    (request_id, status, ts, seq). A max of structs: partial aggregation, no
    per-request sort. Returns requests with new status and updated_at."""
    last = events.groupBy(F.col("request_id").alias("_rid")).agg(
        F.max(F.struct("ts", "seq", "status")).alias("_last"))
    j = requests.join(last, requests["id"] == last["_rid"], "left")
    return j.select(*[F.coalesce(F.col("_last.status"), F.col(c)).alias(c) if c == "status"
                      else (F.coalesce(F.col("_last.ts"), F.col(c)).alias(c) if c == "updated_at" else F.col(c))
                      for c in requests.columns])


# ------------------------------------------------------------- deletes

def _keys(df: DataFrame) -> DataFrame:
    """Write a deleted-key set once to the shared checkpoint folder, so every
    table of the cascade reads it instead of re-deriving it."""
    from mercato.session import scratch_path

    path = scratch_path(df.sparkSession, "deleted-keys")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_cascade(tables: dict[str, DataFrame], kind: str, ids: DataFrame, actor_id=None) -> dict[str, DataFrame]:
    """Delete users / products / services by id and apply the foreign-key
    actions in order (no cycles, depth 3: users -> requests -> messages):

      users    -> requests, orders, messages (sender), notifications cascade; audit actor set null
      services -> requests cascade; order_items.service_id set null
      requests -> messages, quotes, deliverables cascade; orders.service_request_id set null
      orders   -> order_items cascade
      products -> order_items.product_id set null

    Deleting oneself is refused (``actor_id``). Every step is a left anti
    join or a left join + ``when`` on the deleted-key frame."""
    t = dict(tables)
    ids = ids.select(F.col("id").alias("_del")).distinct()
    if kind == "users" and actor_id is not None:
        ids = ids.where(F.col("_del") != F.lit(actor_id))
    ids = _keys(ids)

    def anti(df, col, keys):
        return df.join(keys, df[col] == keys["_del"], "left_anti")

    def null_out(df, col, keys):
        k = keys.withColumnRenamed("_del", "_gone")
        j = df.join(k, df[col] == k["_gone"], "left")
        return j.withColumn(col, F.when(F.col("_gone").isNotNull(), F.lit(None).cast(df.schema[col].dataType))
                            .otherwise(F.col(col))).drop("_gone")

    if kind == "users":
        req_del = t["service_requests"].join(ids, t["service_requests"]["user_id"] == ids["_del"], "left_semi") \
            .select(F.col("id").alias("_del"))
        ord_del = t["orders"].join(ids, t["orders"]["user_id"] == ids["_del"], "left_semi").select(F.col("id").alias("_del"))
        t["users"] = anti(t["users"], "id", ids)
        t["notifications"] = anti(t["notifications"], "user_id", ids)
        t["messages"] = anti(t["messages"], "sender_user_id", ids)
        t["audit_log"] = null_out(t["audit_log"], "actor_user_id", ids)
    elif kind == "services":
        req_del = t["service_requests"].join(ids, t["service_requests"]["service_id"] == ids["_del"], "left_semi") \
            .select(F.col("id").alias("_del"))
        ord_del = None
        t["services"] = anti(t["services"], "id", ids)
        t["order_items"] = null_out(t["order_items"], "service_id", ids)
    elif kind == "products":
        req_del, ord_del = None, None
        t["products"] = anti(t["products"], "id", ids)
        t["order_items"] = null_out(t["order_items"], "product_id", ids)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    req_del = _keys(req_del) if req_del is not None else None
    ord_del = _keys(ord_del) if ord_del is not None else None
    if req_del is not None:
        t["service_requests"] = anti(t["service_requests"], "id", req_del)
        t["messages"] = anti(t["messages"], "service_request_id", req_del)
        t["quotes"] = anti(t["quotes"], "service_request_id", req_del)
        t["deliverables"] = anti(t["deliverables"], "service_request_id", req_del)
        t["orders"] = null_out(t["orders"], "service_request_id", req_del)
    if ord_del is not None:
        t["orders"] = anti(t["orders"], "id", ord_del)
        t["order_items"] = anti(t["order_items"], "order_id", ord_del)
    return t
