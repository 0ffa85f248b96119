"""Row visibility for all viewers at once, plus the change guards.

Visibility rules (per endpoint):
  * requests:      customer, or ``mine``        -> own rows; staff otherwise -> all rows
  * orders:        ``mine``, or customer         -> own rows; otherwise all rows
  * notifications: ``mine``                      -> own rows; admin without ``mine`` -> the
                   named target user's rows (own by default); anyone else is refused
  * request:       owner or staff

The "own" and "target" scopes are equi joins on the owner column. The "all"
scope is *not* expanded into viewer x row pairs (that output grows with
staff x rows); it is returned once per row with ``viewer_id`` null and
``scope = 'all'``, which a consumer joins to its list of all-scope viewers
only if it truly needs pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import is_staff

RULES = ("requests", "orders", "notifications", "request")


def viewer_scopes(viewers: DataFrame, rule: str) -> DataFrame:
    """viewers(id, role, mine[, target_user_id]) -> (viewer_id, scope, scope_user_id).

    scope is 'own' / 'target' (rows of scope_user_id), 'all', or 'refused'."""
    mine = F.coalesce(F.col("mine"), F.lit(False))
    role = F.col("role")
    if rule in ("requests", "orders"):
        own = (role == "customer") | mine
        if rule == "requests":
            own = own | ~is_staff(role)
        scope = F.when(own, "own").otherwise("all")
        user = F.when(own, F.col("id"))
    elif rule == "notifications":
        target = (F.coalesce(F.col("target_user_id"), F.col("id"))
                  if "target_user_id" in viewers.columns else F.col("id"))
        scope = F.when(mine, "own").when(role == "admin", "target").otherwise("refused")
        user = F.when(mine, F.col("id")).when(role == "admin", target)
    elif rule == "request":
        scope = F.when(is_staff(role), "all").otherwise("own")
        user = F.when(~is_staff(role), F.col("id"))
    else:
        raise ValueError(f"unknown rule {rule!r}; expected one of {RULES}")
    return viewers.select(F.col("id").alias("viewer_id"), scope.alias("scope"), user.alias("scope_user_id"))


def visible_rows(viewers: DataFrame, rows: DataFrame, rule: str, owner_col: str = "user_id",
                 row_key: str = "id") -> DataFrame:
    """(viewer_id, scope, row_id): scoped viewers get one pair per visible row
    (equi join on the owner column); rows visible to every all-scope viewer
    appear once with a null viewer_id."""
    scopes = viewer_scopes(viewers, rule)
    scoped = scopes.where(F.col("scope").isin("own", "target"))
    r = rows.select(F.col(row_key).alias("row_id"), F.col(owner_col).alias("_owner"))
    own = (scoped.join(r, scoped["scope_user_id"] == r["_owner"], "inner")
           .select("viewer_id", "scope", "row_id"))
    # Uncorrelated EXISTS: evaluated once, no join with the viewers.
    any_all = scopes.where(F.col("scope") == "all").exists()
    everyone = (r.where(any_all)
                .select(F.lit(None).cast(scopes.schema["viewer_id"].dataType).alias("viewer_id"),
                        F.lit("all").alias("scope"), "row_id"))
    return own.unionByName(everyone)
