"""Patches of a unique value, each in its turn: a value that an earlier patch gave up can be claimed by a later one.

Whether a claim succeeds depends on who holds the value just then, and that on the
claims before it. The batch starts from the guess that every claim succeeds and
works out, for all claims at once, who would hold each value; the result is the
next guess. The first wrong claim of any guess depends on right ones only, so each
round mends at least the next link of every chain of dependent claims, and a guess
that stays as it is is the sequential result. Claims that everyone loses to the same
holder settle in two rounds, and so do hand-overs that succeed; rounds beyond that
follow chains of claims of which each failed because the one before it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.rules import issues, optional
from mercato.operators.changes import merge_given
from mercato.session import scratch_path

#: Patches in a slab; what one task orders at a time of a value or row that many patches name.
SLAB_ROWS = 200_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_before(rows: DataFrame, key: str, value: str, into: str, order: str = "seq", slab: str = "slab") -> DataFrame:
    """``rows`` with the last non-null ``value`` of the rows of the same ``key`` that come before in ``order``.

    First inside each (key, slab), then over the few slabs of a key, so a key that
    most rows share is ordered by many tasks.
    """
    inside = Window.partitionBy(key, slab).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(slab).alias("_s")).agg(
        F.max_by(value, order).alias("_end"))
    every = rows.select(F.col(key).alias("_k"), F.col(slab).alias("_s")).distinct().join(ends, ["_k", "_s"], "left")
    starts = every.withColumn("_start", F.last("_end", ignorenulls=True).over(over)).drop("_end")
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    return (here.join(starts, (F.col(key) == F.col("_k")) & (F.col(slab) == F.col("_s")), "left")
            .withColumn(into, F.coalesce("_here", "_start")).drop("_here", "_k", "_s", "_start"))


def _next_guess(claims: DataFrame) -> DataFrame:
    """claims(seq, slab, id, value, takes, own, holder, ok, was): ``ok`` worked out anew from ``ok``, which becomes ``was``."""
    done = F.col("takes") & F.col("ok")
    held = last_before(claims.withColumn("_took", F.when(done, F.struct("value"))), "id", "_took", "_before")
    left = F.coalesce(F.col("_before.value"), F.col("own"))
    freed = (held.where(done & (left != F.col("value")))
             .select("seq", "slab", left.alias("value"), F.struct(F.lit(None).cast(claims.schema["id"].dataType).alias("id")).alias("_who")))
    line = claims.withColumn("_who", F.when(done, F.struct("id"))).unionByName(freed, allowMissingColumns=True)
    line = last_before(line, "value", "_who", "_now").where(F.col("takes").isNotNull())
    now = F.when(F.col("_now").isNotNull(), F.col("_now.id")).otherwise(F.col("holder"))
    return line.select(*[c for c in claims.columns if c not in ("ok", "was")],
                       (now.isNull() | now.eqNullSafe(F.col("id"))).alias("ok"), F.col("ok").alias("was"))


def settle(claims: DataFrame) -> DataFrame:
    """claims(seq, slab, id, value, takes, own, holder) with ``ok``: the value is free or held by the same id at that time.

    ``own`` is the value that the id holds at the start, ``holder`` the id that holds
    the claimed value at the start; rows with ``takes`` false only look. Each round is
    written to the shared checkpoint folder; there is no limit on rounds.
    """
    guess = claims.withColumn("ok", F.lit(True)).withColumn("was", F.lit(False))
    while True:
        guess = _written(_next_guess(guess.drop("was").withColumn("was", F.lit(False))), "claims")
        if guess.where(F.col("ok") != F.col("was")).isEmpty():
            return guess.drop("was")


def apply_patches_in_turn(table: DataFrame, patches: DataFrame, fields: list[str], unique_col: str, now,
                          rules: list[tuple[str, Column]] | None = None, seq: str = "seq",
                          touch: str | None = "updated_at", normalize: dict[str, Column] | None = None,
                          also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Partial updates by id as if handled one after the other by ``seq`` -> (new table, outcomes(seq, id, outcome, issues)).

    As ``changes.apply_patches``, but a patch conflicts when another row holds its
    unique value at that time: a value given up by an earlier patch is free, one
    taken by an earlier patch is held. Outcomes: invalid > conflict > no_updates >
    not_found > updated. A null field is not given. ``seq`` is a whole number that
    tells patches apart: nulls or repeats raise ValueError. An empty batch changes
    nothing. Values of the table are unique; a null value of the table is held by no one.
    """
    p = patches.withColumn("seq", F.col(seq).cast("long"))
    for c, expr in (normalize or {}).items():
        p = p.withColumn(c, expr)
    rule_list = [(code, optional(col, pred)) for code, col, pred in (rules or []) if col in p.columns]
    p = p.withColumn("issues", issues(rule_list) if rule_list else F.array().cast("array<string>"))
    n, low, high, given = p.agg(F.count(F.lit(1)), F.min("seq"), F.max("seq"), F.count("seq")).first()
    if given < n or not p.groupBy("seq").count().where("count > 1").isEmpty():
        raise ValueError("seq must tell patches apart")
    width = -(-(high - low + 1) // -(-n // SLAB_ROWS)) if n else 1
    rows = table.select(F.col("id").alias("_found"), F.col(unique_col).alias("own"))
    p = p.join(rows, p["id"] == rows["_found"], "left")
    valid = F.size("issues") == 0
    holders = table.select(F.col(unique_col).alias("_u"), F.col("id").alias("holder"))
    claims = p.where(valid & F.col(unique_col).isNotNull())
    claims = claims.join(holders, claims[unique_col] == holders["_u"], "left").select(
        "seq", F.floor((F.col("seq") - F.lit(low or 0)) / F.lit(width)).cast("long").alias("slab"), "id",
        F.col(unique_col).alias("value"), F.col("_found").isNotNull().alias("takes"), "own", "holder")
    settled = settle(claims).select(F.col("seq").alias("_seq"), F.col("ok").alias("_ok"))
    p = p.join(settled, p["seq"] == settled["_seq"], "left")
    n_given = sum(F.col(f).isNotNull().cast("int") for f in [*fields, *also])
    outcome = (F.when(~valid, "invalid").when(~F.coalesce(F.col("_ok"), F.lit(True)), "conflict")
               .when(n_given == 0, "no_updates").when(F.col("_found").isNull(), "not_found").otherwise("updated"))
    p = p.withColumn("outcome", outcome)
    return (merge_given(table, p.where(F.col("outcome") == "updated"), fields, "seq", touch, now),
            p.select("seq", "id", "outcome", "issues"))
