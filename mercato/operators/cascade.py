"""Deletes of all kinds at once: the closure of what goes over the declared references, then one pass for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.integrity import REFERENCES
from mercato.session import scratch_path

#: References that become null when their row goes; rows with any other reference to it go too. The data model's.
SET_NULL = [("orders", "service_request_id"), ("order_items", "product_id"), ("order_items", "service_id"),
            ("audit_log", "actor_user_id")]


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "deleted-keys")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _referring(t: dict[str, DataFrame], frontier: DataFrame) -> DataFrame:
    """(table, key) of the rows that go with the frontier's, of tables that other tables refer to: one join for each."""
    found = []
    for child in sorted(set(REFERENCES.values())):
        refs = [(c, parent) for (table, c), parent in REFERENCES.items() if table == child and (child, c) not in SET_NULL]
        if refs:
            ref = F.explode(F.array(*[F.struct(F.lit(p).alias("table"), F.col(c).cast("string").alias("key")) for c, p in refs]))
            rows = t[child].select(F.col("id").cast("string").alias("_id"), ref.alias("ref"))
            found.append(rows.select("_id", F.col("ref.table").alias("table"), F.col("ref.key").alias("key"))
                         .join(frontier, ["table", "key"], "left_semi").select(F.lit(child).alias("table"), F.col("_id").alias("key")))
    return reduce(DataFrame.unionByName, found).distinct()


def closure(t: dict[str, DataFrame], doomed: DataFrame) -> DataFrame:
    """doomed(table, key text) and all rows that go with them, semi-naively: each round joins only what the last one added.

    Rounds are written to the shared checkpoint folder and end when one adds nothing,
    which is after as many as references follow each other.
    """
    seen = frontier = _stored(doomed.where(F.col("key").isNotNull()).distinct())
    while True:
        frontier = _stored(_referring(t, frontier).join(seen, ["table", "key"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def delete_all(t: dict[str, DataFrame], doomed: DataFrame, actor_id=None) -> dict[str, DataFrame]:
    """Every table without the rows named by doomed(table, key) and what goes with them, other references to them null.

    Ids that do not exist, null ids and repeats are no error. The user ``actor_id``
    (who deletes) stays. Tables that ``t`` lacks are left out; those without
    references pass through.
    """
    doomed = doomed.select("table", F.col("key").cast("string").alias("key"))
    if actor_id is not None:
        doomed = doomed.where(~((F.col("table") == "users") & (F.col("key") == str(actor_id))))
    gone = closure(t, doomed)
    parents, out = set(REFERENCES.values()), {}
    for name, df in t.items():
        columns = df.columns
        refs = [(c, p) for (table, c), p in REFERENCES.items() if table == name]
        for c, parent in [("id", name)] * (name in parents) + [r for r in refs if (name, r[0]) not in SET_NULL]:
            keys = gone.where(F.col("table") == parent).select(F.col("key").alias("_key"))
            df = df.join(keys, F.col(c).cast("string") == F.col("_key"), "left_anti")
        for c, parent in [r for r in refs if (name, r[0]) in SET_NULL]:
            keys = gone.where(F.col("table") == parent).select(F.col("key").alias("_key"))
            df = df.join(keys, F.col(c).cast("string") == F.col("_key"), "left")
            df = df.withColumn(c, F.when(F.col("_key").isNull(), F.col(c))).drop("_key")
        out[name] = df.select(*columns)
    return out
