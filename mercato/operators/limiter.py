"""Attempt limiter (token bucket with full refill) over whole attempt tables.

Per key, in (ts, id) order: the first attempt opens a bucket of ``limit``
tokens; each allowed attempt takes one; with none left the attempt is
denied and changes nothing; the first attempt **more than** ``refill``
after the bucket opened resets it to ``limit`` (strict ``>``).

So a key's attempts split into windows that start at "anchors": the first
attempt, then each first attempt strictly later than anchor + refill. An
attempt is allowed iff it is among the first ``limit`` of its window.

Anchors depend on earlier anchors (a sequential chain), which we compute
without sorting any key in one task:

1. Time is cut into slabs of length ``refill``; at most one anchor falls in
   a slab, and an attempt's anchor is in its own slab or the one before.
2. ``nxt(e)`` = first attempt after e + refill: an as-of lookup inside the
   next slab (window over (key, slab)), else the first attempt of a later
   non-empty slab (window over a key's slabs: bounded by the time span /
   refill, not by the number of attempts).
3. The chain from each key's first attempt is found by pointer doubling:
   round k adds the nodes 2^k..2^(k+1)-1 steps away and squares the jump
   table. Joins are on the attempt id (no hot key); rounds = log2 of the
   longest chain, bounded up front by the slabs a key spans; each round is
   one job whose table is written to the shared checkpoint folder.
4. Every attempt joins its slab's (or the previous slab's) anchor (one row
   per key and slab), and the first ``limit`` attempts per anchor are kept
   with a row_number filter, which Spark trims map-side before the shuffle.

All keys take this one path, whatever their size; its work is linear in the
attempts times the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import wall_micros
from mercato.session import scratch_path


def _seconds(spec) -> int:
    if isinstance(spec, (int, float)):
        return int(spec)
    n, unit = str(spec).split()
    return int(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
                     "day": 86400, "days": 86400}[unit]


def _stable(df: DataFrame) -> DataFrame:
    """Cut lineage between rounds: write a table in the shared checkpoint
    folder and read it back (one computation, unlike an eager reliable
    checkpoint, which computes its input twice). Survives executor loss:
    the files live in the shared folder, not on the executors."""
    spark = df.sparkSession
    path = scratch_path(spark, "limiter")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def next_attempts(a: DataFrame, r_us: int) -> DataFrame:
    """a(_k, _id, _us, _s) -> (_id, _nxt): the first attempt of the same key
    with _us > this _us + refill (ties by id)."""
    att_t = "struct<u:bigint,i:bigint>"
    probes = a.select("_k", (F.col("_s") + 1).alias("_s"), (F.col("_us") + r_us).alias("_us"),
                      F.lit(1).alias("_kind"), F.col("_id").alias("_src"),
                      F.lit(None).cast(att_t).alias("_att"))
    atts = a.select("_k", "_s", "_us", F.lit(0).alias("_kind"), F.col("_id").alias("_src"),
                    F.struct(F.col("_us").alias("u"), F.col("_id").alias("i")).alias("_att"))
    w = (Window.partitionBy("_k", "_s").orderBy(F.col("_us").desc(), F.col("_kind").desc(), F.col("_src").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_slab = (probes.unionByName(atts).withColumn("_hit", F.last("_att", ignorenulls=True).over(w))
               .where(F.col("_kind") == 1)
               .select(F.col("_src").alias("_id"), F.col("_hit.i").alias("_hit_id")))
    # First attempt of the next, and next-but-one, non-empty slab of the key.
    firsts = a.groupBy("_k", "_s").agg(F.min(F.struct(F.col("_us").alias("u"), F.col("_id").alias("i"))).alias("_f"))
    ws = Window.partitionBy("_k").orderBy("_s")
    firsts = firsts.select("_k", "_s",
                           F.lead("_s", 1).over(ws).alias("_s1"), F.lead("_f", 1).over(ws).alias("_f1"),
                           F.lead("_f", 2).over(ws).alias("_f2"))
    base = a.select("_id", "_k", "_s").join(firsts, ["_k", "_s"], "left").join(in_slab, "_id", "left")
    later = F.when(F.col("_s1") == F.col("_s") + 1, F.col("_f2.i")).otherwise(F.col("_f1.i"))
    return base.select("_id", F.coalesce(F.col("_hit_id"), later).alias("_nxt"))


def chain_anchors(heads: DataFrame, jumps: DataFrame, rounds: int) -> DataFrame:
    """Nodes reachable from ``heads`` (ids) along ``jumps`` (_id -> _nxt)
    within ``2**rounds`` steps. One table per round holds both the jump
    (squared each round) and the reached flag, so a round is one job."""
    h = heads.select("_id", F.lit(True).alias("_h"))
    t = _stable(jumps.select("_id", "_nxt").join(h, "_id", "left")
                .select("_id", "_nxt", F.coalesce("_h", F.lit(False)).alias("_r")))
    for _ in range(rounds):
        # Targets of reached nodes are distinct (chains never share a node at
        # two distances), so the join below cannot duplicate rows.
        targets = t.where("_r").select(F.col("_nxt").alias("_tid")).where(F.col("_tid").isNotNull())
        jj = t.select(F.col("_id").alias("_mid"), F.col("_nxt").alias("_nxt2"))
        t = _stable(t.join(jj, t["_nxt"] == jj["_mid"], "left")
                    .join(targets, t["_id"] == targets["_tid"], "left")
                    .select("_id", F.col("_nxt2").alias("_nxt"), (F.col("_r") | F.col("_tid").isNotNull()).alias("_r")))
    return t.where("_r").select("_id")


def _doubling_anchors(a: DataFrame, r_us: int) -> DataFrame:
    heads = a.groupBy("_k").agg(F.min(F.struct("_us", "_id")).alias("_h")).select(F.col("_h._id").alias("_id"))
    # At most one anchor per slab, so a chain is no longer than the number of
    # slabs its key spans: that bounds the doubling rounds (one small job).
    span = a.groupBy("_k").agg((F.max("_s") - F.min("_s") + 1).alias("_n")).agg(F.max("_n")).first()[0] or 1
    rounds = max(0, (int(span) - 1).bit_length())
    return chain_anchors(heads, next_attempts(a, r_us), rounds)


def _flags(a: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """Each attempt's anchor (its slab's or the previous slab's) and whether
    it is among the first ``limit`` of that anchor's window."""
    anch = a.join(anchors, "_id", "left_semi").select(
        "_k", "_s", F.struct(F.col("_us").alias("u"), F.col("_id").alias("i")).alias("_a"))
    cur = anch.withColumnRenamed("_a", "_cur")
    prev = anch.select("_k", (F.col("_s") + 1).alias("_s"), F.col("_a").alias("_prev"))
    me = F.struct(F.col("_us").alias("u"), F.col("_id").alias("i"))
    assigned = (a.join(cur, ["_k", "_s"], "left").join(prev, ["_k", "_s"], "left")
                .withColumn("_anchor", F.when(F.col("_cur").isNotNull() & (F.col("_cur") <= me), F.col("_cur.i"))
                            .otherwise(F.col("_prev.i"))))
    w = Window.partitionBy("_anchor").orderBy("_us", "_id")
    allowed = (assigned.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
               .select(F.col("_id").alias("_ok")))
    return assigned.select("_id", "_anchor").join(allowed, F.col("_id") == F.col("_ok"), "left") \
        .select("_id", F.col("_ok").isNotNull().alias("allowed"), "_anchor")


def attempt_limiter(attempts: DataFrame, key: str, limit: int, refill, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """attempts -> attempts + (allowed boolean, anchor_id). ``refill`` in
    seconds or as text ("60 seconds", "2 days"). 10 / 60 s for logins and
    5 / 60 s for registrations in the reference.

    A missing key counts as the text ``unknown``, so attempts without one
    share a bucket that refills like any other."""
    r_us = _seconds(refill) * 1_000_000
    a = attempts.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("_k"), F.col(id_col).alias("_id"),
                        wall_micros(ts).alias("_us"))
    a = a.withColumn("_s", F.floor(F.col("_us") / F.lit(r_us)).cast("long"))
    flags = _flags(a, _doubling_anchors(a, r_us), limit)
    return (attempts.join(flags, attempts[id_col] == flags["_id"], "left")
            .drop("_id").withColumnRenamed("_anchor", "anchor_id"))
