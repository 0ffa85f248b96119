"""Structured Streaming jobs: the limiter, unread counts, request status and
sessions as unbounded queries (notifications: ``streaming.notifications``).

Each ``*_stream`` function maps a streaming DataFrame to a streaming
DataFrame; ``run_available_now`` drives one to completion into a parquet
folder (checkpointed under the shared checkpoint folder), which is how the
tests compare a stream with its batch operator on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from mercato.functions.columns import wall_micros
from mercato.operators.keys import active_sessions
from mercato.operators.limiter import _seconds
from mercato.session import BASE_CONF, scratch_path
from mercato.streaming import processors
from mercato.streaming.late import BAR
from mercato.streaming.processors import UnreadProcessor, limiter_fold, request_status_fold, session_fold

# Ship the per-key folds by value: executors then need only pandas/numpy,
# not this package on their Python path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(processors)
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass

DEFAULT_LATENESS = "1 hour"


def attempt_limiter_stream(attempts: DataFrame, key: str, limit: int, refill, ts: str = "ts",
                           id_col: str = "id", lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """attempts stream -> (key, id, ts, allowed, anchor_id), one row per
    attempt. State per key = (tokens, anchor); it expires (event time) once
    the watermark passes anchor + refill, when a new attempt would reset it
    anyway. Attempts behind the watermark are dropped, unless ``attempts`` is the
    on-time side of a ``late.LateSplit``, which keeps them in a table."""
    cols = [F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts")]
    s = attempts.select(*cols, BAR).withWatermark(BAR, "1 second") if BAR in attempts.columns else \
        attempts.select(*cols).withWatermark("ts", lateness)
    return s.groupBy("key").applyInPandasWithState(
        limiter_fold(limit, _seconds(refill) * 1_000_000),
        f"key {attempts.schema[key].dataType.simpleString()}, id long, ts timestamp, allowed boolean, anchor_id long",
        "tokens int, anchor long, anchor_id long", "append", GroupStateTimeout.EventTimeTimeout)


def _rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` keeps its state variables in RocksDB only."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, BASE_CONF[key])


def unread_stream(notifications: DataFrame, reads: DataFrame, k: int = 30, early: str = "7 days",
                  lateness: str = "7 days", buckets: int = 256) -> DataFrame:
    """Unread count among each user's newest ``k``, refreshed per trigger
    (the page polls every 60 s: ``trigger(processingTime='60 seconds')``).
    A read only touches the reader's own notifications. A read may
    come before its notification: it is kept for ``early`` (event time, as the
    watermark of the notifications tells it) and counts when the notification
    comes, in this batch or batches later. Notifications more than
    ``lateness`` behind the newest are left out, as by any watermark. The state is
    dealt out over ``buckets`` of users, a fixed number for a checkpoint: size it so that
    a bucket holds some thousand users (its newest are one value), and above the cores."""
    _rocksdb(notifications.sparkSession)
    n = notifications.select("user_id", F.lit("n").alias("kind"), "id",
                             F.col("created_at").cast("timestamp").alias("created_at"),
                             F.coalesce(wall_micros("created_at"), F.lit(2**63 - 1)).alias("created"),  # no time: newest
                             F.col("read_at").isNotNull().alias("is_read"))
    r = reads.select("user_id", F.lit("r").alias("kind"), "id", F.lit(None).cast("timestamp").alias("created_at"),
                     F.lit(0).cast("long").alias("created"), F.lit(True).alias("is_read"))
    rows = n.unionByName(r).where(F.col("id").isNotNull()).withWatermark("created_at", lateness)
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("long")
    rows = rows.withColumn("bucket", bucket).withColumn("user_id", F.coalesce("user_id", F.lit(0)).cast("long"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        UnreadProcessor(k, _seconds(early) * 1000), "user_id long, unread long, n_latest long", "update", "EventTime")


def request_status_stream(events: DataFrame, remember: str = "7 days") -> DataFrame:
    """events (request_id, kind, status, order_id, ts, seq) -> current
    (request_id, status, updated_at, quote_status) per trigger, with the
    sequential guards: accept only from sent/draft, an order pays once. A
    payment that repeats an order's last one counts as a repeat for
    ``remember`` of event time, so a request's state holds the payments of
    that time and no more; size it for the payment source's retries."""
    at = F.col("init_at").cast("timestamp") if "init_at" in events.columns else F.lit(None).cast("timestamp")
    e = events.select("request_id", "kind", "status", F.col("order_id").cast("string").alias("order_id"),
                      F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"),
                      at.alias("init_at"))
    return e.groupBy("request_id").applyInPandasWithState(
        request_status_fold(_seconds(remember) * 1_000_000), "request_id long, status string, updated_at timestamp, quote_status string",
        "status string, updated long, quote string, paid string", "update", GroupStateTimeout.NoTimeout)


def session_stream(logins: DataFrame, events: DataFrame, lifetime: str = "7 days",
                   lateness: str = DEFAULT_LATENESS, width: str = "1 day") -> DataFrame:
    """Every (login, event) pair of a user where the login covers the event,
    as a stream-stream interval join: ``active_sessions`` over two streams with
    a watermark each. The bins deal out a hot user's state too. State is
    bounded: a login is dropped once the watermark passes its end, an event
    once no login that could cover it can still come."""
    lg = logins.select("user_id", "id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    ev = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return active_sessions(lg, ev, lifetime, width)


def latest_session_stream(logins: DataFrame, events: DataFrame, lifetime: str = "7 days",
                          lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Each event with the user's latest login covering it (login_ts <= ts <
    login_ts + lifetime). One merged stream keyed by user; state = latest
    login, so no login x event pairs are formed."""
    lg = logins.select("user_id", F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"),
                       F.col("ts").cast("timestamp").alias("ts"))
    ev = events.select("user_id", F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("id"),
                       F.col("ts").cast("timestamp").alias("ts"))
    s = lg.unionByName(ev).withWatermark("ts", lateness)
    return s.groupBy("user_id").applyInPandasWithState(
        session_fold(_seconds(lifetime) * 1_000_000),
        "user_id long, event_id long, ts timestamp, login_id long, login_ts timestamp",
        "login long, login_id long", "append", GroupStateTimeout.EventTimeTimeout)


def start_stream(stream: DataFrame, out_path: str, mode: str = "append", trigger: str = "60 seconds",
                 name: str = "stream", checkpoint: str | None = None):
    """Start ``stream`` for production: a processing-time trigger (the
    notification poll is 60 s), one overwrite-per-batch folder so replays do
    not duplicate. The checkpoint belongs to the output: by default it is
    ``<out_path>/_checkpoint``, so a restart goes on where the last run ended,
    with its state, and batch numbers never start again over old output."""
    ckpt = checkpoint or f"{out_path.rstrip('/')}/_checkpoint"

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(write)
            .trigger(processingTime=trigger).queryName(name).start())


def run_available_now(stream: DataFrame, out_path: str | None = None, mode: str = "append",
                      name: str = "stream") -> str:
    """Run ``stream`` over everything available, into parquet at
    ``out_path`` (a fresh folder under the checkpoint folder by default).
    Each micro-batch is written to its own ``batch=<id>`` folder with
    overwrite, so a replayed batch rewrites rather than duplicates."""
    spark = stream.sparkSession
    out_path = out_path or scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out_path


def write_stream_input(df: DataFrame, path: str, order_col: str, slices: int = 4,
                       files_per_slice: int | None = None) -> str:
    """Lay ``df`` down as ``slices`` consecutive time ranges of ``order_col``
    (boundaries from approxQuantile: ``slices - 1`` numbers on the driver),
    written one after another, so the file source reads them in time order.
    ``files_per_slice`` pins the file count (paired with ``maxFilesPerTrigger``
    it gives one micro-batch per slice): a slice with too few rows for its files
    is filled up with empty ones. ``df`` is read once for each slice and once for
    the boundaries, so store it first if it is costly."""
    key = wall_micros(order_col).cast("double")
    keyed = df.withColumn("_o", key)
    probs = [i / slices for i in range(1, slices)]
    cuts = keyed.approxQuantile("_o", probs, 0.0001) if probs else []
    bounds = [None, *cuts, None]
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]), 1):
        part = keyed
        if lo is not None:
            part = part.where(F.col("_o") > lo)
        if hi is not None:
            part = part.where(F.col("_o") <= hi)
        if lo is not None and hi is None:  # rows without a time come last
            part = part.unionByName(keyed.where(F.col("_o").isNull()))
        part = part.drop("_o")
        if files_per_slice:
            part = part.repartition(files_per_slice)
        part.write.mode("append").parquet(path)
        if files_per_slice and files_per_slice > 1:
            spark = df.sparkSession
            missing = i * files_per_slice - len(spark.read.schema(df.schema).parquet(path).inputFiles())
            for _ in range(missing):
                spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


#: Rows in one file of a slice, which one task writes.
FILE_ROWS = 500_000


def files_for(df: DataFrame, slices: int = 4) -> int:
    """Files for each of ``slices`` slices of ``df``, so that a file holds about ``FILE_ROWS`` rows."""
    return -(-df.count() // (slices * FILE_ROWS)) or 1


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)
