"""The notification stream: all seven branches from one stream of changes, each change notified once.

One ``foreachBatch`` writes several tables (notifications, late changes, changes
that still wait for their request or caller, keys already done) and at last one
ledger row, which makes the step count. The static side (users, requests,
services) is read anew in each batch, so requests made after the stream's start
are seen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.columns import wall_micros
from mercato.operators import notify
from mercato.operators.limiter import _seconds

LEDGER = ("query string, batch long, step long, watermark long, notified long, waiting long, late long, repeated long, "
          "live array<struct<step:long,newest:long>>")
#: What a change is: the same key again is the same change.
KEY = ["kind", "seq"]


class NotificationSink:
    """Turns micro-batches of changes (``notify.CHANGES``) into notifications under ``root``, each change once.

    Tables, one folder per step: ``notifications``, ``late`` (with a reason),
    ``waiting``, ``keys`` and ``ledger``. A step counts once its ledger row is
    written, which is last; a batch that failed before is done again under the
    same step and overwrites. A batch the ledger has is not done again. The
    watermark is the newest time seen less ``lateness``; it is in the ledger, so
    it survives a lost checkpoint: then the source is replayed, and changes come
    again, but those at or after the watermark are known by key, and older ones
    are late. Keys are looked up in steps that reach past the watermark only.

    - A change behind the watermark goes to ``late`` (reason ``late``).
    - A change whose request or caller is not there yet waits, and is tried
      again in every batch until the watermark passes it; then it goes to
      ``late`` (reason ``unresolved``).
    - A change without a time is never late and cannot wait: one that finds no
      request goes to ``late`` (reason ``unresolved``) at once.

    Every change is in ``notifications`` (or has nobody to notify), ``waiting``,
    ``late``, or is a repeat of one that is.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Callable[[], Mapping[str, DataFrame]], lateness: str = "1 hour"):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.lateness = _seconds(lateness) * 1_000_000

    def _path(self, table: str, step: int) -> str:
        return f"{self.root}/{table}/step={step:010d}"

    def _steps(self) -> list[str]:
        """Folders of finished ledger rows, in order."""
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger/step=*/_SUCCESS")
        found = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(f.getPath().getParent().toString() for f in found or [])

    def ledger(self) -> list:
        """All rows, oldest first."""
        steps = self._steps()
        return self.spark.read.schema(LEDGER).parquet(*steps).orderBy("step").collect() if steps else []

    def read(self, table: str) -> DataFrame:
        """A table of the finished steps; of ``waiting``, what waits now."""
        steps = [int(p.rsplit("=", 1)[1]) for p in self._steps()]
        schema = {"notifications": notify.NOTIFY_SCHEMA, "late": f"{notify.CHANGES}, reason string", "waiting": notify.CHANGES}[table]
        paths = [self._path(table, s) for s in (steps[-1:] if table == "waiting" else steps)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        steps = self._steps()
        last = self.spark.read.schema(LEDGER).parquet(steps[-1]).first() if steps else None
        if last is not None and last.query == query and last.batch >= batch_id:
            return
        step = last.step + 1 if last else 0
        mark, live = (last.watermark, last.live) if last else (None, [])

        # the batch as it is, written once: what follows reads it several times
        cols = [c.split()[0] for c in notify.CHANGES.split(", ")]
        batch.select(*cols).write.mode("overwrite").parquet(self._path("batch", step))
        rows = self.spark.read.schema(notify.CHANGES).parquet(self._path("batch", step))
        us = wall_micros("ts")
        behind = F.coalesce(us < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        late = rows.where(behind)
        fresh = rows.where(~behind).dropDuplicates(KEY)
        known = [s.step for s in live if mark is None or s.newest >= mark]
        if known:
            keys = self.spark.read.schema("kind string, seq string").parquet(*[self._path("keys", s) for s in known])
            fresh = fresh.join(keys.distinct(), KEY, "left_anti").select(*cols)
        fresh.write.mode("overwrite").parquet(self._path("fresh", step))
        fresh = self.spark.read.schema(notify.CHANGES).parquet(self._path("fresh", step))

        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(us).alias("newest"), F.count_if(behind).alias("late")).first()
        new = fresh.agg(F.count(F.lit(1)).alias("n"), F.max(us).alias("newest")).first()
        seen = [x for x in (mark, counts.newest - self.lateness if counts.newest is not None else None) if x is not None]
        after = max(seen) if seen else None

        work = fresh
        if last is not None:
            work = fresh.unionByName(self.spark.read.schema(notify.CHANGES).parquet(self._path("waiting", last.step)))
        static = self.tables()
        notes, unresolved = notify.change_notifications(work, static["users"], static["service_requests"], static["services"])
        over = F.col("ts").isNull() | (us < F.lit(after) if after is not None else F.lit(False))
        write = {"notifications": notes, "waiting": unresolved.where(~over), "keys": fresh.select("kind", F.col("seq").cast("string")),
                 "late": late.withColumn("reason", F.lit("late")).unionByName(
                     unresolved.where(over).withColumn("reason", F.lit("unresolved")))}
        for table, df in write.items():
            df.write.mode("overwrite").parquet(self._path(table, step))
        size = {t: self.spark.read.parquet(self._path(t, step)).count() for t in ("notifications", "waiting", "late")}
        # of a change without a time the key is kept for as long as the newest of its step
        ages = [x for x in (new.newest, after) if x is not None]
        live = [(s.step, s.newest) for s in live if after is None or s.newest >= after]
        live += [(step, max(ages) if ages else 2**62)] if new.n else []
        row = (query, batch_id, step, after, size["notifications"], size["waiting"], size["late"],
               counts.n - counts.late - new.n, live)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").parquet(self._path("ledger", step))


def notification_stream(changes: DataFrame, root: str, tables: Callable[[], Mapping[str, DataFrame]],
                        lateness: str = "1 hour", checkpoint: str | None = None, trigger: Mapping | None = None,
                        name: str = "notifications"):
    """Start the stream of ``changes`` into ``root``; its checkpoint is ``root/_checkpoint`` unless given.
    ``tables()`` gives users, service_requests and services as they are now.
    ``trigger`` as for ``DataStreamWriter.trigger``: every 60 seconds if not given."""
    sink = NotificationSink(changes.sparkSession, root, tables, lateness)
    return (changes.writeStream.option("checkpointLocation", checkpoint or f"{root.rstrip('/')}/_checkpoint")
            .foreachBatch(sink).trigger(**(trigger or {"processingTime": "60 seconds"})).queryName(name).start())
