"""Rows behind the watermark as an output of their own.

Spark drops a row that comes later than the watermark without a trace. Here a
first query splits its source: late rows go to a side table, the others to a
folder the event-time job reads, each with the watermark (the *bar*) of its
batch. The job takes the bar as its watermark, so it drops nothing, and each
input row is in exactly one of the two outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.limiter import _seconds
from mercato.session import scratch_path

BAR, LATE = "_bar", "_late"
LEDGER = "batch long, newest long, bar long"
#: The bar of a batch before which no time was seen. Not 0: Spark takes times up to the watermark it starts with, 0, as late.
FLOOR = 86_400_000_000


class LateSplit:
    """``foreachBatch`` sink that deals out micro-batches under ``root`` by their time column ``ts``.

    The bar of a batch is the newest time of all batches before it, less
    ``lateness``: never lower than the bar before. A row with a time before its
    batch's bar, or without a time, is late. A batch is written aside, its newest
    time noted in the ledger, and then put in place whole by one rename of its
    folder; a batch that is in place is not done again, and one that failed before
    is redone with the same bar. The rename is atomic on HDFS and local folders; on
    an object store without atomic renames, read the outputs after the query ended.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, ts: str = "ts", lateness: str = "1 hour"):
        if clash := {BAR, LATE} & set(schema.names):
            raise ValueError(f"the stream has columns of these names already: {sorted(clash)}")
        self.spark, self.root, self.ts = spark, root.rstrip("/"), ts
        self.lateness = _seconds(lateness) * 1_000_000
        self.schema = T.StructType([*schema.fields, T.StructField(BAR, T.TimestampType())])

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _bar(self, batch_id: int) -> int:
        path, fs = self._path("ledger")
        if not fs.exists(path):
            return FLOOR
        seen = self.spark.read.schema(LEDGER).json(f"{self.root}/ledger/*").where(F.col("batch") < batch_id)
        newest, bar = seen.agg(F.max("newest"), F.max("bar")).first()
        return max(FLOOR, bar or FLOOR, FLOOR if newest is None else newest - self.lateness)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done, fs = self._path("done", f"batch={batch_id}")
        if fs.exists(done):
            return
        bar = self._bar(batch_id)
        time = F.unix_micros(F.col(self.ts).cast("timestamp"))
        aside = f"{self.root}/aside/batch={batch_id}"
        (batch.withColumns({BAR: F.timestamp_micros(F.lit(bar)), LATE: F.coalesce(time < bar, F.lit(True))})
         .write.mode("overwrite").partitionBy(LATE).parquet(aside))
        written = self.spark.read.schema(self.schema).parquet(aside)
        written.agg(F.lit(batch_id).alias("batch"), F.max(time).alias("newest"), F.lit(bar).alias("bar")) \
            .write.mode("overwrite").json(f"{self.root}/ledger/batch={batch_id}")
        fs.mkdirs(done.getParent())
        if not fs.rename(self._path("aside", f"batch={batch_id}")[0], done):
            raise OSError(f"{done} could not be put in place")

    def _folder(self, late: bool) -> str:
        return f"{self.root}/done/batch=*/{LATE}={str(late).lower()}"

    def late(self) -> DataFrame:
        """The rows behind the watermark so far, with the bar they missed."""
        path, fs = self._path("done", "batch=*", f"{LATE}=true")
        if not fs.globStatus(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(True))

    def on_time(self) -> DataFrame:
        """The other rows as a stream, in the order of their batches."""
        return self.spark.readStream.schema(self.schema).parquet(self._folder(False))


def split_available_now(stream: DataFrame, ts: str = "ts", lateness: str = "1 hour", root: str | None = None) -> LateSplit:
    """Split everything ``stream`` has now. A call with an earlier ``root`` goes on where that one ended."""
    spark = stream.sparkSession
    split = LateSplit(spark, root or scratch_path(spark, "late"), stream.schema, ts, lateness)
    q = (stream.writeStream.option("checkpointLocation", f"{split.root}/checkpoint").foreachBatch(split)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return split
